"""Metrics of rankings and answers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import says
from ..sources.scratch import stored


def nearest_rank(values: DataFrame, column: str, quantiles, by: list[str] | None = None) -> DataFrame:
    """The value at index round((n - 1) q), halves to even, of each group: no interpolation.

    Distinct values with their counts are dealt by ranges of (group, value), so a group of any
    size lies in as many partitions as it needs. The rows of each partition are counted, and only
    the partitions in which a wanted index falls are looked into.
    """
    by = by or []
    counts = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    dealt = stored(counts.repartitionByRange(*by, column).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*by, "_p").agg(F.sum("_c").alias("_s"))
    if by:
        upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        sizes = sizes.withColumn("_e", F.sum("_s").over(upto)).withColumn("_n", F.sum("_s").over(Window.partitionBy(*by)))
    else:  # a row for each partition
        rows = sorted((r["_p"], r["_s"]) for r in sizes.collect())
        ends = list(accumulate(s for _, s in rows))
        table = [(p, s, e, ends[-1]) for (p, s), e in zip(rows, ends, strict=True)]
        sizes = dealt.sparkSession.createDataFrame(table, "_p int, _s long, _e long, _n long")
    qs = F.explode(F.array(*(F.lit(float(q)) for q in quantiles)))
    index = F.bround((F.col("_n") - 1) * F.col("q"))
    wanted = sizes.withColumn("q", qs).where((F.col("_e") > index) & (F.col("_e") - F.col("_s") <= index))
    wanted = wanted.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col("_p").alias("_w"), "q", (index - (F.col("_e") - F.col("_s"))).alias("_i"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    inside = Window.partitionBy(*by, "_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    places = wanted.drop("q", "_i").distinct()
    looked = dealt.join(places, [F.col("_p") == F.col("_w"), *same], "left_semi").withColumn("_u", F.sum("_c").over(inside))
    hit = looked.join(wanted, [F.col("_p") == F.col("_w"), *same]).where((F.col("_u") > F.col("_i")) & (F.col("_u") - F.col("_c") <= F.col("_i")))
    return hit.select(*by, "q", F.col(column).alias("value"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """One row: strict and semantic recall, NDCG and precision at each k, and the MRR.

    ``ranked``: query_id, key, rank, own (is the query's own row), rel (is relevant).
    ``relevant``: query_id, n_rel. Gains are binary; the ideal has min(k, n_rel) hits."""
    most = max(max(ks), 1)
    discount = F.array(*(F.lit(1.0) / F.log2(F.lit(float(i + 1))) for i in range(1, most + 1)))
    per = [F.min(F.when(F.col("own"), F.col("rank"))).alias("own_rank"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first")]
    for k in ks:
        hit = F.col("rel") & (F.col("rank") <= k)
        per += [F.sum(hit.cast("int")).alias(f"hits{k}"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias(f"dcg{k}")]
    q = relevant.join(ranked.groupBy("query_id").agg(*per), "query_id", "left")
    out = [F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.count("*").alias("n_queries")]
    for k in ks:
        ideal = F.aggregate(F.slice(discount, F.lit(1), F.least(F.lit(k), F.greatest(F.col("n_rel"), F.lit(1))).cast("int")), F.lit(0.0), lambda s, x: s + x)
        out += [
            F.round(F.avg(F.coalesce((F.col("own_rank") <= k).cast("double"), F.lit(0.0))), 4).alias(f"strict_recall_{k}"),
            F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 4).alias(f"semantic_recall_{k}"),
            F.round(F.avg(F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal), 4).alias(f"ndcg_{k}"),
            F.round(F.avg(F.coalesce(F.col(f"hits{k}"), F.lit(0)) / F.lit(float(k))), 4).alias(f"precision_{k}"),
        ]
    return q.agg(*out)


def judge_answers(cases: DataFrame, threshold: float = V.PASS_RECALL) -> DataFrame:
    """``cases`` (answer, expect: array of synonym groups, forbid: array, confidence,
    min_confidence) with hit, missed, forbidden, recall and passed. A group is hit by any of its
    words; without expectations the recall is 0; a forbidden word or a confidence under its
    minimum fails the case."""
    text = F.coalesce("answer", F.lit(""))
    groups = F.coalesce("expect", F.array().cast("array<array<string>>"))
    is_hit = lambda g: F.exists(g, lambda w: says(text, w))
    named = lambda a: F.transform(a, lambda g: F.array_join(g, "|"))
    bad = F.filter(F.coalesce("forbid", F.array().cast("array<string>")), lambda w: says(text, w))
    df = cases.withColumn("hit", named(F.filter(groups, is_hit))).withColumn("missed", named(F.filter(groups, lambda g: ~is_hit(g)))).withColumn("forbidden", bad)
    df = df.withColumn("recall", F.round(F.coalesce(F.size("hit") / F.nullif(F.size(groups), F.lit(0)), F.lit(0.0)), 3))
    enough = F.coalesce("confidence", F.lit(0.0)) >= F.coalesce("min_confidence", F.lit(0.0))
    return df.withColumn("passed", (F.size("hit") / F.greatest(F.size(groups), F.lit(1)) >= threshold) & (F.size("forbidden") == 0) & enough)


def summarise(judged: DataFrame) -> DataFrame:
    """One row: total, passed, pass_rate, avg_recall, avg_confidence; zeros without cases."""
    rate = F.round(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)), 3)
    avg = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return judged.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), rate.alias("pass_rate"), avg("recall").alias("avg_recall"), avg("confidence").alias("avg_confidence"))


def gate(pass_rate: Column, least: float) -> Column:
    return pass_rate >= least
