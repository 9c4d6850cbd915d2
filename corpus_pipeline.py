"""The corpus pipeline: quality, near copies, benchmark leaks, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, rule_ensemble, template_decontam, token_files
from tessera.llm.shared import by_size, stored, unused_prefix

#: No SQL scores texts by a fitted rule ensemble; the stages are tested against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject. It learns from labelled documents
    outside the held-out fold."""
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.keep_good(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id, null last,
    and of several with it that of the smallest key. Documents without words are linked with
    nothing and stay. Rows are told apart by doc_id and text, not by doc_id, so unlinked texts of
    one doc_id, or of none, all stay; rows that repeat both are one. Rows whose 64-bit keys
    collide, which a second key shows, stay if one of them does."""
    p = unused_prefix(docs.columns)
    key, twin = f"{p}key", f"{p}twin"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).withColumn(twin, F.xxhash64(F.lit(1), "doc_id", "text"))
    found = ngram_join.near_duplicates(keyed.select(key, "text"), doc_id=key).select(F.col("doc_id").alias(key), F.col("component_id").alias(f"{p}c"))
    ids = keyed.select(key, F.col("doc_id").alias(f"{p}id")).join(found.distinct(), key)
    best = ids.groupBy(f"{p}c").agg(F.min(F.struct(F.col(f"{p}id").isNull(), f"{p}id", key)).alias("b"))
    keep = stored(best.select(F.col(f"b.{key}").alias(key)).distinct(), "kept")
    kept = keyed.join(by_size(keep, keep.count(), 1_000_000), key, "left_semi")
    repeated = stored(kept.groupBy(key, twin).count().where("count > 1").select(key, twin), "repeated")
    n = repeated.count()
    if not n:
        return kept.drop(key, twin)
    few = by_size(repeated, n, 1_000_000)
    once = kept.join(few, [key, twin], "left_semi").groupBy(key, twin).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(f"{p}row"))
    return kept.join(few, [key, twin], "left_anti").drop(key, twin).unionByName(once.select(f"{p}row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return template_decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands as many times as the mix takes it, not at all if it doesn't.

    A document without words adds none to any source and is not part of the mix.
    """
    sized = stored(mixing.sizes_of(docs, F.array(F.col("source").cast("string"))), "sized")
    taken, _ = mixing.mix(sized)
    p = unused_prefix(docs.columns)
    times = taken.where("taken > 0").select("doc_id", "place", (F.col("taken") / F.col("size")).cast("int").alias(f"{p}times")).dropDuplicates(["doc_id", "place"])
    times = times.select(F.col("doc_id").alias(f"{p}id"), F.col("place").alias(f"{p}at"), f"{p}times")
    placed = docs.withColumn(f"{p}place", mixing.place_of(F.col("doc_id"), F.col("text")))
    joined = placed.join(times, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}place") == F.col(f"{p}at")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), f"{p}times")).alias(f"{p}copy")).drop(f"{p}copy")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.encode_corpus(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
