"""Append-only logs: metrics, tails, failure runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def endpoint_metrics(log: DataFrame, endpoint: str, is_error, with_live=None) -> DataFrame:
    """endpoint, n, errors, with_live of a request log."""
    live = F.count_if(with_live) if with_live is not None else F.lit(0).cast("long")
    return log.groupBy(F.col(endpoint).alias("endpoint")).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"), live.alias("with_live"))


def tumbling_limit(log: DataFrame, client: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """client, window_start, n, admitted, rejected of fixed clock windows (0: no limit). The exact
    limiter, whose windows begin at a client's first request, is a streaming operator."""
    w = F.window(ts, f"{seconds} seconds")
    counts = log.groupBy(F.col(client).alias("client"), w.alias("w")).agg(F.count("*").alias("n"))
    admitted = F.least("n", F.lit(limit)) if limit > 0 else F.col("n")
    return counts.select("client", F.col("w.start").alias("window_start"), "n", admitted.alias("admitted"), (F.col("n") - admitted).alias("rejected"))


def failure_runs(calls: DataFrame, key: str, seq: list[str], failed, threshold: int) -> DataFrame:
    """key, run, length, opens: runs of consecutive failures, and whether they reach the
    threshold at which a breaker opens."""
    w = Window.partitionBy(key).orderBy(*seq)
    marked = calls.withColumn("_f", failed.cast("int"))
    runs = marked.withColumn("run", F.sum(1 - F.col("_f")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f = 1")
    return runs.groupBy(key, "run").agg(F.count("*").alias("length")).withColumn("opens", F.col("length") >= threshold)


def tail(log: DataFrame, seq: str, n: int) -> DataFrame:
    """The ``n`` newest rows."""
    return log.orderBy(F.desc(seq)).limit(n)


def last_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation, with their place from the newest."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def conversation_prompt(turns: DataFrame, n: int = 6) -> DataFrame:
    """conv_id, prompt: the last turns, oldest first, a line each."""
    rows = last_turns(turns, n=n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("prompt"))


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines at ``path``, with the time as ``ts`` unless they have one."""
    stamped = entries if "ts" in entries.columns else entries.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    stamped.write.mode("append").json(path)


def recent_audit(spark: SparkSession, path: str, schema: str, n: int = 50) -> DataFrame:
    """The ``n`` newest entries at ``path`` (a file or a folder of JSON lines), newest first, with
    their place: those among the last 2n lines that are JSON objects. Nothing if there is no log."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], f"place int, {schema}")
    placed = lines.select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    last = placed.orderBy(F.desc("t"), F.desc("f"), F.desc("i")).limit(2 * n)
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(F.trim("value"))).startswith("OBJECT"), F.lit(False))
    rank = F.row_number().over(Window.orderBy(F.desc("t"), F.desc("f"), F.desc("i")))  # 2n rows at most
    found = last.where(good).select(rank.alias("place"), F.from_json("value", schema).alias("e"))
    return found.where(F.col("place") <= n).select("place", "e.*")
