"""URL filtering by host-suffix and path-prefix expressions, with DataFrame functions only.

Each URL is expanded into the expressions a rule could have: its host suffixes joined with
its path prefixes. Expressions are matched to rules by an equi-join on a short prefix of
their SHA-256 digest; a match is confirmed by the full digest, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_size, stored, unused_prefix

#: (verdict, host, path)
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hexadecimal digits of the digest that the join compares.
SHORT = 8
#: Rules up to this many are broadcast; more are shuffled.
BROADCAST_RULES = 1_000_000
#: Addresses that a rule fits, with that rule; more are shuffled.
BROADCAST_ADDRESSES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
    from there to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = BASE_RULES) -> DataFrame:
    """Rules as a table: rule_verdict, rule, labels, path_length, digest, short."""
    rows = [(v, h, p) for v, h, p in rules]
    df = spark.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string")
    return rules_of(df)


def rules_of(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256)
    return df.select(
        "rule_verdict",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length("rule_path").alias("path_length"),
        digest.alias("digest"),
        F.substring(digest, 1, SHORT).alias("short"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added (replacing columns of these names).

    ``rules`` comes from :func:`rule_table`. The longest fitting rule decides (the longer
    path among equals, then ``block`` before ``allow``); without one, ``rule`` is null and the
    verdict ``otherwise``. Equal addresses are judged once, so a host or URL that holds most
    of the rows is expanded once. Null and malformed URLs have an empty host and path, which
    no rule fits; an empty table gives an empty result; repeated rows stay repeated; other
    columns are passed through.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    found = unused_prefix(pages.columns) + "best"
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*own, host.alias("host"), path.alias("path"))
    shape = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.collect_set("labels"), F.array()).alias("labels"),
        F.coalesce(F.collect_set("path_length"), F.array()).alias("lengths"),
    ).first()  # two short lists of small numbers: the shapes that rules have

    parts = F.split("host", r"\.")
    suffixes = F.array(
        *(F.when(F.size("p") >= k, F.array_join(F.slice("p", -k, k), ".")) for k in sorted(shape["labels"]))
    )
    prefixes = F.array(
        *(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape["lengths"]))
    )
    addresses = pages.select("host", "path").distinct()
    if shape["n"]:
        expressions = (
            addresses.withColumn("p", parts)
            .select("host", "path", F.explode(F.array_compact(suffixes)).alias("s"))
            .select("host", "path", "s", F.explode(F.array_compact(prefixes)).alias("x"))
            .withColumn("full", F.sha2(F.concat_ws("\x00", "s", "x"), 256))
            .select("host", "path", "full", F.substring("full", 1, SHORT).alias("short"))
        )
        best = (
            expressions.join(by_size(rules, shape["n"], BROADCAST_RULES), "short")
            .where(F.col("full") == F.col("digest"))
            .groupBy("host", "path")
            .agg(
                F.max(
                    F.struct(
                        F.length("rule").alias("l"), "path_length",
                        (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict",
                    )
                ).alias(found)
            )
        )
        best = stored(best, "best")  # addresses that a rule fits
        judged = pages.join(by_size(best, best.count(), BROADCAST_ADDRESSES), ["host", "path"], "left")
        rule, verdict = F.col(f"{found}.rule"), F.coalesce(f"{found}.rule_verdict", F.lit(otherwise))
    else:
        judged, rule, verdict = pages, F.lit(None).cast("string"), F.lit(otherwise)
    return judged.select(*own, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
