"""Secret scanning over a ledger of content-addressed blobs.

Every historical version of a text is addressed by the SHA-256 of its bytes. A scan looks at
each (blob, rule version) pair that the ledger lacks exactly once, appends what it finds to
the ledger, and joins the ledger back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_size, fresh_path, lean, small_batches, stored

A = re.ASCII
#: Base kinds in order: pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: Kinds that this method adds to the base, listed after it.
ADDED = (
    # header lines, blanks and escaped line breaks may stand inside a key
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\r\n\\])*+|[A-Za-z0-9+/=]++|\s|\\+[nrt/])++-----END [A-Z ]*PRIVATE KEY-----"), 0, 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", A), 0, 30),
    ("forge", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]+|glpat-[A-Za-z0-9_-]+|xox[abprs]-[A-Za-z0-9-]+)", A), 0, 20),
    # its match starts at the separator; find_spans adds the scheme before it
    ("login", re.compile(r"://[^\s/:@]+:([^\s/@]+)@"), 1, 6),
)
_SCHEME = re.compile(r"\b[a-z][a-z0-9+.]+", A)
_IN_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.")
RULES = (*BASE, *ADDED)
#: Changes whenever a rule does, so that old blobs are scanned again under new rules.
RULE_VERSION = hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, p, g, n in RULES] + [_SCHEME.pattern]).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, kinds array<string>, starts array<int>, ends array<int>"
_SCHEMA = pa.schema([
    ("blob", pa.string()), ("rule_version", pa.string()), ("kinds", pa.list_(pa.string())),
    ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
])


def find_spans(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind whose
    counted group is long enough, by start, then in the order of the kinds. The scheme of a
    login is looked for backwards from its separator, so long dotted runs are read once."""
    out = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                start = m.start()
                if kind == "login":
                    while start and text[start - 1] in _IN_SCHEME:
                        start -= 1
                    scheme = _SCHEME.search(text, start, m.start())
                    if not scheme:
                        continue
                    start = scheme.start()
                out.append((start, order, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(out)]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(blob, find_spans(text or "")) for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _ in rows], pa.string()),
                pa.array([RULE_VERSION] * len(rows), pa.string()),
                pa.array([[k for k, _, _ in s] for _, s in rows], pa.list_(pa.string())),
                pa.array([[a for _, a, _ in s] for _, s in rows], pa.list_(pa.int32())),
                pa.array([[e for _, _, e in s] for _, s in rows], pa.list_(pa.int32())),
            ],
            schema=_SCHEMA,
        )


#: Blobs with findings, up to so many, are broadcast to the paths.
BROADCAST_HITS = 100_000


def blob_of(text: str = "text"):
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty before the first scan."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan_new(versions: DataFrame, ledger: str, path: str = "path", text: str = "text") -> int:
    """Scan the blobs of ``versions`` that the ledger does not have under the present rules
    and append their findings (an empty list too); return how many were scanned.

    One row of each new blob carries its text to the scan. The carrier is chosen by an
    aggregate of (blob, smallest path) and found again by path and blob, so a blob that a
    third of all rows share never meets in one task. A ledger row is written by a Spark job
    commit: a lost executor or a failed scan leaves the ledger as it was.
    """
    spark = versions.sparkSession
    small_batches(spark)
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == RULE_VERSION).select("blob")
    at = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("at")
    own = versions.select(at, blob_of(text).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    carriers = stored(
        own.groupBy("blob").agg(F.min("at").alias("at")).join(seen, "blob", "left_anti"), "carriers"
    )
    n = carriers.count()
    if n:
        texts = own.join(carriers, ["at", "blob"], "left_semi").select("blob", "text")
        found = texts.mapInArrow(lean(_scan), LEDGER)
        # rows that repeat both path and blob were scanned alike; keep one
        found.dropDuplicates(["blob", "rule_version"]).write.mode("append").parquet(ledger)
    return n


def findings(versions: DataFrame, ledger: str, path: str = "path", text: str = "text", scanned: bool = False) -> DataFrame:
    """Every row's path with its blob and the blob's findings under the present rules; null for a
    blob that the ledger doesn't have. ``scanned`` says that it has all of them: then only the
    blobs that hold something are joined, which are few, and the others get empty lists."""
    known = read_ledger(versions.sparkSession, ledger).where(F.col("rule_version") == RULE_VERSION)
    own = versions.select(F.col(f"`{path}`").alias("path"), blob_of(text).alias("blob"))
    if not scanned:
        return own.join(known.dropDuplicates(["blob"]), "blob", "left")
    hits = stored(known.where(F.size("kinds") > 0).dropDuplicates(["blob"]).drop("rule_version"), "hits")
    joined = own.join(by_size(hits, hits.count(), BROADCAST_HITS), "blob", "left")
    lists = (F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("kinds", "starts", "ends"))
    return joined.select("blob", "path", F.lit(RULE_VERSION).alias("rule_version"), *lists)


def scan(versions: DataFrame, ledger: str | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``versions`` (rows of path and text) and return path,
    blob, rule_version, kinds, starts and ends for every row.

    Null texts are empty and have no findings; null paths stay null; repeated rows stay
    repeated; other columns are ignored, whatever their names; an empty table gives none.
    ``ledger`` is a folder kept between runs; without one, a fresh ledger is used.
    """
    ledger = ledger or fresh_path(versions.sparkSession, "ledger")
    versions = versions.select(F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text"))
    scan_new(versions, ledger)
    return findings(versions, ledger, scanned=True)
