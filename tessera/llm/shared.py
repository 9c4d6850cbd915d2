"""What the corpus operators share: the folder all machines see, tables that cut
lineage, and batch-wise word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of one Arrow batch sent to Python, so that long texts cannot fill a worker.
BATCH_BYTES = 8 << 20
#: Bytes of texts whose words are hashed at once.
SLICE_BYTES = 1 << 20

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local-mode session may leave it unset; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


def unused_prefix(columns: list[str]) -> str:
    """A prefix that none of ``columns`` begins with, in whatever case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later steps do not
    repeat it, and it survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``rows`` for mapInArrow, after which the worker gives freed memory back to the system:
    workers outlive their tasks, and several share an executor's memory with its JVM."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run


def by_size(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` stay within ``most``; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


# ---------------------------------------------------------------- word hashing

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
S32, S29 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on a fresh array."""
    h = h ^ (h >> S32)
    h *= _K2
    h ^= h >> S29
    h *= _K1
    h ^= h >> S32
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls: empty) and where each text starts and ends."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word
    (one more entry at the end). No word spans two texts."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = solid[1:-1][edge]
    last[edge - 1] = solid[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) + _K1)
    at, live = starts, None
    while len(at):
        part = eight[at] & _TAIL[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ part)
            live = np.flatnonzero(left > 8)
        else:
            out[live] = mix(out[live] ^ part)
            live = live[left > 8]
        keep = left > 8
        at, left = at[keep] + 8, left[keep] - 8
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` successive word hashes (windows may cross texts; callers select)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix((h * _K1) ^ words[k : k + m])
    return h


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals become small letters; all other bytes stay."""
    return _LOWER[data]


def shingle_sets(column: pa.Array, n: int = 5):
    """For each text of ``column`` its sorted distinct 64-bit shingle hashes.

    Words are lower-cased in A-Z; a text of fewer than ``n`` words has its whole word
    sequence as one shingle; a text without words has none.
    """
    whole, all_offsets = text_buffer(column)
    for x, y in slices(all_offsets, SLICE_BYTES):
        offsets = all_offsets[x : y + 1] - all_offsets[x]
        data = lowered(whole[all_offsets[x] : all_offsets[y]])
        starts, ends, first = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        windows = window_hashes(words, n)
        for i in range(y - x):
            a, b = first[i], first[i + 1]
            if b - a >= n:
                yield np.unique(windows[a : b - n + 1])
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
