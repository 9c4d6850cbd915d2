"""Repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``LENGTH`` bytes: its window. Windows are sorted by
most-significant-digit passes over their leading bytes: by bytes 0 to 31, then to 127, to 255 and
to 399. After each pass only windows stay whose group has two or more; the groups of the last
pass are exactly the repeated windows, and every byte of them is removed.

One row for each byte of the corpus would be many times the corpus, so ranges of windows are
settled before the passes wherever that is possible without a row for each:

1. Neighbouring windows with the same anchor (the least hash among their 32-byte grams, the
   leftmost of equals) form a run, one row. A run whose anchor gram occurs once is unique.
2. Runs that agree in anchor gram and whole extent repeat in full.
3. Other runs are cut into blocks of 16 windows at the same distance from the anchor. A block
   whose common part occurs once is unique; blocks that agree in their whole extent repeat in
   full. One run or block of each settled group stays, so that open ones can meet it.

Only windows of open blocks go through the passes. Each count is by fingerprint, summed on the
map side, so a passage that a third of all documents hold is one row a task; rows are matched to
counts by a join that Spark may split. Bytes are removed only where two 64-bit fingerprints agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import S29, by_size, lean, mix, slices, small_batches, stored, text_buffer

LENGTH, GRAM, BLOCK = 400, 32, 16
#: Bytes that are hashed at once; documents beyond it are taken in pieces.
PIECE = 1 << 20
BROADCAST_ROWS = 1_000_000
#: Leading bytes that each pass sorts by; the last one is all of a window.
DEPTHS = (32, 128, 256, 400)
#: Spans of so many starts of a document are merged before all spans of it come together.
MERGED = 1 << 14
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = [mix(np.array([k + 1000], np.uint64))[0] | np.uint64(1) for k in range(8)]
_PLACE = np.uint64((1 << 24) - 1)


def _hashes(data: np.ndarray, span: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of 32, 128 and ``span`` (a power of two up to 256) bytes."""
    h, out, n = _BYTE[data], {}, 1
    for k in range(8):
        if n == span or len(h) <= n:
            break
        h = h[:-n] * _STEP[k] + h[n:]
        h ^= h >> S29
        n *= 2
        if n in (GRAM, 128, span):
            out[n] = h
    return out


def _print(h256: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of strings of 256 to 768 bytes: three blocks of 256 cover each."""
    last = starts + lengths - 256
    h = mix(h256[starts] ^ lengths.astype(np.uint64))
    h = mix(h * _STEP[0] + h256[(starts + last) // 2])
    return mix(h * _STEP[1] + h256[last])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _runs_in(data: np.ndarray, valid: np.ndarray | None = None):
    """(first window, last window, anchor, anchor hash, fingerprint) of the runs in ``data``."""
    h = _hashes(data, 256)
    gram = h[GRAM]
    packed = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_sliding_least(packed, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    if valid is not None:  # windows that cross texts
        edges = np.flatnonzero(np.diff(valid.view(np.int8))) + 1
        cut = np.union1d(cut, edges)
    p1 = np.concatenate(([0], cut)).astype(np.int64)
    p2 = np.concatenate((cut, [len(anchor)])).astype(np.int64) - 1
    if valid is not None:
        keep = valid[p1]
        p1, p2 = p1[keep], p2[keep]
    a = anchor[p1]
    whole = mix(_print(h[256], p1, p2 - p1 + LENGTH) + (a - p1).astype(np.uint64))
    return p1, p2, a, mix(gram[a]), whole


def _runs_of_long(data: np.ndarray):
    """The same over a long text, in pieces that end where runs end."""
    out, at = [], 0
    while at + LENGTH <= len(data):
        piece = data[at : at + PIECE + LENGTH]
        p1, p2, a, g, w = _runs_in(piece)
        last = at + len(piece) >= len(data)
        if not last and len(p1) > 1:
            step, p1, p2, a, g, w = int(p1[-1]), p1[:-1], p2[:-1], a[:-1], g[:-1], w[:-1]
        out.append((p1 + at, p2 + at, a + at, g, w))
        if last:
            break
        at += step
    return [np.concatenate(x) for x in zip(*out, strict=True)]


_RUNS = "doc_id long, digest long, p1 int, p2 int, a int, gram long, whole long"


def runs(docs: DataFrame) -> DataFrame:
    """The runs of all windows of ``docs`` (doc_id, digest, text)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in slices(offsets, PIECE):
                start = offsets[i]
                part, inner = data[start : offsets[j]], offsets[i : j + 1] - start
                if j == i + 1:
                    if len(part) < LENGTH:
                        continue
                    p1, p2, a, g, w = _runs_of_long(part)
                    doc = np.zeros(len(p1), np.int64)
                else:
                    if len(part) < LENGTH:
                        continue
                    n = len(part) - LENGTH + 1
                    mark = np.zeros(n + 1, np.int32)
                    ends = np.maximum(inner[1:] - LENGTH + 1, inner[:-1])
                    np.add.at(mark, np.minimum(inner[:-1], n), 1)
                    np.add.at(mark, np.minimum(ends, n), -1)
                    valid = np.cumsum(mark)[:-1] > 0
                    p1, p2, a, g, w = _runs_in(part, valid)
                    # runs of two texts may touch only if the first ends where the second starts
                    doc = np.searchsorted(inner, p1, side="right") - 1
                    base = inner[doc]
                    p1, p2, a = p1 - base, p2 - base, a - base
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x.astype(np.int32)) for x in (p1, p2, a)), pa.array(g.view(np.int64)), pa.array(w.view(np.int64))],
                    names=["doc_id", "digest", "p1", "p2", "a", "gram", "whole"],
                )

    return docs.select("doc_id", "digest", "text").mapInArrow(lean(rows), _RUNS)


def _prints_at(data: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Fingerprints of the strings of these lengths at ``starts``, hashed piece by piece."""
    out = [np.zeros(len(starts), np.uint64) for _ in lengths]
    order = np.argsort(starts, kind="stable")
    s, at = starts[order], 0
    while at < len(s):
        base = s[at]
        end = int(np.searchsorted(s, base + PIECE, side="right"))
        h = _hashes(data[base : s[end - 1] + max(lengths)], 256)
        for o, n in zip(out, lengths, strict=True):
            own = s[at:end] - base
            o[order[at:end]] = mix(h[n][own]) if n in h else _print(h[256], own, np.full(end - at, n))
        at = end
    return out


def _print_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return _prints_at(data, starts, (length,))[0]


_BLOCKS = "doc_id long, digest long, lo int, hi int, part long, extent long"
_DIGITS = [f"to_{d}" for d in DEPTHS]
_WINDOWS = "doc_id long, digest long, p int, " + ", ".join(f"{d} long" for d in _DIGITS)


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text, runs) to blocks: windows lo to hi, the part that all windows of
    the full block share, and the full block's extent (null where the text is too short for it)."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            p1, p2, a = (np.array([r[k] for r in batch.column(3)[i].as_py()], np.int64) for k in ("p1", "p2", "a"))
            j1, j2 = (a - p2) // BLOCK, (a - p1) // BLOCK
            n = j2 - j1 + 1
            run = np.repeat(np.arange(len(n)), n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + j1[run]
            first, last = a[run] - BLOCK * j - BLOCK + 1, a[run] - BLOCK * j
            part = mix(_print_at(text, last, LENGTH - BLOCK + 1) + j.astype(np.uint64))
            inside = (first >= 0) & (last + LENGTH <= len(text))
            extent = np.zeros(len(j), np.uint64)
            extent[inside] = _print_at(text, first[inside], LENGTH + BLOCK - 1)
            extent = mix(extent + j.astype(np.uint64))
            take = pa.array(np.full(len(j), i))
            lo, hi = np.maximum(first, p1[run]), np.minimum(last, p2[run])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(part.view(np.int64)), pa.array(extent.view(np.int64), mask=~inside)],
                names=["doc_id", "digest", "lo", "hi", "part", "extent"],
            )


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text, blocks) to single windows and the fingerprints of their leading bytes."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            lo, hi = (np.array([r[k] for r in batch.column(3)[i].as_py()], np.int64) for k in ("lo", "hi"))
            n = hi - lo + 1
            p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            take = pa.array(np.full(len(p), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(p.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in _prints_at(text, p, DEPTHS))],
                names=["doc_id", "digest", "p", *_DIGITS],
            )


def _repeated(df: DataFrame, *columns: str) -> DataFrame:
    """Values of ``columns`` that two or more rows have, to be joined by these columns."""
    found = df.where(F.col(columns[-1]).isNotNull()).groupBy(*columns).count().where("count > 1").select(*columns)
    found = stored(found, f"repeated-{columns[-1]}")
    return by_size(found, found.count(), BROADCAST_ROWS)


def _witnesses(settled: DataFrame, opened: DataFrame, group: str, key: str) -> DataFrame:
    """One row of each ``key`` of the ``settled`` rows, where open rows have the same ``group``."""
    groups = stored(opened.select(group).distinct(), f"open-{group}")
    return settled.dropDuplicates([group, key]).join(by_size(groups, groups.count(), BROADCAST_ROWS), group, "left_semi")


_KEY = ["doc_id", "digest"]


def _with_text(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """doc_id, digest, text and the list of the rows that belong to each document. Only texts
    that have rows are moved. Rows of repeated documents were made once for each of them, so
    each value is kept with its number of times by the copies of the text."""
    lists = stored(rows.groupBy(*_KEY).agg(F.collect_set(F.struct(*columns)).alias("list")), "lists")
    keys = lists.select(*_KEY)
    own = docs.join(by_size(keys, keys.count(), BROADCAST_ROWS), _KEY, "left_semi")
    return own.join(lists, _KEY).select("doc_id", "digest", "text", "list")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, spans (start, end) of all repeated windows of ``docs`` (doc_id not null,
    digest, text), one row for each row of a decided run, block or window."""
    all_runs = stored(runs(docs), "runs")
    some = stored(all_runs.join(_repeated(all_runs, "gram"), "gram", "left_semi"), "anchored")
    same = ["gram", "whole"]
    wholes = _repeated(some, *same)
    settled, open_runs = some.join(wholes, same, "left_semi"), some.join(wholes, same, "left_anti")
    # spans are written as they are found: a plan that still held all joins would broadcast all their counts at once
    full = stored(settled.select(*_KEY, F.col("p1").alias("lo"), F.col("p2").alias("hi")), "full")
    own = [*_KEY, "p1", "p2", "a"]
    open_runs = open_runs.select(*own).union(_witnesses(settled, open_runs, "gram", "whole").select(*own))
    texts = stored(_with_text(docs, open_runs, "p1", "p2", "a"), "texts")
    blocks = stored(texts.mapInArrow(lean(_block_rows), _BLOCKS), "blocks")
    alive = stored(blocks.join(_repeated(blocks, "part"), "part", "left_semi"), "alive")
    same = ["part", "extent"]
    extents = _repeated(alive, *same)
    settled, open_blocks = alive.join(extents, same, "left_semi"), alive.join(extents, same, "left_anti")
    whole_blocks = stored(settled.select(*_KEY, "lo", "hi"), "whole-blocks")
    own = [*_KEY, "lo", "hi"]
    open_blocks = open_blocks.select(*own).union(_witnesses(settled, open_blocks, "part", "extent").select(*own))
    windows = stored(_with_text(texts.select(*_KEY, "text"), open_blocks, "lo", "hi").mapInArrow(lean(_window_rows), _WINDOWS), "windows")
    for k in range(len(_DIGITS)):  # most significant digit first; a group is known by all bytes so far
        group = _DIGITS[max(0, k - 1) : k + 1]
        windows = windows.join(_repeated(windows, *group), group, "left_semi")
        if k == 1:  # with the digits that later passes read
            windows = stored(windows.select(*_KEY, "p", *_DIGITS[k:]), "passed")
    single = windows.select(*_KEY, F.col("p").alias("lo"), F.col("p").alias("hi"))
    return full.union(whole_blocks).union(single).select(*_KEY, F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal spans of overlapping or touching ones."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _merged_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, spans) to (doc_id, digest, start, end) of the maximal spans of each list."""
    for batch in batches:
        lists = [merged([s["start"] for s in own], [s["end"] for s in own]) for own in batch.column(2).to_pylist()]
        take = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        flat = np.array([s for x in lists for s in x], np.int32).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc_id", "digest", "start", "end"])


def _kept_rows(with_text: bool):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                own = batch.column(2)[i].as_py() or []
                spans = merged([s["start"] for s in own], [s["end"] for s in own])
                at, kept = 0, []
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                rest = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            n = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:n]], names=["doc_id", *names[:n]])

    return rows


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left, if asked).

    Texts are bytes in UTF-8; null and empty texts have none; a text shorter than ``LENGTH``
    has no window and stays whole. Repeated rows are documents like others, so they remove each
    other's windows; null doc_ids stay null; other columns are ignored; an empty table gives no
    rows. Strings are judged on the input, not on what is left.
    """
    small_batches(docs.sparkSession)
    text_ = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("given"), F.xxhash64(text_, F.col(f"`{doc_id}`")).alias("digest"), text_.alias("text"))
    own = own.withColumn("doc_id", F.coalesce("given", F.lit(0)))
    spans = repeated_spans(own.select("doc_id", "digest", "text"))
    # first the spans of a part of a document, a bounded number, then the few that are left of each part
    listed = F.collect_set(F.struct("start", "end")).alias("spans")
    parts = spans.groupBy(*_KEY, F.floor(F.col("start") / MERGED).alias("part")).agg(listed).select(*_KEY, "spans")
    parts = parts.mapInArrow(lean(_merged_rows), "doc_id long, digest long, start int, end int")
    lists = parts.groupBy(*_KEY).agg(listed)
    whole = own.join(lists, _KEY, "left").select(F.col("given").alias("doc_id"), "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return whole.mapInArrow(lean(_kept_rows(with_text)), schema)
