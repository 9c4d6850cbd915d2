"""Benchmark decontamination by canonical templates.

Words become template tokens: numbers, units after numbers, and capitalised words inside a
sentence are replaced by typed placeholders, all else is lower-cased without marks around it.
Windows of eight tokens of documents and benchmark items are hash-joined. Matches of one item
on one alignment must agree in their slots: equal values stand for equal values throughout, in
both directions. So a question asked again with other numbers or names is found, and chance
matches of placeholders are not. Windows of plain lower-cased words are joined beside them, for
items of any length and however few of their words are literal, so that verbatim copies are
found whatever the placeholders are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _K1, by_size, lean, lowered, mix, slices, small_batches, span_hashes, stored, text_buffer, unused_prefix, window_hashes, word_spans

WINDOW = 8
#: Items of fewer words than a window are matched whole; below this many words only verbatim.
LEAST_WORDS = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Literal tokens that a window of templates must have; verbatim windows need none.
LITERALS = 4
#: An item whose windows all have fewer literals is searched whole, if it has so many different ones,
#: or one less and so many words: all its windows with a literal must then be found in a row.
WHOLE_LITERALS, WHOLE_WORDS = 3, 12
#: Kinds of windows: templates, plain words, and templates of items that are searched whole.
TEMPLATE, VERBATIM, WHOLE = 0, 1, 2
#: Up to so many benchmark windows are sent to all workers, which then emit matching windows
#: only; for more, all windows are shuffled.
BROADCAST_WINDOWS = 2_000_000
_PIECE = 2 << 20
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms day days week weeks month months year years hour hours "
    "minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams "
    "kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees"
).split()
#: Words that open a sentence with a capital and are no names, wherever they stand.
OPENERS = (
    "a an the this that these those what which who whom whose when where why how if in on at for from of to by with as and or but "
    "is are was were do does did can could will would should has have had he she it they we you i there then each every all some let"
).split()
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?'\"()[]$")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMBER = _DIGIT.copy()
_NUMBER[list(b".,:/%+-")] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True


def _text_hash(words: list[str]) -> np.ndarray:
    data, offsets = text_buffer(pa.array(words))
    return span_hashes(data, offsets[:-1], offsets[1:])


_UNIT_HASHES, _OPENER_HASHES = np.sort(_text_hash(UNITS)), np.sort(_text_hash(OPENERS))
_VERBATIM, _WHOLE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_NUM, _NAME, _UNIT = _text_hash(["\x00number", "\x00name", "\x00unit"])


def _lower(data: np.ndarray) -> np.ndarray:
    """All letters small; the bytes as they are if that would change their number."""
    if not (data >= 0x80).any():
        return lowered(data)
    low = np.frombuffer(pc.utf8_lower(pa.array([data.tobytes().decode("utf-8", "replace")])).buffers()[2], np.uint8)
    return low if len(low) == len(data) else lowered(data)


def templates(data: np.ndarray, offsets: np.ndarray):
    """(first word of each text, template token of each word, is a slot, value of each word, may
    be a name that opens a sentence)."""
    starts, ends, first = word_spans(data, offsets)
    low = _lower(data)
    if not len(starts):
        return first, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, bool)
    sums = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int32)))
    new_line = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))
    opens = np.ones(len(starts), bool)
    opens[1:] = _STOP[data[ends[:-1] - 1]] | (new_line[starts[1:]] > new_line[ends[:-1]])
    opens[first[:-1][first[:-1] < len(starts)]] = True
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        a += (b - a > 1) & _EDGE[data[a]]
        b -= (b - a > 1) & _EDGE[data[b - 1]]
    values = span_hashes(low, a, b)
    same = low == data
    digit, number, small = sums(_DIGIT[data]), sums(_NUMBER[data]), sums(_SMALL[data] | (_INNER[data] & same))
    capital = _CAPITAL[data[a]] | ((data[a] >= 0xC3) & ~same[np.minimum(a + 1, len(data) - 1)])
    is_number = (digit[b] > digit[a]) & (number[b] - number[a] == b - a)
    after = np.zeros(len(starts), bool)
    after[1:] = is_number[:-1]
    after[first[:-1][first[:-1] < len(starts)]] = False
    is_unit = after & ~is_number & np.isin(values, _UNIT_HASHES)
    may_name = capital & (small[b] > small[a]) & ~is_unit & ~is_number
    may_name &= ~np.isin(values, _OPENER_HASHES)
    is_name = may_name & ~opens
    tokens = values.copy()
    tokens[is_number], tokens[is_unit], tokens[is_name] = _NUM, _UNIT, _NAME
    return first, tokens, is_number | is_unit | is_name, values, may_name & opens


def _named_hashes(tokens: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """:func:`window_hashes` at ``at`` as if the first token of each window were a name."""
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = mix((h * _K1) ^ (tokens[at + k] if k else _NAME))
    return h


_ROWS = "id long, digest long, pos int, size int, hash long, kind int, slots array<long>"


def windows(texts: DataFrame, sizes: list[int], whole: bool, wanted: np.ndarray | None = None, with_whole: bool = True) -> DataFrame:
    """Windows of the texts (id, digest, text): id, digest, pos, size, hash, kind, and the values of
    the slots unless it is of plain words. ``whole``: a text shorter than WINDOW gives windows
    of its own size; else windows of all ``sizes`` are made. A word that opens a sentence with a
    capital stands both as a literal and as a name at the start of a window. With ``wanted``
    (sorted), only hashes in it are emitted; those of items searched whole unless not ``with_whole``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j in slices(offsets, _PIECE):
                part = data[offsets[i] : offsets[j]]
                first, tokens, slot, values, opening = templates(part, offsets[i : j + 1] - offsets[i])
                n = np.diff(first)
                doc_of = np.repeat(np.arange(j - i), n)
                place = np.arange(len(tokens)) - first[doc_of]
                before = np.concatenate(([0], np.cumsum(slot)))
                if whole:
                    different = np.unique(np.stack((doc_of[~slot].astype(np.uint64), tokens[~slot])), axis=1)[0]
                    literal = np.bincount(different.astype(np.int64), minlength=j - i)
                    enough = literal >= np.where(n >= WHOLE_WORDS, WHOLE_LITERALS - 1, WHOLE_LITERALS)

                def emit(size, at, h, kind, named=False):
                    if wanted is not None:
                        if not len(wanted):
                            return
                        keep = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                        at, h = at[keep], h[keep]
                    if kind == VERBATIM and size < WINDOW and len(at):  # a whole item: once for each text
                        keep = np.sort(np.unique(np.stack((doc_of[at].astype(np.uint64), h)), axis=1, return_index=True)[1])
                        at, h = at[keep], h[keep]
                    if not len(at):
                        return
                    if kind == VERBATIM:
                        slots = pa.array([[]] * len(at), pa.list_(pa.int64()))
                    else:
                        is_slot = lambda k: np.concatenate(([True], slot[k + 1 : k + size])) if named else slot[k : k + size]
                        slots = pa.array([values[k : k + size][is_slot(k)].view(np.int64) for k in at.tolist()], pa.list_(pa.int64()))
                    take = pa.array(doc_of[at] + i)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take), batch.column(1).take(take), pa.array(place[at].astype(np.int32)), pa.array(np.full(len(at), size, np.int32)),
                            pa.array(h.view(np.int64)), pa.array(np.full(len(at), kind, np.int32)), slots,
                        ],
                        names=["id", "digest", "pos", "size", "hash", "kind", "slots"],
                    )

                for size in sizes:
                    if len(tokens) < size:
                        continue
                    at = np.arange(len(tokens) - size + 1)
                    fits = place[at] + size <= n[doc_of[at]]
                    if whole and size < WINDOW:
                        fits &= n[doc_of[at]] == size
                    of = np.flatnonzero(fits)
                    yield from emit(size, of, mix(window_hashes(values, size)[of] ^ _VERBATIM), VERBATIM)
                    if size < LEAST_WORDS:
                        continue
                    literals = size - (before[at + size] - before[at])
                    hashes = window_hashes(tokens, size)
                    of = np.flatnonzero(fits & (literals >= LITERALS))
                    yield from emit(size, of, hashes[of], TEMPLATE)
                    of = np.flatnonzero(fits & opening[at] & (literals > LITERALS))
                    yield from emit(size, of, _named_hashes(tokens, of, size), TEMPLATE, True)
                    if not with_whole:
                        continue
                    some = fits & (literals > 0)
                    if whole:  # items without a window of enough literals, but with enough of them in all
                        dense = np.zeros(j - i, bool)
                        dense[doc_of[at[fits & (literals >= LITERALS)]]] = True
                        some &= ~dense[doc_of[at]] & enough[doc_of[at]]
                    of = np.flatnonzero(some)
                    yield from emit(size, of, mix(hashes[of] ^ _WHOLE), WHOLE)

    return texts.select("id", "digest", "text").mapInArrow(lean(rows), _ROWS)


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    text_ = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(text_).alias("digest"), text_.alias("text"))


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Contaminated documents: doc_id, digest (of the text), item_id, kind (``exact``, or
    ``template`` if slots changed), n_windows of the item, n_matched of them, n_changed slot
    values; one row for each document and item.

    An item is held if ``coverage`` of its template windows match, or of its windows of plain
    words, or if all have too few literals and all of them match in a row; the
    figures are of that with fewer changes, the templates first. Items of one word
    or more are searched. Null texts are empty and contain nothing; null ids are ids like
    others; repeated rows of a document give one row; items repeated with the same id and text
    count once; other columns are ignored; without documents or items there are no rows. A
    benchmark passage that a third of all documents hold is joined where the documents lie
    while the benchmark is small.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = _identified(items, item_id, text).distinct()
    every = list(range(1, WINDOW + 1))
    bench = stored(windows(items, every, whole=True), "bench")
    n = bench.count()
    sizes = sorted(r.size for r in bench.select("size").distinct().collect())
    wanted = None
    if n <= BROADCAST_WINDOWS:
        wanted = np.unique(bench.select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
    with_whole = not bench.where(F.col("kind") == WHOLE).isEmpty()
    found = windows(_identified(docs, doc_id, text), sizes, whole=False, wanted=wanted, with_whole=with_whole)
    total = bench.groupBy("id", "digest", "kind").agg(F.count_distinct("pos").alias("n_windows")).toDF("item", "item_digest", "kind", "n_windows")
    b = bench.select(F.col("id").alias("item"), F.col("digest").alias("item_digest"), F.col("pos").alias("item_pos"), "size", "hash", "kind", F.col("slots").alias("item_slots"))
    pairs = found.join(by_size(b, n, BROADCAST_WINDOWS // 10), ["hash", "size", "kind"])
    pairs = pairs.withColumn("slots", F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")))
    key = ["id", "digest", "item", "item_digest", "kind"]
    aligned = pairs.groupBy(*key, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")
    )
    side = lambda c: F.size(F.array_distinct(F.transform("slots", lambda s: s[c])))
    consistent = aligned.where((F.size("slots") == side("b")) & (F.size("slots") == side("d")))
    changed = F.size(F.filter("slots", lambda s: s["b"] != s["d"]))
    consistent = consistent.withColumn("changed", changed)
    held = consistent.groupBy(*key).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_anywhere"), F.max(F.size("at")).alias("n_row"), F.min("changed").alias("n_changed")
    )
    held = held.withColumn("n_matched", F.when(F.col("kind") == WHOLE, F.col("n_row")).otherwise(F.col("n_anywhere")))
    held = held.alias("h").join(
        by_size(total, n, BROADCAST_WINDOWS // 10).alias("t"),
        F.col("h.item").eqNullSafe(F.col("t.item")) & (F.col("h.item_digest") == F.col("t.item_digest")) & (F.col("h.kind") == F.col("t.kind")),
    )
    share = F.when(F.col("h.kind") == WHOLE, 1.0).otherwise(coverage)
    out = held.where(F.col("n_matched") >= share * F.col("n_windows"))
    best = F.min(F.struct(F.col("n_changed"), F.col("h.kind").alias("kind"), F.col("n_windows"), F.col("n_matched"))).alias("x")
    out = out.groupBy("id", "digest", F.col("h.item").alias("item_id"), F.col("h.item_digest")).agg(best)
    return out.select(
        F.col("id").alias("doc_id"), "digest", "item_id", F.when(F.col("x.n_changed") > 0, "template").otherwise("exact").alias("kind"),
        F.col("x.n_windows").alias("n_windows"), F.col("x.n_matched").cast("long").alias("n_matched"), F.col("x.n_changed").cast("long").alias("n_changed"),
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds a benchmark item."""
    p = unused_prefix(docs.columns)
    leaks = stored(find_leaks(docs, items).select(F.col("doc_id").alias(f"{p}id"), F.col("digest").alias(f"{p}digest")).distinct(), "leaks")
    own = docs.withColumn(f"{p}own", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    few = by_size(leaks, leaks.count(), 1_000_000)
    return own.join(few, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}own") == F.col(f"{p}digest")), "left_anti").drop(f"{p}own")
