"""Quality rules by distribution divergence.

Two histograms of each document, its character classes and its common words, are compared by
Jensen-Shannon distance with references of its language that are summed over all documents.
A document is kept if both distances are small for its own language or else for another; too
short a document is not judged by a histogram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import _SPACE, lean, lowered, small_batches, span_hashes, stored, text_buffer, window_hashes, word_spans

#: A reference's common words: so many of its most frequent ones, lower-cased in A-Z, without marks around them.
COMMON = 64
#: Words counted at once in a worker.
COUNTED = 1 << 20
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.50
#: Least letters and words for a document to be judged by the histogram of them.
LEAST_CHARS, LEAST_WORDS = 100, 40
#: A language needs so many words over all documents to be a reference; the histograms don't
#: judge documents of a language with fewer.
LEAST_REFERENCE = 1000
#: Base rules: least words, and the most of them (in hundredths) in repeated windows of so many words.
BASE_WORDS, BASE_REPEATED, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Character classes: blank, small letter, capital, digit, closing mark, symbol, lead byte of other letters, rest.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[_SPACE] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(b"#*$%&|<>=@^~_+{}[]\\/`")] = 5
_CLASS[0xC0:] = 6
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False  # a code point has one byte that isn't a continuation
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?'\"()[]")] = True
CLASSES = 8


def _histograms(column: pa.Array):
    """Per text: class counts; per word: a 64-bit hash of it without marks, small; word spans and hashes as they are written."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    classes = np.zeros((len(offsets) - 1, CLASSES), np.int64)
    kinds = _CLASS[data]
    for k in range(CLASSES):
        sums = np.concatenate(([0], np.cumsum((kinds == k) & _LEAD[data], dtype=np.int64)))
        classes[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    a, b = starts.copy(), ends.copy()
    for _ in range(3):  # marks around a word don't belong to it
        a += (b - a > 1) & _EDGE[data[np.minimum(a, len(data) - 1)]] if len(data) else 0
        b -= (b - a > 1) & _EDGE[data[b - 1]] if len(data) else 0
    return data, offsets, starts, ends, first, hashes, classes, span_hashes(lowered(data), a, b)


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, kind (``char`` or ``word``), slot, n: counts of character classes, and of words (slot:
    a hash), of each language, over all documents. Rows without a language belong to none."""
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, np.ndarray, np.ndarray]] = []
        n_held = 0

        def rows():
            of: dict[str, list] = {}
            for g, c, w in held:
                of.setdefault(g, []).append((c, w))
            for g, parts in of.items():
                classes = np.sum([c for c, _ in parts], axis=0)
                words, n = np.unique(np.concatenate([w for _, w in parts]), return_counts=True)
                kinds = np.repeat(["char", "word"], [CLASSES, len(words)])
                slots = np.concatenate((np.arange(CLASSES), words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(slots)), pa.array(kinds), pa.array(slots), pa.array(np.concatenate((classes, n)))], names=["lang", "kind", "slot", "n"])

        for batch in batches:
            *_, first, _, classes, words = _histograms(batch.column(1))
            langs = batch.column(0).to_pylist()
            n = np.diff(first)
            for g in set(langs) - {None}:
                own = np.array([x == g for x in langs])
                held.append((g, classes[own].sum(axis=0), words[np.repeat(own, n)]))
                n_held += len(held[-1][2]) + CLASSES
            if n_held >= COUNTED:
                yield from rows()
                held, n_held = [], 0
        yield from rows()

    own = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = own.mapInArrow(lean(count), "lang string, kind string, slot long, n long")
    return counted.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).where("n > 0")


def collect_references(refs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """language: class shares, hashes of its common words in order, the place of each in the
    histogram, and the shares of the common words and the rest. What comes to the driver is 8 and
    64 numbers for each language that has enough words."""
    refs = stored(refs, "references")
    total = refs.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_REFERENCE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "slot"))
    top = refs.where("kind = 'word'").join(total, "lang").withColumn("k", rank).where(F.col("k") <= COMMON)
    out = {}
    for r in top.orderBy("lang", "k").collect():
        _, words, shares = out.setdefault(r.lang, (np.zeros(CLASSES), [], []))
        words.append(r.slot)
        shares.append(r.n / r.total)
    for r in refs.where("kind = 'char'").join(total, "lang").collect():
        out[r.lang][0][r.slot] = r.n
    done = {}
    for g, (chars, words, shares) in sorted(out.items()):
        hashes = np.array(words, np.int64).view(np.uint64)
        order = np.argsort(hashes)
        common = np.zeros(COMMON + 1)
        common[: len(shares)] = shares
        common[COMMON] = max(0.0, 1 - sum(shares))
        done[g] = (chars / max(chars.sum(), 1), hashes[order], order, common)
    return done


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of each row of counts
    from the reference's shares; 0 for rows without counts."""
    n = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(n, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(n[:, 0] > 0, np.sqrt(np.maximum(0, (a + b) / 2)), 0.0)


def _repeats(text: bytes, words: np.ndarray) -> tuple[int, int]:
    """Repeated lines, and words in windows that occur twice or more."""
    seen, lines = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
        elif line.strip():
            seen.add(line)
    windows = window_hashes(words, WINDOW)
    s = np.sort(windows)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return lines, 0
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows, twice))
    change[at] += 1
    change[at + WINDOW] -= 1  # starts are distinct, and so are ends
    return lines, int((np.cumsum(change)[:-1] > 0).sum())


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, refs: dict, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Base counts, distances and verdict of every row's whole text.

    Null texts count nothing and fail the base rules; a null language is compared with all
    references; for a language without a reference, or with no reference at all, only the base
    rules decide and the distances are 0; repeated rows stay repeated; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def distances(g, classes, words, doc_of_word, n, n_chars):
        shares, known, place, common = refs[g]
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        column = np.where(known[at] == words, place[at], COMMON)
        chars = np.where(n_chars >= LEAST_CHARS, js_distance(classes, shares), 0)
        hist = np.bincount(doc_of_word * (COMMON + 1) + column, minlength=len(n) * (COMMON + 1)).reshape(len(n), COMMON + 1)
        return chars, np.where(n >= LEAST_WORDS, js_distance(hist, common), 0)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, starts, ends, first, hashes, classes, words = _histograms(batch.column(2))
            raw, n = data.tobytes(), np.diff(first)
            docs_n = len(n)
            prefix = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
            solid, symbols = prefix(~_SPACE[data] & _LEAD[data]), prefix(_SYMBOL[data])
            word_chars, n_symbols = (x[offsets[1:]] - x[offsets[:-1]] for x in (solid, symbols))
            rep = [_repeats(raw[offsets[i] : offsets[i + 1]], hashes[first[i] : first[i + 1]]) for i in range(docs_n)]
            lines, repeated = np.array(rep, np.int64).reshape(-1, 2).T
            failed = (n < BASE_WORDS) | (100 * repeated > BASE_REPEATED * n)
            doc_of_word, n_chars = np.repeat(np.arange(docs_n), n), classes.sum(axis=1)
            langs = batch.column(1).to_pylist()
            fits = np.array([not refs or (x is not None and x not in refs) for x in langs], bool)
            char = np.where(fits, 0.0, np.inf)
            word = char.copy()

            def look(g, rows, char, word, fits):
                pick = np.zeros(docs_n, bool)
                pick[rows] = True
                of = pick[doc_of_word]
                place = np.cumsum(pick) - 1
                c, w = distances(g, classes[rows], words[of], place[doc_of_word[of]], n[rows], n_chars[rows])
                ok = (c <= MOST_CHAR_DISTANCE) & (w <= MOST_WORD_DISTANCE)
                nearer = ok | (np.maximum(c, w) < np.maximum(char[rows], word[rows]))
                char[rows], word[rows] = np.where(nearer, c, char[rows]), np.where(nearer, w, word[rows])
                fits[rows] |= ok

            for g in refs:
                own = np.flatnonzero(np.array([x == g for x in langs], bool))
                if len(own):
                    look(g, own, char, word, fits)
            for g in refs:  # what doesn't fit its own language may fit another
                rest = np.flatnonzero(~fits & ~failed)
                if len(rest):
                    look(g, rest, char, word, fits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(x.astype(np.int64)) for x in (n, word_chars, n_symbols, lines, repeated)),
                    pa.array(failed), pa.array(fits & ~failed), *(pa.array(np.where(np.isfinite(x), x, np.nan), from_pandas=True) for x in (char, word)),
                ],
                names=[f.split()[0] for f in _OUT.split(", ")],
            )

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(lean(rows), _OUT)


def quality_rules(docs: DataFrame) -> DataFrame:
    """References over all of ``docs``, then the verdict on each of them; see :func:`judge`."""
    return judge(docs, collect_references(references(docs)))
