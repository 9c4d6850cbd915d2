"""Fill-in-the-middle forms of texts, cut by a succinct rank/select directory.

A text is UTF-8 bytes, and a bit marks each byte that begins a code point. The bits of a batch
are packed into 64-bit words, with the ones before each block of words in a directory. The ones
between the ends of a text are its code points, and selecting two ranks gives the bytes where
it is cut; no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches, text_buffer

#: Words of 64 bits whose ones are counted together.
BLOCK = 8
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many keep their plain form, and how many of the others put the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
SEED = "1"
_ONES = np.arange(64, dtype=np.uint64)


class RankSelect:
    """A bit vector that answers how many ones lie before a place, and where one number k lies."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        # one block of zeros at the end, so that every place has a word
        room = -(-(len(packed) + 1) // (8 * BLOCK)) * 8 * BLOCK
        self._words = np.pad(packed, (0, room - len(packed))).view("<u8")
        counts = np.bitwise_count(self._words).reshape(-1, BLOCK).astype(np.int64)
        self._blocks = np.concatenate(([0], np.cumsum(counts.sum(axis=1))))
        self._inside = np.cumsum(counts, axis=1) - counts  # ones of the block before each word

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each of ``places`` (0 to size)."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self._words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self._blocks[word // BLOCK] + self._inside[word // BLOCK, word % BLOCK] + np.bitwise_count(below)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of the one that has ``ranks`` ones before it; size beyond the last."""
        total = self._blocks[-1]
        there = np.flatnonzero(ranks < total)
        out = np.full(len(ranks), self.size, np.int64)
        if not len(there):
            return out
        left = ranks[there]
        block = np.searchsorted(self._blocks, left, side="right") - 1
        left = left - self._blocks[block]
        word = (self._inside[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self._inside[block, word]
        held = self._words[block * BLOCK + word]
        bits = (held[:, None] >> _ONES) & np.uint64(1)
        bit = (np.cumsum(bits, axis=1) <= left[:, None].astype(np.uint64)).sum(axis=1)
        out[there] = (block * BLOCK + word) * 64 + bit
        return out


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2**32 for a document: the first groups of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Only texts without markers have another form than
    ``plain``, and no cut makes a marker, so each marker stands once."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def joined(second: str, prefix_first: bool) -> Column:
        a, rest = F.substring_index(body, second, 1), F.substring_index(body, second, -1)
        b, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
        return F.concat(a, middle, b) if prefix_first else F.concat(b, middle, a)

    return F.when(form == "plain", output).when(form == "psm", joined(SUFFIX, True)).otherwise(joined(PREFIX, False))


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED,
    plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars and output of every row.

    The prefix ends and the middle ends at two drawn numbers of code points. ``psm`` is prefix,
    suffix, middle; ``spm`` is suffix, prefix, middle; each part has its marker before it.
    ``plain`` is the text: of empty and null texts, of texts that hold a marker, and of
    ``plain_percent`` in a hundred others. The draws depend on seed and doc_id alone (a null
    doc_id counts as an empty one), so repeated rows come out alike; :func:`restored` gives the
    text back. Other columns are ignored, whatever their names; an empty table gives no rows.
    Rows are worked on where they are read: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

    def forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            bits = RankSelect((data & 0xC0) != 0x80)
            h1, h2, h3, h4 = (np.asarray(batch.column(k)) for k in range(2, 6))
            first = bits.rank(offsets[:-1])
            n = bits.rank(offsets[1:]) - first
            a, b = h1 % (n + 1), h2 % (n + 1)
            low, high = np.minimum(a, b), np.maximum(a, b)
            cut1 = np.minimum(bits.select(first + low), offsets[1:])
            cut2 = np.minimum(bits.select(first + high), offsets[1:])
            whole = memoryview(data)
            kinds, outputs = [], []
            for x, u, v, y, plain, early in zip(
                offsets[:-1].tolist(), cut1.tolist(), cut2.tolist(), offsets[1:].tolist(),
                (h3 % 100 >= 100 - plain_percent).tolist(), (h4 % 100 < suffix_first_percent).tolist(), strict=True,
            ):
                raw = bytes(whole[x:y])
                plain = plain or x == y or p in raw or s in raw or m in raw
                prefix, middle, suffix = raw[: u - x], raw[u - x : v - x], raw[v - x :]
                form = "plain" if plain else "spm" if early else "psm"
                kinds.append(form)
                outputs.append(raw if plain else b"".join((s, suffix, p, prefix, m, middle) if early else (p, prefix, s, suffix, m, middle)))
            is_plain = np.array([k == "plain" for k in kinds], bool)
            columns = {
                "doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(kinds, pa.string()),
                "prefix_chars": pa.array(low, pa.int64(), mask=is_plain), "middle_chars": pa.array(high - low, pa.int64(), mask=is_plain),
                "output": pa.array(outputs, pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    drawn = own.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    return drawn.mapInArrow(lean(forms), _OUT)
