"""Byte-level BPE by overlapping chunks, and back.

A text beyond ``CHUNK`` bytes is cut into chunks that reach ``OVERLAP`` bytes into the next one,
and the chunks are pre-tokenised apart. The pattern never looks behind, so from a common
boundary on two pre-tokenisations are the same. Where the boundaries of a chunk and of the one
before it first meet in their overlap, the text is parted; each part is then encoded by itself.
A chunk that meets nothing (one pre-token longer than the overlap) is encoded together with the
part before it. Decoding concatenates the bytes of the ids, so it needs no boundaries.

Ids of a part are little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_size, lean, small_batches, stored, text_buffer
from .token_files import vocabulary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a text that are encoded as one piece of work, and how far a chunk reaches into the next.
CHUNK = 32 << 10
OVERLAP = 512
#: A match that ends this close to the end of a cut chunk could go on behind the cut.
MARGIN = 3
#: Distinct pre-tokens whose ids a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 200_000, 64
BROADCAST_CHUNKS = 1_000_000
#: Ids are given out in batches of about so many bytes.
OUT_BYTES = 4 << 20


def _foreign_letters(pattern: str) -> list[int]:
    """Code points that are letters or numbers for the pattern module, but unknown to the
    encoding library, whose Unicode tables may be older.

    Each is put behind a letter and a digit into an encoding that has the pair as one token: the
    library makes one token of it exactly if it takes the code point for the same class."""
    import regex
    import tiktoken

    kind = regex.compile(r"[\p{L}\p{N}]")
    doubtful = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and kind.match(chr(c))]
    ranks = {bytes([b]): b for b in range(256)}
    whole = [chr(c).encode() for c in doubtful]
    for piece in sorted({w[:k] for w in whole for k in range(2, len(w) + 1)}, key=lambda w: (len(w), w)):
        ranks[piece] = len(ranks)
    for first in (b"a", b"1"):
        for w in whole:
            ranks[first + w] = len(ranks)
    library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [c for c in doubtful if all(len(library.encode_ordinary(first + chr(c))) > 1 for first in "a1")]


def _ranges(points: list[int]) -> str:
    edges: list[list[int]] = []
    for c in points:
        if edges and edges[-1][1] == c - 1:
            edges[-1][1] = c
        else:
            edges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in edges)


class Bpe:
    """Ids and bytes by a rank file and the usual pattern."""

    def __init__(self, vocab: str = VOCABULARY):
        import public_tokenizers
        import regex
        import tiktoken

        with open(vocabulary(vocab), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._source = public_tokenizers.PATTERN
        self._library = tiktoken.Encoding("own", pat_str=self._source, mergeable_ranks=ranks, special_tokens={})
        self._usual = regex.compile(self._source)
        self._exact = None
        self._memo: dict[str, bytes] = {}
        # the bytes of all tokens, one behind the other
        lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            lengths[rank + 1] = len(token)
        self._ends = np.cumsum(lengths)
        self._bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def _pattern(self, raw: np.ndarray):
        """The pattern for a text: the usual one, unless letters may occur of which the
        encoding library doesn't know."""
        # no code point that was assigned so late has a lead byte below this one
        if not len(raw) or raw.max() < 0xD5:
            return self._usual
        if self._exact is None:
            import regex

            foreign = _foreign_letters(self._source)
            if foreign:
                late = f"[{_ranges(foreign)}]"
                source = self._source.replace(r"[^\s\p{L}\p{N}]", "OTHER").replace(r"\p{L}", rf"[\p{{L}}--{late}]").replace(r"\p{N}", rf"[\p{{N}}--{late}]")
                self._exact = regex.compile("(?V1)" + source.replace("OTHER", rf"[[^\s\p{{L}}\p{{N}}]||{late}]"))
            else:
                self._exact = self._usual
        return self._exact

    def _learn(self, piece: str) -> bytes:
        ids = np.array(self._library.encode_ordinary(piece), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[piece] = ids
        return ids

    def encode(self, raw: np.ndarray) -> bytes:
        """Ids of a text, each pre-token by itself. Malformed bytes count as U+FFFD."""
        known, learn = self._memo, self._learn
        return b"".join([known.get(p) or learn(p) for p in self._pattern(raw).findall(raw.tobytes().decode("utf-8", "replace"))])

    def boundaries(self, raw: np.ndarray, last: bool) -> np.ndarray:
        """Places of bytes where pre-tokens begin, reading ``raw`` from its start. Unless it is
        the ``last`` chunk, only those that what follows cannot change."""
        text = raw.tobytes().decode("utf-8")
        ends = np.array([m.end() for m in self._pattern(raw).finditer(text)], np.int64)
        starts = np.concatenate(([0], ends if last else ends[ends <= len(text) - MARGIN]))
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each code point
        return place[starts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        given = np.frombuffer(ids, "<u4").astype(np.int64)
        begin = self._ends[given]
        size = self._ends[given + 1] - begin
        stop = np.cumsum(size)
        where = np.arange(stop[-1] if len(stop) else 0)
        where += np.repeat(begin - (stop - size), size)
        return self._bytes[where].tobytes()


@lru_cache(4)
def bpe(vocab: str) -> Bpe:
    """One encoder for each vocabulary of a worker process."""
    return Bpe(vocab)


# ---------------------------------------------------------------- parts of texts

_PARTS = "key long, doc_id long, part int, ids binary"


class _Rows:
    """Rows that are given out in batches of bounded size."""

    def __init__(self, **kinds: pa.DataType):
        self._kinds, self._columns, self._size = kinds, [[] for _ in kinds], 0

    def add(self, size: int, *values) -> bool:
        for column, v in zip(self._columns, values, strict=True):
            column.append(v)
        self._size += size
        return self._size >= OUT_BYTES or len(self._columns[0]) >= 10_000

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self._columns, self._kinds.values(), strict=True)], names=list(self._kinds))
        self._columns, self._size = [[] for _ in self._kinds], 0
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self._columns[0]:
            yield self.take()


def _part_rows() -> _Rows:
    return _Rows(key=pa.int64(), doc_id=pa.int64(), part=pa.int32(), ids=pa.binary())


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def short_parts(docs: DataFrame, vocab: str, chunk: int) -> DataFrame:
    """The only part of each text of at most ``chunk`` bytes; encoded where it is read."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = bpe(vocab), _part_rows()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for d, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = own.encode(data[a:b])
                if rows.add(len(ids), None, d, 0, ids):
                    yield rows.take()
        yield from rows.rest()

    return docs.where(F.octet_length("text") <= chunk).mapInArrow(lean(encode), _PARTS)


_CHUNKS = "key long, doc_id long, chunk int, last boolean, at long, body binary"


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks of each text of more than ``chunk`` bytes, dealt by text and chunk.
    ``key`` tells rows apart in this table only; ``at`` is the first byte of the chunk."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        rows = _Rows(key=pa.int64(), doc_id=pa.int64(), chunk=pa.int32(), last=pa.bool_(), at=pa.int64(), body=pa.binary())
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for d, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                raw, key = data[a:b], key + 1

                def edge(i, raw=raw):  # no code point is cut
                    while i < len(raw) and raw[i] & 0xC0 == 0x80:
                        i += 1
                    return min(i, len(raw))

                n = -(-len(raw) // chunk)
                for k in range(n):
                    x, y = edge(k * chunk), edge((k + 1) * chunk + overlap)
                    if rows.add(y - x, key, d, k, k == n - 1, x, raw[x:y].tobytes()):
                        yield rows.take()
        yield from rows.rest()

    long = docs.where(F.octet_length("text") > chunk).select("doc_id", F.make_valid_utf8("text").alias("text"))
    return stored(long.mapInArrow(lean(chunks), _CHUNKS).repartition("key", "chunk"), "chunks")


def seams(chunks: DataFrame, vocab: str, chunk: int, overlap: int) -> DataFrame:
    """key, chunk, part, start and stop: the chunks of each part, and the bytes of the part
    (stop is null for the end of the text)."""

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(vocab)
        for batch in batches:
            heads, tails = [], []
            for k, last, at, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "last", "at", "body")), strict=True):
                places = own.boundaries(np.frombuffer(body, np.uint8), last) + at
                heads.append(places[places <= at + overlap])
                tails.append(places[:0] if last else places[places >= (k + 1) * chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(heads, kind), pa.array(tails, kind)], names=["key", "chunk", "head", "tail"])

    found = stored(chunks.mapInArrow(lean(marks), "key long, chunk int, head array<long>, tail array<long>"), "marks")
    order = Window.partitionBy("key").orderBy("chunk")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    synced = found.select("key", "chunk", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(met).alias("met"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = synced.select("key", "chunk", "met", F.max(F.when(F.col("met").isNotNull(), F.col("chunk"))).over(so_far).alias("part"), F.max("met").over(so_far).alias("start"))
    later = order.rowsBetween(1, Window.unboundedFollowing)
    return stored(parts.select("key", "chunk", "part", "start", F.min("met").over(later).alias("stop")), "seams")


def long_parts(docs: DataFrame, vocab: str, chunk: int, overlap: int) -> DataFrame:
    """The parts of each text of more than ``chunk`` bytes."""
    chunks = cut(docs, chunk, overlap)
    where = seams(chunks, vocab, chunk, overlap)
    n = where.count()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = bpe(vocab), _part_rows()
        place, bodies = None, []

        def whole() -> bytes:
            _, _, doc, start, stop = place
            text = b"".join([body[: after - at] for (at, body), (after, _) in zip(bodies, bodies[1:], strict=False)] + [bodies[-1][1]])
            first = bodies[0][0]
            return own.encode(np.frombuffer(text, np.uint8)[start - first : None if stop is None else stop - first])

        for batch in batches:
            for key, part, doc, start, stop, at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place is not None and place[:2] != (key, part):
                    ids = whole()
                    if rows.add(len(ids), place[0], place[2], place[1], ids):
                        yield rows.take()
                    bodies.clear()
                place = (key, part, doc, start, stop)
                bodies.append((at, body))
        if place is not None:
            ids = whole()
            rows.add(len(ids), place[0], place[2], place[1], ids)
        yield from rows.rest()

    parted = chunks.join(by_size(where, n, BROADCAST_CHUNKS), ["key", "chunk"])
    dealt = parted.repartition("key", "part").sortWithinPartitions("key", "part", "chunk")
    return dealt.select("key", "part", "doc_id", "start", "stop", "at", "body").mapInArrow(lean(encode), _PARTS)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of every whole text, as parts: key (null for a text of one part, else the same for
    all parts of a row), doc_id, part (ascending along the text) and ids.

    A null text is an empty one and has one part without ids. Rows stay apart when their doc_id
    is null or repeated; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = _own(docs, doc_id, text)
    return short_parts(own, vocab, chunk).unionByName(long_parts(own, vocab, chunk, overlap))


def decode(parts: DataFrame, vocab: str = VOCABULARY) -> DataFrame:
    """``parts`` with ``bytes``, what the ids of each part stand for."""
    small_batches(parts.sparkSession)

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(vocab)
        for batch in batches:
            out = [own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    return parts.select("key", "doc_id", "part", "ids").mapInArrow(lean(decoded), f"{_PARTS}, bytes binary")


def digests(parts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of rows
    whose parts follow each other in their partition."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(doc_id=pa.int64(), n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())
        held, doc, n, a, b = None, None, 0, None, None
        for batch in batches:
            for key, d, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "ids", "bytes")), strict=True):
                if a is not None and (key is None or key != held):
                    if rows.add(200, doc, n, a.hexdigest(), b.hexdigest()):
                        yield rows.take()
                    a = None
                if a is None:
                    held, doc, n, a, b = key, d, 0, hashlib.sha256(), hashlib.sha256()
                numbers = np.frombuffer(ids, "<u4").tolist()
                if numbers:
                    a.update((("," if n else "") + str(numbers)[1:-1].replace(" ", "")).encode())
                n += len(numbers)
                b.update(raw)
        if a is not None:
            rows.add(200, doc, n, a.hexdigest(), b.hexdigest())
        yield from rows.rest()

    return parts.mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, as :func:`encode` and
    :func:`decode` have them. Only the parts of long texts are shuffled; a text's digest is one
    sequence, so its parts pass through one task, one at a time."""
    small_batches(docs.sparkSession)
    own = _own(docs, doc_id, text)
    short = digests(decode(short_parts(own, vocab, chunk), vocab))
    parts = long_parts(own, vocab, chunk, overlap).repartition("key").sortWithinPartitions("key", "part")
    return short.unionByName(digests(decode(parts, vocab)))
