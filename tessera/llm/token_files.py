"""Token ids of a corpus in wavelet-matrix files.

A shard file holds the ids of successive documents as a wavelet matrix: bit-planes of the
ids' codes, each plane stably partitioned by the plane above it, with rank counts per block.
One compressed file answers token access, counts up to a position and occurrence lookup, and
only the blocks a question touches are decompressed.

File format (little endian): ``WVM1``, uint32 header length, a JSON header
``{tokens, planes, docs, sections}``, then the sections in zstandard frames at the byte ranges
the header lists: ``alphabet`` (uint32 ids, most frequent first; an id's code is its place),
``ids`` (int64 document ids), ``null`` (uint8 flags of null document ids), ``lengths`` (int64
tokens of each document), and for each plane ``zeros``, ``ranks`` (ones before each block) and
its blocks of packed bits.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_size, fresh_path, lean, slices, small_batches, span_hashes, stored, text_buffer

MAGIC = b"WVM1"
#: Bits of a plane in one compressed block.
BLOCK = 1 << 18
#: Bits whose ones are counted together in an open block.
CHUNK = 512
#: A shard file is closed at this many tokens (and holds one document at least).
SHARD_TOKENS = 1 << 21
#: Bytes in which a worker remembers the ids of distinct pieces of text; beyond them it forgets all and learns anew.
MEMO_BYTES = 32 << 20
#: Pieces that are encoded as one string.
LINES = 256
#: Bytes of text encoded at once.
SLICE_BYTES = 1 << 20
VOCABULARY = "byte_bpe_50k.json"
BROADCAST_SHARDS = 1_000_000


# ---------------------------------------------------------------- the structure


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard file of ``ids``, the concatenated tokens of documents of these ``lengths``."""
    pack = zstandard.ZstdCompressor(level=1)
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    there = np.flatnonzero(counts)
    alphabet = there[np.argsort(-counts[there], kind="stable")].astype(np.uint32)
    code = np.zeros(len(counts), np.uint32)
    code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(ids) else 0
    a = code[ids].astype(np.uint16 if planes <= 16 else np.uint32) if len(ids) else np.zeros(0, np.uint16)
    sections, body, at = {}, [], 0

    def put(name: str, raw: bytes) -> list[int]:
        nonlocal at
        frame = pack.compress(raw)
        body.append(frame)
        at += len(frame)
        sections.setdefault(name, []).append([at - len(frame), len(frame)])

    put("alphabet", alphabet.tobytes())
    put("ids", np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes())
    put("null", np.array([d is None for d in doc_ids], np.uint8).tobytes())
    put("lengths", np.array(lengths, np.int64).tobytes())
    zeros, ranks, spare = [], [], np.empty_like(a)
    for k in range(planes - 1, -1, -1):
        bits = (a & a.dtype.type(1 << k)) != 0
        packed = np.packbits(bits, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64)
        ranks.append(np.concatenate(([0], np.cumsum(ones)[:-1])))
        zeros.append(len(bits) - int(ones.sum()))
        for b in range(0, len(packed), BLOCK // 8):
            put(f"plane{k}", packed[b : b + BLOCK // 8].tobytes())
        if k:  # mode spares a buffer; all places are in range
            a.take(np.flatnonzero(~bits), out=spare[: zeros[-1]], mode="clip")
            a.take(np.flatnonzero(bits), out=spare[zeros[-1] :], mode="clip")
            a, spare = spare, a
    put("zeros", np.array(zeros, np.int64).tobytes())
    put("ranks", np.array(ranks, np.int64).tobytes())
    header = json.dumps({"tokens": int(len(ids)), "planes": planes, "docs": len(doc_ids), "sections": sections}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *body])


class WaveletMatrix:
    """A shard file opened for reading; ``content`` is its bytes."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        n = int.from_bytes(content[4:8], "little")
        h = json.loads(content[8 : 8 + n])
        self.tokens, self.planes, self._sections = h["tokens"], h["planes"], h["sections"]
        self._content, self._base, self._unpack = content, 8 + n, zstandard.ZstdDecompressor()
        self.alphabet = np.frombuffer(self._raw("alphabet"), np.uint32)
        null = np.frombuffer(self._raw("null"), np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(self._raw("ids"), np.int64), null, strict=True)]
        self.lengths = np.frombuffer(self._raw("lengths"), np.int64)
        self._zeros = np.frombuffer(self._raw("zeros"), np.int64)
        self._ranks = np.frombuffer(self._raw("ranks"), np.int64).reshape(self.planes, -1) if self.planes else np.zeros((0, 0), np.int64)
        self._code = {int(t): i for i, t in enumerate(self.alphabet)}
        self._block = lru_cache(64)(self._opened)

    def _raw(self, name: str, i: int = 0) -> bytes:
        at, n = self._sections[name][i]
        return self._unpack.decompress(self._content[self._base + at : self._base + at + n])

    def _packed(self, level: int, block: int) -> np.ndarray:
        return np.frombuffer(self._raw(f"plane{self.planes - 1 - level}", block), np.uint8)

    def _opened(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a block, and the ones before each of its chunks."""
        packed = self._packed(level, block)
        packed = np.pad(packed, (0, -len(packed) % (CHUNK // 8)))
        return packed, np.concatenate(([0], np.bitwise_count(packed).reshape(-1, CHUNK // 8).sum(axis=1, dtype=np.int64).cumsum()))

    def _ones(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block, rest = divmod(i, BLOCK)
        if not rest:
            return int(self._ranks[level][block]) if i < self.tokens else self.tokens - int(self._zeros[level])
        packed, sums = self._block(level, block)
        chunk, byte = rest // CHUNK, rest // 8
        ones = int(self._ranks[level][block]) + int(sums[chunk]) + int(np.bitwise_count(packed[chunk * CHUNK // 8 : byte]).sum())
        return ones + (int(packed[byte]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else ones

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        code = 0
        for level in range(self.planes):
            bit = int(self._block(level, i // BLOCK)[0][i % BLOCK // 8]) >> i % 8 & 1
            ones = self._ones(level, i)
            i = int(self._zeros[level]) + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, end: int) -> tuple[int, int]:
        code, start = self._code[token], 0
        for level in range(self.planes):
            a, b = self._ones(level, start), self._ones(level, end)
            if code >> (self.planes - 1 - level) & 1:
                start, end = int(self._zeros[level]) + a, int(self._zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before position ``end`` (all of them by default)."""
        if token not in self._code:
            return 0
        a, b = self._range(token, self.tokens if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        i = self._range(token, self.tokens)[0] + k
        code = self._code[token]
        for level in range(self.planes - 1, -1, -1):
            bit = code >> (self.planes - 1 - level) & 1
            want = i - int(self._zeros[level]) if bit else i
            ranks = self._ranks[level] if bit else np.arange(len(self._ranks[level])) * BLOCK - self._ranks[level]
            block = int(np.searchsorted(ranks, want, side="right")) - 1
            packed, sums = self._block(level, block)
            want -= int(ranks[block])
            sums = sums if bit else np.arange(len(sums)) * CHUNK - sums
            chunk = int(np.searchsorted(sums, want, side="right")) - 1
            bits = np.unpackbits(packed[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8], bitorder="little")
            i = block * BLOCK + chunk * CHUNK + int(np.flatnonzero(bits == bit)[want - int(sums[chunk])])
        return i

    def to_array(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        codes = np.zeros(self.tokens, kind)
        blocks = range(-(-self.tokens // BLOCK))
        for level in range(self.planes - 1, -1, -1):
            bits = np.unpackbits(np.concatenate([self._packed(level, b) for b in blocks]), bitorder="little")[: self.tokens]
            zeros = int(self._zeros[level])
            before = np.empty_like(codes)
            bits = bits.view(bool)
            if zeros:
                np.place(before, ~bits, codes[:zeros])
            if zeros < self.tokens:
                np.place(before, bits, codes[zeros:] | kind(1 << (self.planes - 1 - level)))
            codes = before
        return self.alphabet[codes]


# ---------------------------------------------------------------- encoding


def vocabulary(name: str) -> str:
    """The place of a vocabulary file: an absolute path, or a name among the public ones."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: First bytes of what certainly is no blank: ASCII signs, and lead bytes without blanks.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True


class Encoder:
    """Ids of whole texts. For a byte-level vocabulary with the usual pattern, a text is cut
    before each space that a non-blank follows and around a single line break between
    signs: the pattern never joins what such a cut parts, so each distinct piece is encoded once and remembered by a 64-bit hash and its
    length. Other vocabularies get whole texts."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self._cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(
            " " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ()
        )
        newline = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._break = newline[0] if self._cuts and len(newline) == 1 else None
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._many, self._late = none, none  # keys in order, and their places; late ones join the many from time to time
        self._flat, self._ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted ``keys``; 0 for those not known."""
        out = np.zeros(len(keys), np.int64)
        for known, places in (self._many, self._late):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = places[at[hit]]
        return out

    def _remember(self, keys: np.ndarray, places: np.ndarray) -> None:
        def joined(a, b):
            keys, places = (np.concatenate(x) for x in zip(a, b, strict=True))
            order = np.argsort(keys, kind="stable")
            return keys[order], places[order]

        self._late = joined(self._late, (keys, places))
        if 4 * len(self._late[0]) > len(self._many[0]):
            self._many, self._late = joined(self._many, self._late), (keys[:0], places[:0])

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of pieces not seen before. Pieces without other blanks are encoded many to a
        string, a line each: the line break is one token, and the pattern keeps it apart."""
        doubtful = np.concatenate(([0], np.cumsum(~_SOLID[data] & ~_INNER[data], dtype=np.int64)))
        inner = starts + (data[starts] == 0x20)
        plain = (doubtful[ends] == doubtful[inner]) & (ends > inner) if self._break is not None else np.zeros(len(keys), bool)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        flat, stops, base = [], [], len(self._flat)
        a, b = starts[plain], ends[plain]
        if len(a):
            n = b - a + 1  # with a line break
            stop = np.cumsum(n)
            where = np.arange(stop[-1]) + np.repeat(a - (stop - n), n)
            text = data[np.minimum(where, len(data) - 1)]
            text[stop - 1] = 0x0A
            cuts = [0, *stop[LINES - 1 :: LINES].tolist()]
            cuts += [int(stop[-1])] if cuts[-1] != stop[-1] else []
            raw = text.tobytes()
            blocks = [raw[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:], strict=False)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(blocks, add_special_tokens=False)])
            at = np.flatnonzero(ids == self._break)
            flat.append(np.delete(ids, at))
            stops.append(at - np.arange(len(at)) + base)
            base += len(flat[0])
        odd = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True)]
        if odd:
            own = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            stops.append(np.cumsum([len(x) for x in own]) + base)
            flat += own
        places = np.arange(len(keys)) + len(self._ends)
        self._flat, self._ends = np.concatenate((self._flat, *flat)), np.concatenate((self._ends, *stops))
        self._remember(keys[order], places)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a buffer, and the number of each."""
        if sum(x.nbytes for x in (*self._many, *self._late, self._flat, self._ends)) > MEMO_BYTES:
            self._forget()
        cut = np.zeros(len(data), bool)
        if self._cuts and len(data) > 1:
            solid = _SOLID[data]
            np.logical_and(data[:-1] == 0x20, solid[1:], out=cut[:-1])
            # a single line break between signs is a token of its own
            line = np.flatnonzero((data[1:-1] == 0x0A) & solid[2:] & _SIGN[data[:-2]]) + 1
            cut[line] = cut[line + 1] = True
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        unique, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = self._find(unique)
        new = np.flatnonzero(place == 0)
        if len(new):
            self._learn(unique[new], data, starts[first[new]], ends[first[new]])
            place = self._find(unique)
        begin = self._ends[place - 1]
        size = (self._ends[place] - begin)[inverse]
        stop = np.cumsum(size)
        where = np.arange(stop[-1] if len(stop) else 0)
        where += np.repeat(begin[inverse] - (stop - size), size)
        sums = np.concatenate(([0], stop))[np.searchsorted(starts, offsets)]
        return self._flat[where], np.diff(sums)


@lru_cache(4)
def encoder(name: str) -> Encoder:
    """One encoder for each vocabulary of a worker process: its pieces serve later tasks too."""
    return Encoder(name)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _save(folder: str, name: str, content: bytes) -> None:
    """Put a file in place whole: written aside, then renamed. A repeated task writes the same, so
    the file that another attempt has put there stays."""
    from pyarrow import fs

    store, base = _open(folder)
    store.create_dir(base)
    there = store.get_file_info(f"{base}/{name}")
    if there.type == fs.FileType.File and there.size == len(content):
        with store.open_input_stream(f"{base}/{name}") as old:
            if old.read() == content:
                return
    aside = f"{base}/.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(content)
    store.move(aside, f"{base}/{name}")


_MANIFEST = "part int, seq int, file string, tokens long, docs long"


def write_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocab: str = VOCABULARY, end: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every whole text, append id ``end`` to each, and write the ids in ascending order
    of ``doc_id`` (nulls first, ties by text) as shard files in ``folder``, a URI that all
    executors reach. Returns the manifest: part, seq, file, tokens, docs.

    Texts are dealt by ranges of doc_id, so no task holds more than its range; a task streams
    and closes a file at ``shard_tokens``. Null texts are empty and have the end id alone.
    """
    small_batches(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, ids_held, lengths_held, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        own_encoder = encoder(vocab)

        def close():
            nonlocal seq, held, ids_held, lengths_held, n
            name = f"{part:07d}-{seq:05d}.wm"
            _save(folder, name, build(np.concatenate(held), ids_held, lengths_held))
            row = [[part], [seq], [name], [n], [len(ids_held)]]
            seq, held, ids_held, lengths_held, n = seq + 1, [], [], [], 0
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "file", "tokens", "docs"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                ids, counts = own_encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = 0
                for d, k in zip(batch.column(0).slice(i, j - i).to_pylist(), counts.tolist(), strict=True):
                    held += [ids[at : at + k], np.array([end], np.uint32)]
                    at += k
                    ids_held.append(d)
                    lengths_held.append(k + 1)
                    n += k + 1
                    if n >= shard_tokens:
                        yield close()
        if ids_held:
            yield close()

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return stored(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(write), _MANIFEST), "manifest")


_DECODED = "file string, place long, doc_id long, before long, n_tokens long, ids_crc32 long"


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            m = WaveletMatrix(content.as_py())
            ids = m.to_array().astype("<u4")
            ends = np.cumsum(m.lengths)
            starts = ends - m.lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(m.doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path.as_py().rpartition("/")[2]] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(m.doc_ids, pa.int64()),
                    pa.array(starts), pa.array(m.lengths), pa.array(crc, pa.int64()),
                ],
                names=["file", "place", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files that the
    manifest lists (files of abandoned attempts are not in it). ``start`` counts the ids of all
    documents before it, over all files."""
    spark = manifest.sparkSession
    small_batches(spark)
    # one number for each shuffle partition comes to the driver
    totals = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long")
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    offsets = manifest.select("part", "file", F.coalesce(inside, F.lit(0)).alias("earlier")).join(F.broadcast(base), "part")
    offsets = offsets.select("file", (F.col("base") + F.col("earlier")).alias("offset"))
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    decoded = files.mapInArrow(lean(_decode), _DECODED)
    return decoded.join(by_size(offsets, manifest.count(), BROADCAST_SHARDS), "file").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_corpus(docs: DataFrame, folder: str | None = None, vocab: str = VOCABULARY) -> DataFrame:
    """Write the token files of ``docs`` and return what :func:`read_files` finds in them.

    Only doc_id and text are used, so other columns may have any name. Null doc_ids come
    first; repeated rows stay repeated; an empty table writes no file and gives no rows.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, folder, vocab=vocab), folder)
