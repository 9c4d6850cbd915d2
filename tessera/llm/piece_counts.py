"""Numbers of word pieces by a linear longest-match automaton.

A trie of the vocabulary carries failure links and, for each node, how many pieces are
complete when its link is followed. One pass over the letters of a word then gives the length
of its greedy longest-match segmentation; no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches
from .token_files import vocabulary

VOCABULARY = "piece_bpe_32k.model"
#: Distinct words whose counts a worker remembers.
MEMO = 500_000
_UNKNOWN = 1 << 40


class PieceAutomaton:
    """``initial``: pieces that can begin a word; ``inner``: pieces that can continue one."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self._next: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 continues one
        self._link: list[int] = [-1, -1]
        self._popped: list[int] = [0, 0]
        final = {self._add(0, p) for p in initial if p} | {self._add(1, p) for p in inner if p}
        queue = [(root, c, child) for root in (0, 1) for c, child in self._next[root].items()]
        for parent, letter, node in queue:  # breadth first: links lead to shorter strings
            if node in final:
                self._link[node], self._popped[node] = 1, 1
            else:
                at, popped = self._link[parent], self._popped[parent]
                while at >= 0 and letter not in self._next[at]:
                    popped += self._popped[at]
                    at = self._link[at]
                if at >= 0:
                    self._link[node], self._popped[node] = self._next[at][letter], popped
            queue += [(node, c, child) for c, child in self._next[node].items()]

    def _add(self, root: int, piece: str) -> int:
        for c in piece:
            if c not in self._next[root]:
                self._next[root][c] = len(self._next)
                self._next.append({})
                self._link.append(-1)
                self._popped.append(0)
            root = self._next[root][c]
        return root

    def count(self, word: str) -> int | None:
        """Pieces of ``word``; None if greedy matching gets stuck. Nothing for no letters."""
        node, n = 0, 0
        if not word:
            return 0
        for c in word:
            while c not in self._next[node]:
                if self._link[node] < 0:
                    return None
                n += self._popped[node]
                node = self._link[node]
            node = self._next[node][c]
        while node != 1:
            if self._link[node] < 0:
                return None
            n += self._popped[node]
            node = self._link[node]
        return n


def load_pieces(name: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Initial and inner pieces of a sentencepiece vocabulary: those marked with U+2581 begin a
    word, the others continue one; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]


class _Counts(dict):
    def __init__(self, automaton: PieceAutomaton):
        super().__init__()
        self._automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self._automaton.count(word.decode("utf-8", "replace"))
        self[word] = n = 1 + _UNKNOWN if n is None else n
        return n


def count_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (long) of every row's whole text.

    Words are runs without space or ASCII control blanks. A word that greedy matching cannot
    cover counts as one unknown token. Null and empty texts count nothing; doc_id is passed
    through, null or repeated; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(PieceAutomaton(*load_pieces(vocab)))
        for batch in batches:
            words, tokens = [], []
            for t in batch.column(1).cast(pa.binary()):
                own = (t.as_py() or b"").split()
                words.append(len(own))
                tokens.append(sum(map(known.__getitem__, own)))
                if len(known) > MEMO:
                    known.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(words, pa.int64()),
                    pa.array([n % _UNKNOWN for n in tokens], pa.int64()), pa.array([n // _UNKNOWN for n in tokens], pa.int64()),
                ],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(lean(count), "doc_id long, n_words long, n_tokens long, n_unknown long")
