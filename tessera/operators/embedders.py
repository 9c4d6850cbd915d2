"""Embedders behind one signature: what turns texts into unit vectors for a search.

``embed(chunks, key, text, postings)`` gives (key, idx, weight), the numbers of each vector that
are not 0. An embedder that says ``from_postings`` reads stored postings instead of texts where
there are some; one that says ``dense`` has vectors without zeros, which are searched by blocks
instead of by slots.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking

#: Texts that a model gets at once.
BATCH = 32


def _long(text_digest, at: int, width: int = 4):
    return F.conv(F.substring(text_digest, at, width), 16, 10).cast("int")


@dataclass(frozen=True)
class HashEmbedder:
    """A token's slot and sign come from its digest; see :func:`.ranking.hash_embedding`."""

    dim: int = ranking.DIM
    dense = False
    from_postings = True

    def embed(self, chunks: DataFrame, key: str = "id", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
        return ranking.hash_embedding(chunks, key, text, self.dim, postings)

    def arrays(self, chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        return ranking.hash_vectors(chunks, key, text, self.dim)


@dataclass(frozen=True)
class ProjectionEmbedder:
    """A very sparse random projection of a text's term counts: each term goes to ``spread`` of
    ``dim`` slots with a sign of its own, all from its digest, so nothing is learnt or loaded.
    Counts are damped by their logarithm. ``spread`` is 4 at most."""

    dim: int = 256
    spread: int = 4
    dense = False
    from_postings = True

    def embed(self, chunks: DataFrame, key: str = "id", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
        if not 1 <= self.spread <= 4:
            raise ValueError("spread must be 1 to 4")
        if postings is None:
            return ranking.slot_rows(self.arrays(chunks, key, text), key)
        digest = F.md5(F.col("term").cast("binary"))
        slot = lambda j: F.struct((_long(digest, 1 + 4 * j) % self.dim).alias("idx"), F.when(_long(digest, 17 + j, 1) >= 8, 1.0).otherwise(-1.0).alias("sign"))
        went = postings.select(key, (1 + F.log(F.col("tf").cast("double"))).alias("w"), F.explode(F.array(*(slot(j) for j in range(self.spread)))).alias("s"))
        slots = went.groupBy(key, F.col("s.idx").alias("idx")).agg(F.sum(F.col("s.sign") * F.col("w")).alias("w")).where("abs(w) > 1e-9")
        norm = slots.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return slots.join(norm, key).select(key, "idx", (F.col("w") / F.col("norm")).alias("weight"))

    def arrays(self, chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """key, slots, weights with a row for each key."""
        dim, spread = self.dim, self.spread

        def slots(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            b = digest.astype(np.int64)
            idx = np.stack([(b[:, 2 * j] << 8 | b[:, 2 * j + 1]) % dim for j in range(spread)], axis=1)
            half = [b[:, 8 + j // 2] >> (0 if j % 2 else 4) & 15 for j in range(spread)]
            return idx, np.where(np.stack(half, axis=1) >= 8, 1.0, -1.0)

        return ranking.slot_vectors(chunks, key, text, slots, lambda tf: 1 + np.log(tf), 1e-9)


_models: dict[str, Callable] = {}


def _loaded(token: str, load: Callable[[], Callable]) -> Callable:
    """The model of a worker process, which outlives its tasks."""
    if token not in _models:
        _models.clear()  # one model at a time
        _models[token] = load()
    return _models[token]


@dataclass(frozen=True)
class ModelEmbedder:
    """Vectors by a model: ``load`` is called once in each worker process and gives a function from
    a list of texts (``batch`` at most) to a matrix. A null text counts as an empty one."""

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int
    batch: int = BATCH
    token: str = field(default_factory=lambda: uuid.uuid4().hex)
    dense = True
    from_postings = False

    def vectors(self, chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """key, embedding: unit vectors (zeros where the model gives zeros)."""
        load, batch, token = self.load, self.batch, self.token

        def embed(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _loaded(token, load)
            for texts in column:
                texts = texts.fillna("").tolist()
                parts = [np.asarray(model(texts[i : i + batch]), np.float64) for i in range(0, len(texts), batch)]
                yield pd.Series(list(ranking._unit(np.concatenate(parts))) if parts else [], dtype=object)

        return chunks.select(key, F.pandas_udf(embed, "array<double>")(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))

    def embed(self, chunks: DataFrame, key: str = "id", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
        return self.vectors(chunks, key, text).select(key, F.posexplode("embedding").alias("idx", "weight")).where("weight <> 0")


KINDS = {"hash": HashEmbedder, "projection": ProjectionEmbedder, "model": ModelEmbedder}


def embedder(kind: str = "hash", **options):
    """An embedder by its name: hash, projection or model."""
    if kind not in KINDS:
        raise ValueError(f"no embedder named {kind!r}; there are {', '.join(KINDS)}")
    return KINDS[kind](**options)
