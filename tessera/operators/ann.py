"""Approximate vector search by an inverted file.

Centroids are learnt from a bounded sample; every distinct vector is filed under the cell of its
nearest centroid, and a query looks only into the cells nearest to it. Queries meet the vectors
of a cell by an equi-join on (cell, part, block): a cell of any size is cut into parts, and the
queries that probe it into blocks, so no task holds more than ``NUMBERS`` numbers of each side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept, new_folder, stored
from .ranking import _unit, by_rows, vector_top_k

#: Vectors that the centroids are learnt from, at most about so many (all of a smaller table).
SAMPLE = 50_000
#: Passes over the sample.
PASSES = 8
#: Centroids at most; they are sent to all workers.
MOST_CELLS = 4096
#: Numbers of a part of a cell, and of a block of queries, in one task.
NUMBERS = 2_000_000
#: Queries (drawn from the index) on which the number of probes is chosen.
TUNING_QUERIES = 256


def nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells of each unit vector, nearest first; ties go to the lower number."""
    return np.argsort(-np.round(vectors @ centroids.T, 9), axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of arrays of one length."""
    flat = np.asarray(column.flatten(), np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def learn_centroids(vectors: DataFrame, cells: int, passes: int = PASSES, seed: int = 0) -> np.ndarray:
    """Unit centroids of ``vectors`` (one column, ``vector``) by cosine k-means; ``vectors`` is a
    bounded sample, and the result has ``cells`` rows at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), initMode="random", maxIter=passes, seed=seed, distanceMeasure="cosine").fit(features)
    return _unit(np.array(model.clusterCenters(), np.float64))


class VectorIndex:
    """An index in files under ``path``:

    * ``vectors``: rep, n, vector, cell, sorted by cell: each distinct vector once. ``rep`` is the
      smallest key that has it and ``n`` how many have it, so copies cost nothing in a search;
    * ``members``: rep, key of vectors that several keys have;
    * ``centroids``: cell, vector, rows.

    Null vectors and those of another length than most are not filed: they are no hits of an
    exact search for a query of the usual length either.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.vectors = spark.read.parquet(f"{path}/vectors")
        self.members = spark.read.parquet(f"{path}/members")
        # one row for each centroid
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        self.centroids = np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1)
        self.rows = {r.cell: r.rows for r in rows}

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, passes: int = PASSES, seed: int = 0) -> VectorIndex:
        """File every row of ``vectors``. By default there are as many cells as the root of the
        number of rows, ``MOST_CELLS`` at most. The sample is a share of the rows by a hash of
        their keys, without copies."""
        spark = vectors.sparkSession
        path = path or new_folder(spark, "index")
        own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).where(F.size("vector") > 0)
        sizes = own.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        n, d = (sizes.n, sizes.d) if sizes else (0, 0)
        own = own.where(F.size("vector") == d)
        if cells is None:
            cells = min(MOST_CELLS, int(np.ceil(np.sqrt(n))))
        share = min(1.0, SAMPLE / max(1, n))
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        sample = stored(own.where((F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))) & (norm > 0)).select("vector").distinct(), "sample")
        distinct = sample.count()
        if distinct >= 2:
            centroids = learn_centroids(sample, min(cells, distinct), passes, seed)
        else:
            centroids = np.zeros((1, max(1, d)))
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = nearest(_matrix(batch.column("vector")), shared.value, 1)[:, 0] if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

        classes = own.groupBy("vector").agg(F.min("key").alias("rep"), F.count("*").alias("n")).select("rep", "n", "vector")
        kind = dict(own.dtypes)["vector"]
        filed = classes.mapInArrow(assign, f"rep long, n long, vector {kind}, cell int")
        # ranges of (cell, rep) are even however the cells are filled
        filed = kept(filed.repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep"), f"{path}/vectors")
        print_of = (F.xxhash64("vector").alias("fa"), F.xxhash64(F.lit(1), "vector").alias("fb"))
        shared_ones = filed.where("n > 1").select("rep", *print_of)
        kept(own.select("key", *print_of).join(by_rows(shared_ones), ["fa", "fb"]).select("rep", "key"), f"{path}/members")
        counts = {r.cell: r.n for r in filed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
        table = [(i, c.tolist(), counts.get(i, 0)) for i, c in enumerate(centroids)]
        spark.createDataFrame(table, "cell int, vector array<double>, rows long").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(spark, path)

    # ------------------------------------------------------------ probing

    def probes(self, queries: DataFrame, probes: int, vector: str = "embedding") -> DataFrame:
        """query_id, vector, cell, place: the cells that each query looks into, nearest first.
        Queries without a vector of the index's length have no rows."""
        shared, n = self.spark.sparkContext.broadcast(self.centroids), max(1, min(probes, len(self.centroids)))

        def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                cells = nearest(_matrix(batch.column(1)), shared.value, n)
                again = np.repeat(np.arange(len(batch)), n)
                place = np.tile(np.arange(n), len(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)), pa.array(cells.ravel(), pa.int32()), pa.array(place, pa.int32())],
                    names=["query_id", "vector", "cell", "place"],
                )

        own = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("vector")).where(F.size("vector") == self.centroids.shape[1])
        return own.mapInArrow(probe, f"query_id long, vector {dict(own.dtypes)['vector']}, cell int, place int")

    def probed_rows(self, queries: DataFrame, probes: int, vector: str = "embedding") -> DataFrame:
        """query_id, n_probed: how many distinct vectors each query is compared with."""
        rows = self.spark.createDataFrame(list(self.rows.items()), "cell int, rows long")
        found = self.probes(queries, probes, vector).select("query_id", "cell").join(F.broadcast(rows), "cell")  # MOST_CELLS rows at most
        return found.groupBy("query_id").agg(F.sum("rows").alias("n_probed"))

    def search(self, queries: DataFrame, k: int, probes: int, vector: str = "embedding") -> DataFrame:
        """query_id, key, score, rank: the ``k`` most similar vectors in the probed cells, ties by
        key. With all cells probed the result is that of the exact search."""
        best = self._best(self.probes(queries, probes, vector), k)
        single = best.where("n = 1").select("query_id", F.col("rep").alias("key"), "score")
        # of many copies only the first k can be among the k best
        first = F.row_number().over(Window.partitionBy("rep").orderBy("key"))
        copies = self.members.withColumn("_k", first).where(F.col("_k") <= k).select("rep", "key")
        several = best.where("n > 1").join(copies, "rep").select("query_id", "key", "score")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return single.unionByName(several).withColumn("rank", rank).where(F.col("rank") <= k)

    def _best(self, probed: DataFrame, k: int) -> DataFrame:
        """query_id, rep, n, cell, score: the k best distinct vectors of each query."""
        spark, d = self.spark, self.centroids.shape[1]
        probed = stored(probed.select("query_id", "vector", "cell"), "probes")
        most = max(1, NUMBERS // d)
        asked = {r.cell: r.n for r in probed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
        shape = [(c, max(1, -(-self.rows.get(c, 0) // most)), -(-n // most)) for c, n in asked.items() if self.rows.get(c, 0)]
        shape = F.broadcast(spark.createDataFrame(shape, "cell int, parts int, blocks int"))  # MOST_CELLS rows at most
        rows = self.vectors.where(F.col("cell").isin(list(asked))).join(shape, "cell")
        rows = rows.select("cell", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "n", "vector")
        asks = probed.join(shape, "cell")
        asks = asks.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "vector")

        def score(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(there):
                return pd.DataFrame({"query_id": [], "rep": [], "n": [], "cell": [], "score": []})
            q, v = (_unit(np.stack([np.asarray(x, np.float64) for x in side["vector"]])) for side in (asked, there))
            scores = np.round(q @ v.T, 6) + 0.0
            reps = there["rep"].to_numpy()
            order = np.lexsort((np.broadcast_to(reps, scores.shape), -scores), axis=1)[:, :k]
            return pd.DataFrame({
                "query_id": np.repeat(asked["query_id"].to_numpy(), order.shape[1]), "rep": reps[order].ravel(), "n": there["n"].to_numpy()[order].ravel(),
                "cell": np.full(order.size, there["cell"].iloc[0]), "score": np.take_along_axis(scores, order, 1).ravel(),
            })

        keys = ("cell", "part", "block")
        found = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(score, "query_id long, rep long, n long, cell int, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))
        return found.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")

    # ------------------------------------------------------------ choosing the probes

    def tuned_probes(self, k: int, recall: float = 0.95, queries: int = TUNING_QUERIES) -> int:
        """The fewest probes at which queries like the filed vectors find ``recall`` of their ``k``
        nearest. About ``queries`` filed vectors are searched once in all cells; the place of
        each hit's cell among the query's own says from which number of probes on it is found."""
        total = sum(self.rows.values())
        share = min(1.0, queries / max(1, total))
        drawn = self.vectors.where(F.pmod(F.xxhash64(F.lit(2), "rep"), F.lit(1 << 30)) < int(share * (1 << 30)))
        drawn = stored(drawn.select(F.col("rep").alias("query_id"), F.col("vector").alias("embedding")), "tuning")
        order = stored(self.probes(drawn, len(self.centroids)).select("query_id", "vector", "cell", "place"), "order")
        hits = self._best(order, k).select("query_id", "cell").join(order.select("query_id", "cell", "place"), ["query_id", "cell"])
        at = {r.place: r.n for r in hits.groupBy("place").agg(F.count("*").alias("n")).collect()}  # one row for each number of probes
        want, seen = recall * sum(at.values()), 0
        for place in sorted(at):
            seen += at[place]
            if seen >= want:
                return place + 1
        return len(self.centroids)


def recall_against_exact(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, probes: int, exact: Callable[..., DataFrame] = vector_top_k) -> DataFrame:
    """query_id, n_exact, n_found: how many of the ``k`` exact hits of each query the index finds.
    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding."""
    true = exact(vectors, queries, k).select("query_id", F.col("vec_id").alias("key"))
    found = index.search(queries, k, probes).select("query_id", "key", F.lit(1).alias("hit"))
    return true.join(found, ["query_id", "key"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
