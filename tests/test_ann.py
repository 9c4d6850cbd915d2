"""The inverted file against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, ranking

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n=600, d=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, d))
    return (centres[rng.integers(0, 15, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    m = clustered()
    rows = [(i, r.tolist()) for i, r in enumerate(m)]
    rows += [(1000 + i, m[7].tolist()) for i in range(250)]  # a third of all rows are one vector
    rows += [(2000, m[9].tolist()), (3000, None), (3001, []), (3002, [1.0, 2.0]), (3003, [0.0] * 12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def queries(table):
    return table.where("vec_id % 25 = 0 AND size(embedding) = 12").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def index(table):
    return ann.VectorIndex.build(table, cells=12)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "key", "score", "rank").collect()))


def exact(table, queries, k):
    return sorted((r.query_id, r.vec_id, r.score, r.rank) for r in ranking.vector_top_k(table, queries, k).collect())


@pytest.mark.parametrize("numbers", [ann.NUMBERS, 120])
def test_all_cells_give_the_exact_result(table, queries, index, monkeypatch, numbers):
    monkeypatch.setattr(ann, "NUMBERS", numbers)  # cells fall into parts, queries into blocks
    assert rows(index.search(queries, 10, 12)) == exact(table, queries, 10)


def test_every_row_is_filed_once(table, index):
    usual = {r.vec_id for r in table.where("size(embedding) = 12").collect()}
    single = {r.rep for r in index.vectors.where("n = 1").collect()}
    shared = [r.key for r in index.members.collect()]
    assert single | set(shared) == usual and len(single) + len(shared) == len(usual)
    assert index.vectors.agg(F.sum("n")).first()[0] == len(usual) and sum(index.rows.values()) == index.vectors.count()


def test_few_probes_find_most(table, queries, index):
    probes = index.tuned_probes(10, 0.95)
    assert 1 <= probes < 12
    got = ann.recall_against_exact(index, table, queries, 10, probes).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    assert got >= 0.9
    n = index.probed_rows(queries, probes)
    assert n.count() == queries.count() and n.agg(F.max("n_probed")).first()[0] < index.vectors.count()
    assert index.tuned_probes(10, 1.0) >= probes


def test_an_index_is_read_from_its_files(spark, index, queries):
    assert rows(ann.VectorIndex(spark, index.path).search(queries, 3, 2)) == rows(index.search(queries, 3, 2))


def test_odd_queries_and_tables(spark, index):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 12)], "query_id long, embedding array<float>")
    assert {r.query_id for r in index.search(odd, 2, 12).collect()} == {3}
    assert index.search(odd.limit(0), 2, 3).count() == 0
    one = ann.VectorIndex.build(spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 0.0])], SCHEMA))
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert rows(one.search(q, 5, 1)) == [(9, 4, 1.0, 1), (9, 5, 1.0, 2)]
    none = ann.VectorIndex.build(spark.createDataFrame([], SCHEMA))
    assert none.search(q, 5, 1).count() == 0 and none.tuned_probes(5) == 1
