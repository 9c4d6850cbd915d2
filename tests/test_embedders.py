"""Embedders behind one signature, in searches and in the knowledge base."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedders, ranking
from tessera.plans.engine import KnowledgeBase

CHUNKS = [(0, "red apples and green pears"), (1, "order shipped by rail"), (2, "refund within seven days"), (3, ""), (4, None)]


def counting():
    """How to load a model that counts letters; it takes three texts at once at most."""

    def load():
        def model(texts):
            assert 0 < len(texts) <= 3
            return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)

        return model

    return load


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id long, text string").repartition(2)


def makers():
    return {"hash": embedders.embedder("hash", dim=64), "projection": embedders.embedder("projection", dim=64), "model": embedders.embedder("model", load=counting(), dim=26, batch=3)}


@pytest.mark.parametrize("kind", ["hash", "projection", "model"])
def test_vectors_have_length_one(chunks, kind):
    own = makers()[kind]
    rows = own.embed(chunks).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"), F.max("idx").alias("i")).collect()
    assert {r.id for r in rows} == {0, 1, 2} and all(r.n == pytest.approx(1) and r.i < own.dim for r in rows)
    assert own.embed(chunks.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["hash", "projection", "model"])
@pytest.mark.parametrize("mode", ["vector", "hybrid"])
def test_searches_take_any(spark, chunks, kind, mode):
    q = spark.createDataFrame([(1, "order shipped by rail"), (2, "refund within days")], "query_id long, query string")
    hits = ranking.hybrid_search(chunks, q, 2, mode, embedder=makers()[kind], lam=0.6)
    assert {r.query_id: r.id for r in hits.where("rank = 1").collect()} == {1: 1, 2: 2}


def test_batches_of_a_model(spark):
    many = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string").repartition(3)
    assert makers()["model"].vectors(many).where("size(embedding) = 26").count() == 50


def test_projection_against_numpy(spark, chunks):
    import hashlib
    import math

    got = {}
    for r in embedders.ProjectionEmbedder(dim=32, spread=3).embed(chunks).collect():
        got.setdefault(r.id, np.zeros(32))[r.idx] = r.weight
    for i, text in CHUNKS[:3]:
        v = np.zeros(32)
        for term in set(text.split()):
            d = hashlib.md5(term.encode()).hexdigest()
            for j in range(3):
                v[int(d[4 * j : 4 * j + 4], 16) % 32] += (1 if int(d[16 + j], 16) >= 8 else -1) * (1 + math.log(text.split().count(term)))
        assert np.allclose(got[i], v / np.linalg.norm(v))
    with pytest.raises(ValueError):
        embedders.embedder("ghost")


def test_a_knowledge_base_changes_its_embedder(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", embedders.ProjectionEmbedder(64))
    kb.ingest(spark.createDataFrame([("a", "apples and pears"), ("b", "refund within seven days")], "doc_id string, text string"))
    q = spark.createDataFrame([(1, "refund days")], "query_id long, query string")
    assert kb.vectors.read().agg(F.max("idx")).first()[0] < 64 and kb.search(q, 1).first().doc_id == "b"
    for other in (32, embedders.ModelEmbedder(counting(), 26, 3), embedders.HashEmbedder()):
        assert kb.reembed(other) == kb.chunks.count() and kb.search(q, 1).first().doc_id == "b"


def test_projection_of_texts_shuffles_no_terms(spark):
    chunks = spark.createDataFrame([(1, "a b b c"), (2, "物流 a"), (3, ""), (4, None)], "id long, text string")
    e = embedders.embedder("projection")
    got = e.embed(chunks)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = lambda df: sorted((r.id, r.idx, round(r.weight, 9)) for r in df.collect())
    assert plain(got) == plain(e.embed(chunks, postings=ranking.term_frequencies(chunks)))


@pytest.mark.parametrize("kind", ["hash", "projection"])
@pytest.mark.parametrize("rows, most", [(1, 10_000), (10_000, 10_000), (10_000, 2), (1, 1)])
def test_rows_of_a_key_make_one_vector(spark, monkeypatch, kind, rows, most):
    """As the text that they make together, and lists of terms are dealt once, by key, unless it has very many rows."""
    monkeypatch.setattr(ranking, "KEY_ROWS", most)
    some = [(1, "a b b c"), (2, "物流 a"), (1, "a a"), (3, ""), (1, None), (None, "x y"), (2, "b"), (4, "d"), (None, "x"), (1, "c d e"), (3, None)]
    chunks = spark.createDataFrame(some, "id long, text string").repartition(3)
    joined = {i: " ".join(t or "" for k, t in some if k == i) for i, _ in some}
    e, size = embedders.embedder(kind), "spark.sql.execution.arrow.maxRecordsPerBatch"
    plain = lambda df: sorted(((r.id or 0), r.idx, round(r.weight, 9)) for r in df.collect())
    want = plain(e.embed(spark.createDataFrame(list(joined.items()), "id long, text string")))
    before = spark.conf.get(size)
    spark.conf.set(size, str(rows))
    try:
        got = e.embed(chunks)
        assert plain(got) == want
        assert most < 10 or got._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 2  # the test's own and one more
    finally:
        spark.conf.set(size, before)


def test_search_by_rows_of_a_key(spark):
    rows = [(1, "order shipped"), (1, "by rail"), (2, "order by"), (3, "refund")]
    q = spark.createDataFrame([(7, "order shipped by rail")], "query_id long, query string")
    for kind in ("hash", "projection"):
        hits = ranking.hybrid_search(spark.createDataFrame(rows, "id long, text string"), q, 5, "vector", embedder=makers()[kind])
        first = hits.where("rank = 1").first()
        assert first.id == 1 and first.vec_score == pytest.approx(1)
