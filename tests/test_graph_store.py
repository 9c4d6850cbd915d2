"""The graph store against merges in memory, and what a batch writes."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from tessera.plans.engine import KnowledgeBase
from tessera.sources.graph_store import GraphStore

TRIPLES = "subject_type string, subject string, rel string, object_type string, object string, doc_id string, seq long, props map<string,string>"


def batch(spark, n, seed, start=0):
    rng = random.Random(seed)
    rows = [("Ticket", f"t{rng.randint(0, n)}", "ABOUT_PRODUCT", "Product", f"p{rng.randint(0, n // 4)}", rng.choice([None, f"d{rng.randint(0, 9)}"]), start + i, rng.choice([None, {"k": str(i)}])) for i in range(n)]
    return rows, spark.createDataFrame(rows, TRIPLES)


def by_hand(batches):
    edges, links, nodes = {}, {}, {}
    for rows in batches:
        for st, s, r, ot, o, doc, seq, props in rows:
            e = (f"{st}:{s}", r, f"{ot}:{o}")
            edges[e] = min(seq, edges.get(e, seq))
            if doc is not None:
                links[(*e, doc)] = min(seq, links.get((*e, doc), seq))
            for key, p in ((e[0], None), (e[2], props)):
                node = nodes.setdefault(key, [seq, {}])
                node[0] = min(node[0], seq)
                node[1].update(p or {})
    return edges, links, nodes


def check(store, batches):
    edges, links, nodes = by_hand(batches)
    assert {(r.src, r.rel, r.dst): r.seq for r in store.edges().collect()} == edges
    assert {(r.src, r.rel, r.dst, r.doc_id): r.seq for r in store.links().collect()} == links
    assert {r.key: [r.seq, r.props or {}] for r in store.nodes().collect()} == nodes


def test_batches_merge_and_buckets_grow(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", rows=5)
    assert store.nodes().count() == store.edges().count() == 0 and store.last_seq() is None
    done = []
    for k, n in enumerate((20, 90, 5)):
        rows, df = batch(spark, n, k, start=1000 * k)
        store.upsert_triples(df)
        done.append(rows)
        check(store, done)
    assert store._buckets() > 2 and store.upsert_triples(df.limit(0)) == 0
    docs = {(r.src, r.rel, r.dst): r.docs for r in store.edges_with_docs().collect()}
    assert set(docs) == set(by_hand(done)[0]) and any(len(d) > 1 for d in docs.values()) and any(d == [] for d in docs.values())
    n = store._buckets()
    store.deal(1)  # fewer buckets are no present table
    assert store._buckets() == n
    store.clear()
    assert store.nodes().count() == store.edges().count() == store.links().count() == 0
    store.upsert_triples(df)
    check(store, [rows])


def test_what_a_batch_writes_does_not_grow_with_the_graph(spark, tmp_path):
    written = []
    for n in (400, 3000):
        store = GraphStore(spark, f"file://{tmp_path}/g{n}", rows=40)
        store.upsert_triples(batch(spark, n, n)[1])
        before = {f: f.stat().st_mtime_ns for f in Path(tmp_path, f"g{n}").rglob("*.parquet")}
        rows = store.upsert_triples(batch(spark, 10, 1)[1])
        fresh = [f for f in Path(tmp_path, f"g{n}").rglob("*.parquet") if f not in before]
        written.append((rows, sum(f.stat().st_size for f in fresh), len(fresh)))
    # ten triples touch 50 buckets at most, each of four times its size at most
    assert all(files <= 60 and rows <= 50 * 4 * 40 for rows, _, files in written) and written[1][1] < 3 * written[0][1]


def test_documents_go_with_what_only_they_state(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g", rows=4)
    rows = [("Document", "d1", "MENTIONS", "Product", "p", "d1", 1, None), ("Document", "d2", "MENTIONS", "Product", "p", "d2", 2, None), ("Ticket", "t", "ABOUT_PRODUCT", "Product", "p", "d1", 3, None), ("Ticket", "t", "ABOUT_PRODUCT", "Product", "p", "d2", 4, None), ("Ticket", "u", "ABOUT_PRODUCT", "Product", "p", None, 5, None)]
    store.upsert_triples(spark.createDataFrame(rows, TRIPLES))
    assert store.delete_documents(spark.createDataFrame([("d1",), ("none",)], "doc_id string")) == 1
    assert sorted(r.src for r in store.edges().collect()) == ["Document:d2", "Ticket:t", "Ticket:u"]
    assert sorted(r.key for r in store.nodes().collect()) == ["Document:d2", "Product:p", "Ticket:t", "Ticket:u"]
    assert {r.doc_id for r in store.links().collect()} == {"d2"}
    assert store.delete_documents(spark.createDataFrame([("d1",)], "doc_id string")) == 0


def test_a_named_batch_can_be_repeated(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    docs = spark.createDataFrame([("a", "物流配送：订单 48 小时内发货"), ("b", "退款：7 天内原路返回")], "doc_id string, text string")
    n = kb.ingest(docs, batch="first")
    counts = [t.count() for t in (kb.chunks, kb.postings, kb.vectors, kb.nodes, kb.edges)]
    kb.chunks.delete(F.col("doc_id") == "b")  # as if the last step had been lost
    assert kb.ingest(docs, batch="first") == 1 and kb.ingest(docs, batch="first") == 0
    assert [t.count() for t in (kb.chunks, kb.postings, kb.vectors, kb.nodes, kb.edges)] == counts
    assert kb.ingest(docs, batch="second") == n and kb.ingest(docs) == n
