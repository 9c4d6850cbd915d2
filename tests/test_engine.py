"""Chunks, graph, extraction, lookups, actions, evaluation, state machines and the facade."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.json_paths import at_path, json_leaf_paths, json_object_in, leaf_paths
from tessera.operators import agents, answers, chunking, evaluation, extraction, graph, live, logs
from tessera.plans.engine import KnowledgeBase, agent_layers
from tessera.sources.files import docx_text, read_files, read_folder, read_golden
from tessera.sources.tables import VersionedTable
from tessera.streaming import state

GUIDE = "# SLA 手册\n响应：P0 15 分钟，P1 1 小时，P2 4 小时\nQ：多久发货？\nA：48 小时内\n可用性 99.9%"


def test_structured_chunks():
    units = chunking.structured_units(GUIDE)
    assert len(units) == 5 and all(u.startswith("SLA 手册 / ") for u in units)
    p0 = [u for u in units if "P0" in u]
    assert len(p0) == 1 and "15 分钟" in p0[0] and "4 小时" not in p0[0]
    assert any("多久发货" in u and "48 小时" in u for u in units)
    assert chunking.structured_units("  \n ") == [] and chunking.structured_units("# only") == ["# only"]
    assert chunking.structured_units("Q：a\nQ：b\n# h\nA：c") == ["Q：a", "Q：b", "h / c"]


@pytest.mark.parametrize("text", ["x" * 900, "句子。" * 200, "a" * 150 + "。" + "b" * 400, ""])
def test_windows_cover_the_text(text):
    parts = chunking.windows_of(text)
    assert all(0 < len(p) <= 300 for p in parts)
    assert text == "" or (text.startswith(parts[0]) and text.endswith(parts[-1]) and set("".join(parts)) == set(text))
    if text == "x" * 900:
        assert len(parts) == 4


def test_chunk_tables(spark):
    docs = spark.createDataFrame([("a", GUIDE), ("b", None), ("c", "")], "doc_id string, text string")
    made = chunking.chunk(docs)
    assert made.count() == 5 and chunking.chunk(docs, strategy="plain").count() == 1
    assert chunking.enumerated_lines(docs.where("doc_id = 'a'")).count() == 7
    listed = chunking.document_list(made).first()
    assert listed.n_chunks == 5 and len(listed.preview) <= 60
    assert chunking.document_text(made).first().text.count("\n") == 4


def random_graph(spark, seed):
    rng = random.Random(seed)
    names = "abcdefgh"
    rows = {(rng.choice(names), rng.choice("RS"), rng.choice(names)) for _ in range(14)}
    edges = sorted(rows)
    df = spark.createDataFrame([(s, r, d, ["x"], i) for i, (s, r, d) in enumerate(edges)], "src string, rel string, dst string, docs array<string>, seq long")
    return names, edges, df


@pytest.mark.parametrize("seed, direction, rel", [(1, "out", None), (2, "both", None), (3, "in", "R")])
def test_neighbours_against_search(spark, seed, direction, rel):
    names, edges, df = random_graph(spark, seed)
    starts = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "query_id int, key string")
    got = {(r.query_id, r.key): (r.depth, len(r.path)) for r in graph.neighbours(starts, df, 3, direction, rel).collect()}
    want = {}
    for i, n in enumerate(names):
        seen, front = {n}, [n]
        for d in (1, 2, 3):
            step = {y for x in front for s, r, t in edges if rel in (None, r) for y in ([t] if s == x and direction != "in" else []) + ([s] if t == x and direction != "out" else [])}
            front = step - seen
            seen |= front
            want.update({(i, y): (d, d) for y in front})
    assert got == want


def test_simple_paths_against_search(spark):
    names, edges, df = random_graph(spark, 4)
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "c", "c"), (2, "a", "h")], "query_id int, src string, dst string")
    got = {(r.query_id, tuple(r.nodes)) for r in graph.simple_paths(pairs, df, 4, 1000).collect()}
    links = {(s, d) for s, _, d in edges} | {(d, s) for s, _, d in edges}

    def walk(path, end):
        if path[-1] == end:
            yield tuple(path)
        elif len(path) < 5:
            for x in names:
                if (path[-1], x) in links and x not in path:
                    yield from walk([*path, x], end)

    assert got == {(q, p) for q, a, b in ((0, "a", "b"), (2, "a", "h")) for p in walk([a], b)}


def test_ontology_nodes_edges_and_deletes(spark):
    t = [
        ("Document", "d1", "MENTIONS", "IssueCategory", "c", "d1", 1), ("Document", "d2", "MENTIONS", "IssueCategory", "c", "d2", 2), ("IssueCategory", "c", "GOVERNED_BY", "SLAClause", "s", "d1", 3),
        ("IssueCategory", "c", "GOVERNED_BY", "SLAClause", "s", "d2", 4), ("SLAClause", "s", "GOVERNED_BY", "IssueCategory", "c", "d1", 5), ("Document", " ", "MENTIONS", "Product", "p", "d1", 6), ("Alien", "x", "MENTIONS", "Product", "p", "d1", 7),
    ]
    df = spark.createDataFrame(t, "subject_type string, subject string, rel string, object_type string, object string, doc_id string, seq long")
    schema = graph.relation_schema(spark)
    ok = graph.valid_triples(df, schema)
    assert ok.count() == 4 and graph.invalid_triples(df, schema).count() == 3
    nodes, edges = graph.nodes_of(ok), graph.edges_of(ok)
    assert {r.key for r in nodes.collect()} == {"Document:d1", "Document:d2", "IssueCategory:c", "SLAClause:s"} and edges.count() == 3
    n1, e1 = graph.delete_document(nodes, edges, spark.createDataFrame([("d1",)], "doc_id string"))
    assert {r.key for r in n1.collect()} == {"Document:d2", "IssueCategory:c", "SLAClause:s"} and e1.count() == 2
    facts = graph.expand_facts(spark.createDataFrame([(1, "c", 0)], "query_id int, name string, seq long"), nodes, edges).collect()
    assert any(f.path == "IssueCategory:c --GOVERNED_BY--> SLAClause:s" for f in facts) and len(facts) == 3
    found = graph.resolve(spark.createDataFrame([(1, "SLAClause:s"), (2, "d"), (3, "zz"), (4, "the c of it")], "query_id int, name string"), nodes)
    assert {r.query_id: r.key for r in found.collect()} == {1: "SLAClause:s", 2: "Document:d1", 4: "IssueCategory:c"}


def test_extraction(spark):
    text = "示例科技公司的工单TK12345：物流配送延迟，快递 48小时内发货，因为仓库爆满，可换货。企业版 SLA 支持"
    got = extraction.triples_of(text, "d")
    rels = {(t[2], t[3], t[4]) for t in got}
    assert ("MENTIONS", "IssueCategory", "物流配送") in rels and ("GOVERNED_BY", "SLAClause", "48小时内发货") in rels
    assert ("SOLVED_BY", "Solution", "换货") in rels and ("CAUSED_BY", "RootCause", "仓库爆满") in rels and any(r[0] == "SUBMITTED_BY" for r in rels)
    df = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    assert extraction.extract_triples(df).count() == len(got)
    assert [(r.category, r.n) for r in extraction.match_categories(df).orderBy("rank").collect()][0] == ("物流配送", 4)
    assert extraction.parse_llm_triples('ok [{"subject":"a","subject_type":"b","relation":"c","object":"d","object_type":"e"}, 3] bye') and extraction.parse_llm_triples("no") == []


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(T.comparable(lit(s))) for s in ("四十八 小时", "七天内", "十", "二十", "ＡＢ　十五个小时", "二十三十")] == ["48小时", "7日", "10", "20", "ab15小时", "2310"]
    assert [one(T.says(lit(t), lit(k))) for t, k in (("48 小时内出库", "8 小时"), ("8 小时内", "8 小时"), ("215 分钟", "15 分钟"), ("21.9 分钟", "1.9 分钟"), ("x", ""))] == [False, True, False, False, False]
    assert one(T.answer_body(lit("【实时数据】\na\n【关系路径】\nb\n【知识依据】\nc"))).split() == ["a", "c"]
    assert one(T.without_question(lit("多久？ 三天"))) == "三天" and one(T.without_question(lit("多久？"))) == "多久？"
    assert one(T.refund_amount(lit("订单 SO123 退款 88 元"))) == 88.0 and one(T.order_id(lit("so-12345 x"))) == "SO-12345"
    assert one(T.intent(lit("我要投诉并退款"))) == "request_refund" and one(T.intent(lit("hi"))) is None
    assert [one(T.retryable(lit(c))) for c in (404, 408, 429, 500)] == [False, True, True, True] and one(T.backoff(lit(9))) == 8.0
    assert one(T.int_or(lit("x"), 3)) == 3 and one(T.int_or(lit("-2"), 3, 1)) == 1
    assert one(T.masked(lit("abcdefghijkl"))) == "abcd...ijkl"


def test_json(spark):
    doc = '{"a": {"b": [{"c": 1}, {"c": 2}]}, "d": null, "e": []}'
    assert leaf_paths({"a": {"b": [{"c": 1}]}, "d": None, "e": []}) == ["a.b[0].c", "d"]
    df = spark.createDataFrame([(doc,), ("bad",), (None,)], "j string")
    assert [r[0] for r in df.select(json_leaf_paths("j")).collect()] == [["a.b[0].c", "d"], [], []]
    assert df.select(at_path(F.col("j"), "a.b[1].c")).first()[0] == "2"
    assert spark.range(1).select(json_object_in(F.lit('x {"a": 1} y'))).first()[0] == '{"a": 1}'


def test_lookups(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "query_id int, order_id string")
    known = spark.createDataFrame([("a", "sent"), ("c", "lost")], "order_id string, status string")
    bad = spark.createDataFrame([("c", "503", 3)], "order_id string, error string, attempts int")
    got = {r.query_id: (r.outcome, r.status) for r in live.lookup(q, known, bad, "order_id").collect()}
    assert got == {1: ("found", "sent"), 2: ("not_found", None), 3: ("unavailable", "lost"), 4: ("not_asked", None)}
    r = spark.createDataFrame([(1, "k", 100.0), (2, "k", 131.0), (3, "z", 5.0)], "request_id int, k string, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    f = spark.createDataFrame([("k", 90.0, "v1"), ("k", 101.0, "v2")], "k string, s double, value string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert {x.request_id: (x.value, x.cached) for x in live.latest_within(r, f, "k", 30).collect()} == {1: ("v1", True), 2: (None, False), 3: (None, False)}


def test_actions(spark):
    cols = "action string, order_id string, field string, value string, amount double, subject string, priority string, confirmed boolean"
    rows = [
        ("create_ticket", None, None, None, None, "s", "P9", False), ("create_ticket", None, None, None, None, "s", None, False), ("request_refund", "1", None, None, 5.0, None, None, False),
        ("request_refund", "1", None, None, 5.0, None, None, True), ("request_refund", "1", None, None, -5.0, None, None, True), ("request_refund", "", None, None, None, None, None, True),
        ("update_order", "1", "color", "x", None, None, None, False), ("nope", None, None, None, None, None, None, True), ("list_tickets", None, None, None, None, None, None, None),
    ]
    got = [(r.status, r.error) for r in live.action_status(spark.createDataFrame(rows, cols).coalesce(1)).collect()]
    assert got == [("rejected", "bad priority"), ("executed", None), ("needs_confirmation", None), ("executed", None), ("rejected", "bad amount"), ("rejected", "missing: order_id,amount"), ("rejected", "bad field"), ("rejected", "unknown action"), ("executed", None)]


def test_answers_and_evaluation(spark):
    e = spark.createDataFrame([(1, ["did"], ["live"], ["p1"], ["多久？ 48 小时"]), (2, [], [], [], [])], "query_id int, actions array<string>, live array<string>, paths array<string>, hits array<string>")
    got = {r.query_id: (r.summary, r.answer) for r in answers.synthesise(e).collect()}
    assert got[1] == ("48 小时", "【执行动作】\n- did\n【实时数据】\nlive\n【关系路径】\n1. p1\n【知识依据】\n1. 48 小时") and got[2][0] == got[2][1] != ""
    c = spark.createDataFrame([("48小时内出库", [["48 小时"], ["没有", "出库"], ["不"]], ["x"], 0.5, 0.0), ("a x", [["a"]], ["x"], 0.5, 0.0), ("a", [["a"]], [], 0.1, 0.5), (None, None, None, None, None)], "answer string, expect array<array<string>>, forbid array<string>, confidence double, min_confidence double").coalesce(1)
    j = evaluation.judge_answers(c)
    assert [(round(r.recall, 2), r.passed) for r in j.collect()] == [(0.67, True), (1.0, False), (1.0, False), (0.0, False)]
    s = evaluation.summarise(j).first()
    assert (s.total, s.passed, s.pass_rate) == (4, 1, 0.25) and evaluation.summarise(j.limit(0)).first().pass_rate == 0
    v = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 9, None or 3]], "v double")
    assert [r.value for r in evaluation.nearest_rank(v, "v", (0, 0.5, 0.95, 1)).orderBy("q").collect()] == [1, 3, 9, 9]


def test_state_machines(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(i // 2), i, rng.random() > 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "client string, ts double, place long, ok boolean")
    got = {r.place: (r.n, r.admitted) for r in state.limit_requests(df, 3, 5).collect()}
    windows = {}
    for c, ts, place, _ in rows:
        start, n = windows.get(c, (None, 0))
        start, n = (ts, 1) if start is None or ts - start >= 5 else (start, n + 1)
        windows[c] = start, n
        assert got[place] == (n, n <= 3)
    states = {r.place: (r.called, r.state) for r in state.breaker_states(df.withColumnRenamed("client", "backend"), 2, 3).collect()}
    assert len(states) == 80 and {s for _, s in states.values()} <= {"open", "closed"}
    s = None
    for ts, ok, want in ((0, False, (True, "closed")), (1, False, (True, "open")), (2, True, (False, "open")), (4.5, False, (True, "open")), (5, True, (False, "open")), (9, True, (True, "closed"))):
        s, *got1 = state.breaker_step(s, ts, ok, 2, 3)
        assert tuple(got1) == want
    assert state.retry([(False, 500), (False, None), (True, 200)]) == (True, 3, 1.5) and state.retry([(False, 404), (True, 200)]) == (False, 1, 0.0)


def test_logs(spark):
    calls = spark.createDataFrame([("k", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1])], "k string, i int, f int")
    runs = sorted((r.length, r.opens) for r in logs.failure_runs(calls, "k", ["i"], F.col("f") == 1, 3).collect())
    assert runs == [(2, False), (3, True)] and [r.i for r in logs.tail(calls, "i", 2).collect()] == [5, 4]


def test_tables_and_files(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "a int")
    assert t.count() == 0
    t.append(spark.createDataFrame([(1,), (2,)], "a int"))
    t.append(spark.createDataFrame([(3,)], "a int"))
    assert t.count() == 3 and t.delete(F.col("a") > 1) == 2 and t.delete(F.col("a") > 5) == 0 and t.count() == 1
    folder = tmp_path / "docs" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.b.md").write_text("---\nx: 1\n---\nHello ```code``` world")
    (tmp_path / "docs" / "n.txt").write_text("plain")
    (tmp_path / "docs" / "skip.bin").write_text("no")
    (tmp_path / "docs" / "bad.docx").write_text("not a zip")
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in ("one", " ", "two"))
    with zipfile.ZipFile(tmp_path / "docs" / "w.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    assert docx_text((tmp_path / "docs" / "w.docx").read_bytes()) == "one\ntwo"
    ok, failed = read_folder(spark, f"{tmp_path}/docs", "p_")
    assert {r.doc_id: r.text for r in ok.collect()} == {"p_sub_a.b": "Hello   world", "p_n": "plain", "p_w": "one\ntwo"} and failed.count() == 1
    (tmp_path / "g.jsonl").write_text('{"question": "q", "expect_contains": ["a", ["b", "c"]]}\n{"question": "r"}\n')
    (tmp_path / "g.json").write_text('[{"question": "q", "expect_contains": ["a", ["b", "c"]]}, {"question": "r", "min_confidence": 0.5}]')
    for name in ("g.jsonl", "g.json"):
        rows = {r.question: r.expect for r in read_golden(spark, f"{tmp_path}/{name}").collect()}
        assert rows == {"q": [["a"], ["b", "c"]], "r": []}


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    docs = spark.createDataFrame([("guide", GUIDE), ("ship", "物流配送：订单 48 小时内发货，可换货")], "doc_id string, text string")
    assert kb.ingest(docs) == 6 and {r.doc_id for r in kb.documents().collect()} == {"guide", "ship"}
    q = spark.createDataFrame([(1, "订单多久发货", "A1", None), (2, "P0 响应", None, "S1"), (3, "库存", None, None)], "query_id long, query string, order_id string, sku string")
    orders = spark.createDataFrame([("A1", "sent", "SF", "soon")], "order_id string, status string, carrier string, eta string")
    stock = spark.createDataFrame([("S1", 4, "W")], "sku string, stock int, warehouse string")
    got = {r.query_id: r for r in kb.ask(q, orders, stock).collect()}
    assert "订单 A1：sent" in got[1].answer and "15 分钟" in got[2].answer and "SKU S1：库存 4" in got[2].answer and "请提供 SKU" in got[3].answer
    n = {(r.what, r.name): r.n for r in kb.graph_stats().collect()}
    assert n[("type", "IssueCategory")] >= 1 and kb.graph_entities("物流").count() == 1
    assert {(r.what, r.name): r.n for r in kb.rebuild_graph().collect()}[("type", "IssueCategory")] >= 1
    done = kb.run_actions(kb.requested(spark.createDataFrame([(1, "投诉 快递太慢", None)], "query_id long, query string, order_id string")))
    assert done.first().status == "executed" and kb.tickets().count() == 1
    ask = lambda i, text: spark.createDataFrame([(i, text, None, "ACME", "S1")], "query_id long, query string, order_id string, customer string, sku string")
    kb.run_actions(kb.requested(ask(2, "投诉 第二次")), to_graph=True)
    newest = kb.tickets().collect()
    assert [t.subject for t in newest] == ["投诉 第二次", "投诉 快递太慢"] and len({t.seq for t in newest}) == 2
    ticket = kb.nodes.read().where("type = 'Ticket'").first()
    assert ticket.name == newest[0].ticket_id and ticket.props["status"] == "open" and ticket.props["subject"] == "投诉 第二次"
    made = {(e.rel, e.dst, tuple(e.docs)) for e in kb.edges.read().where(F.col("src") == ticket.key).collect()}
    assert made == {("SUBMITTED_BY", "Customer:ACME", ()), ("ABOUT_PRODUCT", "Product:S1", ())}
    assert kb.reembed(64) == 6 and kb.vectors.read().agg(F.max("idx")).first()[0] < 64 and kb.search(q, 2).count() > 0
    by_length = lambda pairs: pairs.select("query_id", "id", F.length("text").cast("double").alias("score"))
    ranked = kb.search(q, 3, lam=None, rerank=by_length).where("query_id = 2").orderBy("rank").collect()
    assert [len(r.content) for r in ranked] == sorted((len(r.content) for r in ranked), reverse=True)
    assert kb.delete_document("ship") == 1 and kb.documents().count() == 1
    assert agent_layers({"a": [], "b": ["a"], "c": ["b", "x"], "d": ["e"], "e": ["d"]}) == [["a"], ["b"], ["c"], ["d", "e"]]


def test_deleting_a_document_keeps_edges_without_documents(spark):
    nodes = spark.createDataFrame([("Document:d", "Document", "d")], "key string, type string, name string")
    rows = [("a", "r", "b", ["d"], 1), ("a", "r", "c", ["d", "e"], 2), ("a", "s", "c", [], 3)]
    edges = spark.createDataFrame(rows, "src string, rel string, dst string, docs array<string>, seq long")
    left = graph.delete_document(nodes, edges, spark.createDataFrame([("d",)], "doc_id string"))[1]
    assert sorted((e.rel, e.dst, e.docs) for e in left.collect()) == [("r", "c", ["e"]), ("s", "c", [])]


def test_malformed_bytes_do_not_stop_a_scan(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"one \xff two")
    (tmp_path / "good.txt").write_bytes("三".encode())
    assert {r.text for r in read_files(spark, str(tmp_path)).collect()} == {"one � two", "三"}


def test_upserts_merge_props_and_count(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    cols = "subject_type string, subject string, rel string, object_type string, object string, doc_id string, seq long, props map<string,string>"
    triple = lambda doc, i, props: ("Document", doc, "MENTIONS", "Product", "p", doc, i, props)
    first = [triple("d1", 5, {"a": "1", "b": "1", "evidence": "x"}), ("Alien", "x", "MENTIONS", "Product", "p", "d1", 6, None)]
    assert kb.add_triples(spark.createDataFrame(first, cols)) == {"added": 1, "skipped": 0, "invalid": 1}
    again = [triple("d1", 0, None), triple("d2", 0, {"b": "2", "evidence": "y"})]
    assert kb.add_triples(spark.createDataFrame(again, cols)) == {"added": 1, "skipped": 1, "invalid": 0}
    node = kb.nodes.read().where("key = 'Product:p'").first()
    assert node.props == {"a": "1", "b": "2", "evidence": "x"} and node.docs == ["d1", "d2"] and node.seq == 5
    many = [triple(f"e{i}", i, None) for i in range(9)]
    kb.add_triples(spark.createDataFrame(many, cols))
    assert kb.nodes.read().where("key = 'Product:p'").first().docs == ["d1", "d2", "e0", "e1", "e2"] and kb.edges.count() == 11
    kb.clear_graph()
    assert kb.nodes.count() == kb.edges.count() == 0


def test_agents_take_odd_rows(spark):
    registry = spark.createDataFrame([("Searcher", ["retrieval"], 0), ("g", ["graph"], 1)], "agent string, capabilities array<string>, seq int")
    asked = spark.createDataFrame([(1, None, False), (2, False, True), (3, False, False)], "query_id int, need_graph boolean, need_live boolean")
    # nobody can do live: that step has no agent
    assert sorted((r.query_id, r.agent) for r in agents.plan(asked, registry).collect()) == [(1, "Searcher"), (1, "g"), (2, "Searcher"), (3, "Searcher")]
    said = [(1, '{"subtasks": [{"agent": " G "}, {"agent": "g"}, {"capability": "Retrieval"}]}'), (2, None), (3, '{"subtasks": "x"}')]
    made = agents.plan_from_answers(spark.createDataFrame(said, "query_id int, answer string"), asked, registry)
    assert sorted((r.query_id, r.step, r.agent) for r in made.collect()) == [(1, 0, "g"), (1, 1, "Searcher"), (2, 0, "Searcher"), (3, 0, "Searcher")]
    assert agents.plan(asked.limit(0), registry).count() == 0


def test_retried_calls_end_as_one_by_one(spark):
    rng = random.Random(5)
    calls = {i: [(rng.random() < 0.3, rng.choice([None, 401, 404, 408, 429, 500])) for _ in range(rng.randint(1, 5))] for i in range(60)}
    rows = [(i, n, ok, None if ok else status) for i, c in calls.items() for n, (ok, status) in enumerate(c, 1)]
    got = {r.call_id: r for r in agents.retry_outcomes(spark.createDataFrame(rows, "call_id int, attempt int, ok boolean, status int")).collect()}
    for i, c in calls.items():
        ok, n, waited = state.retry([(ok, None if ok else s) for ok, s in c])
        assert (got[i].outcome == "ok", got[i].attempts, got[i].waited) == (ok, n, waited)
    assert {r.outcome for r in got.values()} == {"ok", "not_found", "refused", "failed"}
