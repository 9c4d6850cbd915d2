"""Containment lookups and simple paths against search by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph

NODES = "key string, type string, name string, seq long"
EDGES = "src string, rel string, dst string, seq long"


def resolved(names, nodes):
    out = []
    for q, name in names:
        exact = [(s, k) for k, _, n, s in nodes if name in (n, k)]
        near = [(s, k) for k, _, n, s in nodes if n and name and (name in n or n in name)]
        if exact or near:
            out.append((q, name, min(exact or near)[1]))
    return sorted(set(out))


@pytest.mark.parametrize("letters", ["ab", "abc配送", "abcdefgh"])
def test_names_are_resolved_as_by_a_scan(spark, letters):
    rng = random.Random(len(letters))
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    nodes = [(f"T:{i}", "T", word(9), rng.randint(0, 40)) for i in range(80)] + [("T:x", "T", None, 0)]
    names = [(i % 7, word(7)) for i in range(60)] + [(1, "T:3"), (2, "z"), (3, "zzzzzz"), (3, "zzzzzz"), (4, letters * 40)]
    got = graph.resolve(spark.createDataFrame(names, "query_id int, name string"), spark.createDataFrame(nodes, NODES))
    assert sorted(set(map(tuple, got.select("query_id", "name", "key").collect()))) == resolved(names, [n for n in nodes if n[2] is not None])
    assert got.groupBy("query_id", "name").count().where("count > 1").count() == 0


def test_resolving_needs_no_nested_loop(spark):
    nodes = spark.createDataFrame([("T:a", "T", "alphabet", 1), ("T:b", "T", "bet", 2)], NODES)
    got = graph.resolve(spark.createDataFrame([(1, "lphab"), (2, "the bets"), (3, "T:a")], "query_id int, name string"), nodes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.query_id, r.key) for r in got.collect()) == [(1, "T:a"), (2, "T:b"), (3, "T:a")]
    assert graph.resolve(spark.createDataFrame([], "query_id int, name string"), nodes).count() == 0
    assert graph.resolve(spark.createDataFrame([(1, "x")], "query_id int, name string"), nodes.limit(0)).count() == 0


def paths_by_hand(edges, src, dst, depth):
    near = {}
    for a, _, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, grown = [], [[src]]
    for _ in range(depth):
        grown = [[*p, n] for p in grown for n in near.get(p[-1], ()) if n not in p]
        found += [p for p in grown if p[-1] == dst]
        grown = [p for p in grown if p[-1] != dst]
    return sorted(found, key=lambda p: (len(p), "\x00".join(p)))


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("limit", [3, 1000])
def test_paths_meet_in_the_middle(spark, depth, limit):
    rng = random.Random(depth)
    names = "abcdefgh"
    edges = [(rng.choice(names), rng.choice("rs"), rng.choice(names), i) for i in range(14)] + [("a", "r", "b", 99), ("b", "r", "a", 98), ("c", "r", "c", 97)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(itertools.islice(itertools.product(names, names + "z"), 0, None, 5))]
    got = {}
    for r in graph.simple_paths(spark.createDataFrame(pairs, "query_id long, src string, dst string"), spark.createDataFrame(edges, EDGES), depth, limit).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.length, r.nodes))
    for i, a, b in pairs:
        want = paths_by_hand(edges, a, b, depth)[:limit] if a != b else []
        assert sorted(got.get(i, [])) == [(k, len(p) - 1, p) for k, p in enumerate(want, 1)], (a, b)


def test_two_pairs_of_one_question_do_not_mix(spark):
    edges = spark.createDataFrame([("a", "r", "m", 1), ("m", "r", "b", 2), ("c", "r", "m", 3), ("m", "r", "d", 4)], EDGES)
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (1, "a", "b")], "query_id long, src string, dst string")
    assert sorted(r.nodes for r in graph.simple_paths(pairs, edges, 3).collect()) == [["a", "m", "b"], ["c", "m", "d"]]


def test_hops_read_what_one_hop_wrote(spark):
    edges = spark.createDataFrame([(f"n{i}", "r", f"n{i + 1}", i) for i in range(6)] + [("hub", "r", f"x{i}", i) for i in range(300)] + [("n1", "r", "hub", 0)], EDGES)
    starts = spark.createDataFrame([(1, "n0")], "query_id long, key string")
    reads = []
    for depth in (2, 3, 4):
        near = graph.neighbours(starts, edges, depth)
        reads.append(near._jdf.queryExecution().executedPlan().toString().count("Scan parquet"))
        assert near.where(F.col("depth") == 2).count() == 2 and near.count() == {2: 3, 3: 304, 4: 305}[depth]
    assert reads[2] - reads[1] == reads[1] - reads[0] <= 2


def test_paths_do_not_leave_a_hub(spark, monkeypatch):
    written, real = {}, graph.stored

    def stored(df, tag):
        out = real(df, tag)
        written[tag] = max(written.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(graph, "stored", stored)
    rows = [(f"t{i}", "r", "hub", i) for i in range(2000)] + [(f"t{i}", "s", f"c{i % 20}", i) for i in range(40)]
    pairs = spark.createDataFrame([(i, f"c{i}", "hub") for i in range(10)] + [(i, "hub", f"c{i}") for i in range(10, 20)], "query_id long, src string, dst string")
    got = {r.query_id: r.nodes for r in graph.simple_paths(pairs, spark.createDataFrame(rows, EDGES), 2, 1).collect()}
    assert got == {i: [f"c{i}", min(f"t{i}", f"t{i + 20}"), "hub"][:: 1 if i < 10 else -1] for i in range(20)}
    assert written["half"] <= 40  # 20,000 rows a half if it grew from the hub


def test_whole_names_lead_to_no_part(spark):
    nodes = spark.createDataFrame([("Ticket:5", "Ticket", "5", 1), ("Customer:7", "Customer", "7", 1)], NODES)
    edges = spark.createDataFrame([("Ticket:5", "SUBMITTED_BY", "Customer:7", 1)], EDGES)
    names = spark.createDataFrame([(1, "Customer:5", 0), (2, "Customer:7", 0)], "query_id long, name string, seq int")
    assert {r.query_id for r in graph.expand_facts(names, nodes, edges, 1, partial=False).collect()} == {2}
    assert {r.query_id for r in graph.expand_facts(names, nodes, edges, 1).collect()} == {1, 2}


def test_hops_without_paths_reach_the_same(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.choice("abcdefgh"), rng.choice("rs"), rng.choice("abcdefgh"), i) for i in range(12)], EDGES)
    starts = spark.createDataFrame([(i, n) for i, n in enumerate("abcdefghz")], "query_id long, key string")
    for direction in ("in", "both"):
        for rel in (None, "r"):
            near = graph.neighbours(starts, edges, 3, direction, rel)
            bare = graph.neighbours(starts, edges, 3, direction, rel, paths=False)
            assert bare.columns == ["query_id", "key", "depth"]
            assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, near.select(bare.columns).collect()))


def test_links_beside_nodes(spark):
    rng = random.Random(7)
    links = [(f"n{rng.randrange(4000)}", f"n{rng.randrange(4000)}") for _ in range(12000)] + [("n1", "n1"), ("n1", "hub"), ("n1", "hub"), (None, "n1")]
    nodes = {f"n{i}" for i in range(0, 4000, 5)}
    asked = spark.createDataFrame([(n,) for n in nodes] * 2, "node string")
    both = {p for a, b in links for p in ((a, b), (b, a))}
    for within in (False, True):
        want = {p for p in both if p[0] in nodes and (not within or p[1] in nodes)}
        got = [tuple(r) for r in graph._beside(asked, spark.createDataFrame(links, "src string, dst string"), within).collect()]
        assert want <= set(got) <= both and len(set(got)) <= len(want) + 100
    assert graph._beside(asked.limit(0), spark.createDataFrame(links, "src string, dst string")).count() == 0


def test_paths_shuffle_links_of_their_ends_only(spark, monkeypatch):
    written, real = {}, graph.stored

    def stored(df, tag):
        out = real(df, tag)
        written[tag] = max(written.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(graph, "stored", stored)
    far = [(f"x{i}", "r", f"y{i % 50}", i) for i in range(3000)]
    near = [("a", "r", "m1", 0), ("m1", "r", "hub", 1), ("b", "r", "m2", 2), ("m2", "r", "hub", 3), ("m2", "s", "hub", 3)] + [(f"t{i}", "r", "hub", i) for i in range(3000)]
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "y0x")], "query_id long, src string, dst string")
    got = graph.simple_paths(pairs, spark.createDataFrame(far + near, EDGES), 4).collect()
    assert [(r.query_id, r.length, r.nodes, r["rank"]) for r in got] == [(1, 4, ["a", "m1", "hub", "m2", "b"], 1)]
    assert written["walk"] <= 60 and written["half"] <= 4  # all 12,010 rows of both directions before
