"""A property graph as two tables, nodes and edges, constrained by an ontology.

nodes: key, type, name, props (map), docs (array), seq. edges: src, rel, dst, docs, seq.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import strip
from ..sources.scratch import stored
from .ranking import by_rows

STEP = "array<struct<rel:string,direction:string,node:string>>"
MOST_DOCS = 5
#: Properties that say where a node was first found.
ORIGIN = ("doc_id", "method", "evidence")


def relation_schema(spark: SparkSession, relations: dict = V.RELATIONS) -> DataFrame:
    """rel, subject_type, object_type: every combination that the ontology allows."""
    rows = [(r, s, o) for r, (subjects, objects) in relations.items() for s in subjects for o in objects]
    return spark.createDataFrame(rows, "rel string, subject_type string, object_type string")


def _named(triples: DataFrame) -> DataFrame:
    return triples.where((strip(F.coalesce("subject", F.lit(""))) != "") & (strip(F.coalesce("object", F.lit(""))) != ""))


def valid_triples(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """Triples with both names that the ontology allows."""
    return _named(triples).join(F.broadcast(schema), ["rel", "subject_type", "object_type"], "left_semi").select(triples.columns)


def invalid_triples(triples: DataFrame, schema: DataFrame) -> DataFrame:
    marked = schema.withColumn("_ok", F.lit(True))
    blank = (strip(F.coalesce("subject", F.lit(""))) == "") | (strip(F.coalesce("object", F.lit(""))) == "")
    return triples.join(F.broadcast(marked), ["rel", "subject_type", "object_type"], "left").where(F.col("_ok").isNull() | blank).select(triples.columns)


def node_key(kind, name):
    return F.concat_ws(":", kind, name)


def edges_of(triples: DataFrame) -> DataFrame:
    """One edge for each (src, rel, dst): all documents that state it, in order of arrival, and
    when it was first stated. An edge goes when all its documents have gone, so none is left out."""
    src, dst = node_key(F.col("subject_type"), F.col("subject")), node_key(F.col("object_type"), F.col("object"))
    named = triples.select(src.alias("src"), "rel", dst.alias("dst"), "doc_id", "seq")
    return named.groupBy("src", "rel", "dst").agg(_docs().alias("docs"), F.min("seq").alias("seq"))


def links_of(triples: DataFrame) -> DataFrame:
    """src and dst of each triple, as often as it is stated: what paths need of the edges, without a shuffle."""
    return triples.select(node_key(F.col("subject_type"), F.col("subject")).alias("src"), node_key(F.col("object_type"), F.col("object")).alias("dst"))


def _docs():
    firsts = F.array_sort(F.collect_set(F.struct("seq", "doc_id")))
    return F.array_compact(F.array_distinct(F.transform(firsts, lambda d: d["doc_id"])))


def nodes_of(triples: DataFrame) -> DataFrame:
    """key, type, name, props, docs, seq. Objects take the triple's props, the latest value of a
    name winning; subjects take none. Documents are kept up to five, the first ones."""
    props = F.col("props") if "props" in triples.columns else F.lit(None).cast("map<string,string>")
    subject = triples.select(F.col("subject_type").alias("type"), F.col("subject").alias("name"), F.lit(None).cast("map<string,string>").alias("props"), "doc_id", "seq")
    ends = subject.union(triples.select("object_type", "object", props, "doc_id", "seq"))
    ends = ends.withColumn("key", node_key(F.col("type"), F.col("name")))
    # a window limit keeps five rows of a node in each task, so a hub never meets all its documents
    stated = ends.groupBy("key", "type", "name", "doc_id").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq", "doc_id"))
    firsts = stated.where("doc_id IS NOT NULL").withColumn("_k", place).where(F.col("_k") <= MOST_DOCS)
    docs = firsts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "doc_id"))), lambda d: d["doc_id"]).alias("docs"))
    base = ends.groupBy("key", "type", "name").agg(F.min("seq").alias("seq")).join(docs, "key", "left")
    base = base.select("key", "type", "name", F.coalesce("docs", F.array().cast("array<string>")).alias("docs"), "seq")
    if "props" not in triples.columns:
        return base.withColumn("props", F.lit(None).cast("map<string,string>"))
    values = ends.where("props IS NOT NULL").select("key", "seq", F.explode("props").alias("k", "v"))
    last = values.groupBy("key", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("props"))
    return base.join(maps, "key", "left")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new`` upserted, both with one row for each key: new values of a property
    win, but a known node keeps where it came from (``ORIGIN``); documents are added up to five."""
    none, no_docs = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    o, n = old.alias("o"), new.alias("n")
    taken = F.when(F.col("o.key").isNull(), F.col("n.props")).otherwise(F.map_filter("n.props", lambda k, _: ~k.isin(*ORIGIN)))
    before, after = F.coalesce("o.props", none), F.coalesce(taken, none)
    props = F.map_concat(F.map_filter(before, lambda k, _: ~F.array_contains(F.map_keys(after), k)), after)
    docs = F.array_distinct(F.concat(F.coalesce("o.docs", no_docs), F.coalesce("n.docs", no_docs)))
    both = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    return o.join(n, F.col("o.key") == F.col("n.key"), "full_outer").select(
        both("key"), both("type"), both("name"), F.slice(docs, 1, MOST_DOCS).alias("docs"), F.least("o.seq", "n.seq").alias("seq"),
        F.when(F.col("o.props").isNotNull() | F.col("n.props").isNotNull(), props).alias("props"),
    )


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new`` upserted, both with one row for each (src, rel, dst)."""
    none, keys = F.array().cast("array<string>"), ("src", "rel", "dst")
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in keys]
    docs = F.array_distinct(F.concat(F.coalesce("o.docs", none), F.coalesce("n.docs", none)))
    return o.join(n, same, "full_outer").select(*(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keys), docs.alias("docs"), F.least("o.seq", "n.seq").alias("seq"))


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """node, rel, direction, next, seq: the edges as they can be walked."""
    out = edges.select(F.col("src").alias("node"), "rel", F.lit("out").alias("direction"), F.col("dst").alias("next"), "seq")
    back = edges.select(F.col("dst").alias("node"), "rel", F.lit("in").alias("direction"), F.col("src").alias("next"), "seq")
    return out if direction == "out" else back if direction == "in" else out.union(back)


def degree(edges: DataFrame) -> DataFrame:
    """key, degree: ends of edges at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: counts of all nodes and edges, of each type and of each relation."""
    by_type = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), F.col("type").alias("name"), "n")
    by_rel = edges.groupBy("rel").agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), F.col("rel").alias("name"), "n")
    total = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), F.lit("").alias("name"), "n")
    links = edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("").alias("name"), "n")
    return by_type.union(by_rel).union(total).union(links)


def find_entities(nodes: DataFrame, edges: DataFrame, part: str = "", kind: str | None = None, limit: int = 20) -> DataFrame:
    """The ``limit`` best connected nodes of a type whose name contains ``part``."""
    found = nodes.where(F.col("name").contains(part))
    found = found.where(F.col("type") == kind) if kind else found
    with_degree = found.join(degree(edges), "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return with_degree.select("key", "type", "name", "degree").orderBy(F.desc("degree"), "name", "key").limit(limit)


#: Letters of the pieces by which names are looked up.
PIECE = 3


def _pieces(text: str, length: Column) -> Column:
    """The distinct substrings of ``length`` letters of a column; none of a shorter text."""
    n = F.length(text) - length + 1
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col(text), i, length))
    return F.array_distinct(F.when(n >= 1, every).otherwise(F.array().cast("array<string>")))


def containing(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, key, seq: nodes (key, _n, seq) whose name ``_n`` contains an asked name.

    An asked name of up to ``PIECE`` letters is looked up among the nodes' substrings of its
    length, a longer one by the one of its pieces that the fewest nodes have, and verified.
    """
    a = asked.select("name").distinct().withColumn("_l", F.least(F.length("name"), F.lit(PIECE)))
    lengths = sorted(r[0] for r in a.select("_l").distinct().collect())  # PIECE numbers at most
    if not lengths:
        return a.join(nodes, F.lit(False)).select("name", "key", "seq")
    # pieces of the lengths asked for only
    index = nodes.select("key", "_n", "seq", F.explode(F.array_distinct(F.flatten(F.array(*(_pieces("_n", F.lit(n)) for n in lengths))))).alias("piece"))
    grams = by_rows(stored(a.select("name", F.explode(_pieces("name", F.col("_l"))).alias("piece")), "pieces"))
    share = index.join(grams.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    known = grams.join(share, "piece", "left")
    # a piece that no node has leaves its name without a match
    rare = known.groupBy("name").agg(F.min_by("piece", F.struct(F.col("n").isNotNull(), "n", "piece")).alias("piece"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    rare = stored(rare.where("all").select("name", "piece"), "rare")
    return index.join(by_rows(rare), "piece").where(F.contains("_n", "name")).select("name", "key", "seq")


def contained(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, key, seq: nodes (key, _n, seq) whose name is a part of an asked name. The asked names
    are cut into substrings of the lengths that node names have, and these are the join key."""
    a = asked.select("name").distinct()
    longest = a.agg(F.max(F.length("name"))).first()[0] or 0
    # lengths, not names: as many as the longest asked name has letters at most
    lengths = [r[0] for r in nodes.select(F.length("_n").alias("l")).where(F.col("l").between(1, longest)).distinct().collect()]
    if not lengths:
        return a.join(nodes, F.lit(False)).select("name", "key", "seq")
    cut = a.select("name", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("_l")).select("name", F.explode(_pieces("name", F.col("_l"))).alias("_n"))
    return nodes.join(by_rows(stored(cut, "parts"), 1_000_000), "_n").select("name", "key", "seq")


def resolve(names: DataFrame, nodes: DataFrame, partial: bool = True) -> DataFrame:
    """(query_id, name) to (query_id, key): the exact key or name first, else (``partial``) the
    earliest node whose name contains the asked one or is contained in it. All are equi-joins;
    containment is tried for the names that exact matches leave over only."""
    names = stored(names.select("query_id", "name"), "names")
    nodes = stored(nodes.select("key", F.col("name").alias("_n"), "seq"), "nodes")
    first = F.min(F.struct("seq", "key"))
    exact = names.join(nodes, F.col("name") == F.col("_n")).union(names.join(nodes, F.col("name") == F.col("key")))
    exact = stored(exact.groupBy("query_id", "name").agg(first.alias("f")).select("query_id", "name", "f.key"), "exact")
    if not partial:
        return exact
    rest = names.join(exact, ["query_id", "name"], "left_anti").where("name <> ''")
    if rest.isEmpty():
        return exact
    near = containing(rest, nodes).union(contained(rest, nodes)).groupBy("name").agg(first.alias("f")).select("name", "f.key")
    return exact.unionByName(rest.distinct().join(near, "name").select("query_id", "name", "key"))


def neighbours(starts: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "out", rel: str | None = None, limit: int | None = None, paths: bool = True) -> DataFrame:
    """query_id, key, depth, path: every node once, by its first shortest path from the start.

    ``starts`` has query_id and key. ``depth`` is clamped to 1..4; ``rel`` restricts every hop;
    of several shortest paths the one of the smallest (previous node, edge seq) stays, and
    ``limit`` keeps the nearest nodes of each query. Each hop is a join with the edges and an
    anti-join with what was seen. Edges and frontiers are written once, so a hop reads those of
    one hop before it; the edges of a hub are split by the adaptive skew join. Without ``paths``
    a hop moves its queries and nodes only, and the rows have no path.
    """
    if not paths:
        return _nearest(_reached(starts, edges, depth, direction, rel), limit)
    walk = stored(directed(edges if rel is None else edges.where(F.col("rel") == rel), direction), "walk")
    frontier = stored(starts.select("query_id", F.col("key"), F.lit(0).alias("depth"), F.expr(f"CAST(array() AS {STEP})").alias("path")), "hop")
    seen = frontier
    for d in range(1, max(1, min(4, depth)) + 1):
        step = F.array(F.struct("rel", "direction", F.col("next").alias("node")))
        hop = frontier.join(walk, F.col("key") == F.col("node")).select("query_id", F.col("next").alias("key"), F.col("key").alias("_from"), "seq", "rel", F.concat("path", step).alias("path"))
        best = hop.groupBy("query_id", "key").agg(F.min_by("path", F.struct("_from", "seq", "rel")).alias("path"))
        frontier = stored(best.join(seen.select("query_id", "key"), ["query_id", "key"], "left_anti").select("query_id", "key", F.lit(d).alias("depth"), "path"), "hop")
        seen = seen.unionByName(frontier)
    return _nearest(seen.where("depth > 0"), limit)


def _reached(starts: DataFrame, edges: DataFrame, depth: int, direction: str, rel: str | None) -> DataFrame:
    """query_id, key, depth: as :func:`neighbours`. Pairs are told apart before they are joined
    with what was seen."""
    walk = stored(directed(edges if rel is None else edges.where(F.col("rel") == rel), direction).select("node", "next").distinct(), "walk")
    frontier = stored(starts.select("query_id", "key").distinct(), "hop")
    seen, found = frontier, None
    for d in range(1, max(1, min(4, depth)) + 1):
        hop = frontier.join(walk, F.col("key") == F.col("node")).select("query_id", F.col("next").alias("key")).distinct()
        frontier = stored(hop.join(seen, ["query_id", "key"], "left_anti"), "hop")
        seen = seen.unionByName(frontier)
        rows = frontier.select("query_id", "key", F.lit(d).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _nearest(found: DataFrame, limit: int | None) -> DataFrame:
    if limit is not None:
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "key"))).where(F.col("_k") <= limit).drop("_k")
    return found


#: Words in a row of a node filter, and how many rows it has at most (36 MB).
WORDS, MOST_SLOTS = 64, 1 << 16


def _marker(nodes: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A function that gives a table a column ``at``: whether a column of it is one of ``nodes`` (node),
    or about one in a thousand others, so what needs these alone joins them exactly. The table stays
    where it lies: the nodes are counted and marked in a filter of 32 bits a node, three of them in
    one word, and the filter is broadcast."""
    nodes = stored(nodes.distinct(), "ends")
    slots = max(1, min(MOST_SLOTS, nodes.count() // (2 * WORDS)))
    bits = lambda shift: f"CAST(shiftright(h, {shift}) & {WORDS - 1} AS INT)"
    word, mask = F.expr(bits(32)), F.expr(" | ".join(f"shiftleft(1L, {bits(s)})" for s in (38, 44, 50)))
    hashed = lambda df, c: df.withColumn("h", F.xxhash64(c)).withColumn("slot", F.pmod("h", F.lit(slots).cast("long")))
    words = hashed(nodes, "node").groupBy("slot", word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0)))
    rows = words.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select("slot", every.alias("words"))
    rows = F.broadcast(stored(rows, "filter"))
    return lambda df, c: hashed(df, c).join(rows, "slot", "left").withColumn("at", F.get("words", word).bitwiseAND(mask) == mask).drop("h", "slot", "words")


def _beside(nodes: DataFrame, links: DataFrame, within: bool = False) -> DataFrame:
    """node, next of the links (src, dst) at ``nodes`` (node), or (``within``) between two of them, and
    of a few others (:func:`_marker`), read once and not shuffled."""
    marked = _marker(nodes)
    seen = marked(marked(links, "src").withColumnRenamed("at", "out"), "dst").withColumnRenamed("at", "back")
    if within:
        seen = seen.where("out AND back")
    step = lambda here, a, b: F.when(here, F.struct(F.col(a).alias("node"), F.col(b).alias("next")))
    return seen.where("out OR back").select(F.inline(F.array_compact(F.array(step(F.col("out"), "src", "dst"), step(F.col("back"), "dst", "src")))))


def simple_paths(pairs: DataFrame, edges: DataFrame, depth: int = 3, limit: int = 10) -> DataFrame:
    """query_id, length, nodes (from start to end), rank of paths without a repeated node over
    undirected edges (src, dst; an edge may come several times), shortest first, ``limit`` for each
    pair (query_id, src, dst). ``depth`` is clamped to 1..5.

    Paths grow from both ends and meet in the middle. At each length one half of a pair grows by an
    edge, the one whose last nodes have fewer edges, so a hub at one end is never walked out of
    while the other end is cheaper. At a length each pair has one pair of half lengths, so a path is
    found once. A pair that has ``limit`` paths grows no further, as longer ones come after.

    The edges are written once and read once at each length. Those at the last nodes of halves are written
    where they lie, at the last length those between two of them; those of halves that grow are shuffled.
    """
    depth = max(1, min(5, depth))
    links = stored(edges.select("src", "dst"), "links")
    pairs = stored(pairs.where("src <> dst").select("query_id", "src", "dst").distinct(), "pairs")
    pair, ends = ["query_id", "src", "dst"], {"src": "dst", "dst": "src"}
    halves = {e: pairs.select(*pair, F.col(e).alias("at"), F.col(o).alias("other"), F.array(e).alias("nodes")) for e, o in ends.items()}
    mine = {"src": F.col("first"), "dst": ~F.col("first")}
    last_nodes = lambda some: reduce(DataFrame.union, (h.select(F.col("at").alias("node")) for h in some))
    order = Window.partitionBy("query_id").orderBy("length", F.array_join("nodes", "\x00"))
    done = None
    for n in range(1, depth + 1):
        last = n == depth
        near = stored(_beside(last_nodes(halves.values()), links, last), "near")
        degrees = stored(near.groupBy(F.col("node").alias("at")).agg(F.count("*").alias("n")), "degrees")
        # a pair without a half has nothing to grow, and none that meets
        width = lambda e: halves[e].join(degrees, "at").groupBy(*pair).agg(F.sum("n").alias(f"{e}_n"))  # noqa: B023, E731
        grows = stored(width("src").join(width("dst"), pair).select(*pair, (F.col("src_n") <= F.col("dst_n")).alias("first")), "grows")
        live = {e: halves[e].join(grows, pair) for e in ends}
        growing = last_nodes(live[e].where(mine[e]) for e in ends)
        walk = stored(_marker(growing)(near, "node").where("at").select("node", "next").distinct(), "walk")
        for e in ends:
            grown = live[e].where(mine[e]).join(walk, F.col("at") == F.col("node")).where(~F.array_contains("nodes", F.col("next")))
            grown = grown.select(*pair, F.col("next").alias("at"), "other", F.concat("nodes", F.array("next")).alias("nodes"))
            both = live[e].where(~mine[e]).drop("first").unionByName(grown)
            # what grows last only meets, so it is not written
            halves[e] = both if last else stored(both, "half")
        back = halves["dst"].select(*pair, "at", F.col("nodes").alias("_back"))
        met = halves["src"].join(back, [*pair, "at"])
        met = met.where(F.size(F.array_intersect("nodes", "_back")) == 1)
        met = met.select("query_id", F.lit(n).alias("length"), F.concat("nodes", F.slice(F.reverse("_back"), 2, depth + 1)).alias("nodes"))
        # rows of one pair that rank below the limit go before they are written
        met = stored(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank"), "met")
        done = met if done is None else done.unionByName(met)
        if not last:
            full = done.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("query_id")
            # a path ends where it reaches the other end
            halves = {e: h.where(F.col("at") != F.col("other")).join(full, "query_id", "left_anti") for e, h in halves.items()}
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def render_path(start, path):
    """``a --rel--> b ; b <--rel-- c`` of a start key and its steps."""
    parts = F.transform(
        path,
        lambda s, i: F.when(
            s["direction"] == "out", F.concat(F.when(i == 0, start).otherwise(F.get(path, i - 1)["node"]), F.lit(" --"), s["rel"], F.lit("--> "), s["node"])
        ).otherwise(F.concat(F.when(i == 0, start).otherwise(F.get(path, i - 1)["node"]), F.lit(" <--"), s["rel"], F.lit("-- "), s["node"])),
    )
    return F.array_join(parts, " ; ")


def expand_facts(entities: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 12, most_entities: int = 5, partial: bool = True) -> DataFrame:
    """query_id, subject, rel, object, depth, path: the last step of the path to each node near
    a query's entities (query_id, name, seq; the first five), each fact once, nearest first.
    Without ``partial`` names count as a whole: one that no node has leads nowhere."""
    first = Window.partitionBy("query_id").orderBy("seq", "name")
    asked = entities.dropDuplicates(["query_id", "name"]).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most_entities)
    starts = resolve(asked.select("query_id", "name"), nodes, partial).select("query_id", "key").distinct()
    # each start walks on its own
    pairs = starts.withColumn("walk", F.struct("query_id", "key")).select(F.col("walk").alias("query_id"), "key")
    near = neighbours(pairs, edges, depth, "both")
    last, before = F.try_element_at("path", F.lit(-1)), F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)["node"]).otherwise(F.col("walk.key"))
    out = last["direction"] == "out"
    facts = near.toDF("walk", "key", "depth", "path").select(
        F.col("walk.query_id").alias("query_id"), F.when(out, before).otherwise(last["node"]).alias("subject"), last["rel"].alias("rel"),
        F.when(out, last["node"]).otherwise(before).alias("object"), "depth", render_path(F.col("walk.key"), F.col("path")).alias("path"),
    )
    once = facts.groupBy("query_id", "subject", "rel", "object").agg(F.min(F.struct("depth", "path")).alias("m"))
    once = once.select("query_id", "subject", "rel", "object", "m.depth", "m.path")
    order = Window.partitionBy("query_id").orderBy("depth", "subject", "rel", "object")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def delete_document(nodes: DataFrame, edges: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without what only the documents ``doc_ids`` (doc_id) state: edges lose those
    documents and go when none is left, Document nodes go, other nodes stay, and so do edges that
    no document states."""
    gone = doc_ids.select(F.col("doc_id").cast("string").alias("d")).distinct()
    rows = edges.select("src", "rel", "dst", "seq", F.explode_outer("docs").alias("d")).join(by_rows(gone), "d", "left_anti")
    left = rows.groupBy("src", "rel", "dst", "seq").agg(F.array_sort(F.collect_set("d")).alias("docs"))
    keys = gone.select(node_key(F.lit("Document"), F.col("d")).alias("key"))
    return nodes.join(by_rows(keys), "key", "left_anti"), left


def unseen_documents(docs: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without a Document node: what an incremental build still has to read."""
    known = nodes.where("type = 'Document'").select(F.col("name").alias("_name"))
    return docs.join(known, F.col(key).cast("string") == F.col("_name"), "left_anti")


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their degree (isolated ones too), and edges."""
    out = nodes.join(degree(edges), "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.select("key", "type", "name", "degree"), edges.select("src", "rel", "dst")
