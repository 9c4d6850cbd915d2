"""Queries of approximate search, of questions asked in rounds and of stages, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, live, ranking
from ..operators.ann import VectorIndex, recall_against_exact
from ..plans.rounds import Worker, ask_in_rounds, counts
from ..plans.stages import Branch, Stages
from .catalogue import BM25_CTE, _vectors, chunks, query, read
from .graph_queries import EDGES_SQL, edges, nodes

#: Share of the true neighbours that an approximate search must find.
RECALL = 0.95


@query()
def vector_ann_topk(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 50, by an inverted file
    over all vectors, with as many probes as ``RECALL`` needs."""
    v, q = _vectors(spark, d)
    index = VectorIndex.build(v)
    hits = index.search(q, 10, index.tuned_probes(10, RECALL))
    return hits.select("query_id", F.col("key").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT count(*) FILTER (vec_id % 50 = 0) AS n_queries, count(*) AS n_vectors, count(*) FILTER (vec_id % 50 = 0) * 10 AS n_exact, true AS enough, true AS fewer_compared FROM embeddings""")
def vector_ann_recall(spark, d):
    """One row: whether the approximate search finds 0.9 of the exact search's hits, and whether
    it compares fewer vectors than all."""
    v, q = _vectors(spark, d)
    index = VectorIndex.build(v)
    probes = index.tuned_probes(10, RECALL)
    found = recall_against_exact(index, v, q, 10, probes).agg(F.count("*").alias("n_queries"), F.sum("n_exact").alias("n_exact"), F.sum("n_found").alias("n_found"))
    probed = index.probed_rows(q, probes).agg(F.sum("n_probed").alias("n_probed"))
    n = v.agg(F.count("*").alias("n_vectors"))
    row = found.crossJoin(probed).crossJoin(n)  # one row each
    return row.select("n_queries", "n_vectors", "n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("enough"), (F.col("n_probed") < F.col("n_queries") * F.col("n_vectors")).alias("fewer_compared"))


def _asked(spark, d):
    """Benchmark items as questions: some name an order (some of these don't exist), some hint at
    relations, and a router has left graph or lookups out for some."""
    k = F.col("item_id")
    order = F.when((k % 4 != 0) & (k % 7 != 0), (k * 50 + 1).cast("string")).when(k % 4 != 0, F.concat(F.lit("X"), k.cast("string")))
    text = F.concat("text", F.when(k % 5 == 0, " 关系").otherwise(""))
    return read(spark, d, "benchmark").select(
        k.cast("long").alias("query_id"), text.alias("query"), order.alias("order_id"), F.lit(None).cast("string").alias("sku"),
        (k % 3 != 0).alias("need_graph"), (k % 2 == 0).alias("need_live"),
    )


def _team(spark, d):
    docs = chunks(spark, d)
    orders = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("customer"))
    never = spark.createDataFrame([], "order_id string, error string, attempts int")
    blank = F.lit(None).cast("double")

    def search(q):
        hits = ranking.top_lexical(ranking.bm25(docs, q, top=30), 30).where("rank <= 3")
        return hits.select("query_id", F.col("rank").alias("place"), F.col("id").cast("string").alias("item"), F.col("norm").alias("score"))

    def walk(q):
        names = q.join(orders, "order_id").select("query_id", F.concat(F.lit("Customer:"), "customer").alias("name"), F.lit(0).alias("seq"))
        facts = graph.expand_facts(names, nodes(spark, d), edges(spark, d), 1, 12)
        return facts.select("query_id", F.col("rank").alias("place"), F.col("path").alias("item"), blank.alias("score"))

    def look(q):
        found = live.lookup(q.select("query_id", "order_id"), orders, never, "order_id").where("outcome <> 'not_asked'")
        return found.select("query_id", F.lit(0).alias("place"), F.concat_ws(" ", "outcome", "status").alias("item"), blank.alias("score"))

    return [Worker("searcher", ("retrieval",), "hits", search), Worker("reasoner", ("graph",), "facts", walk), Worker("watcher", ("live",), "live", look)]


@query(f"""WITH {EDGES_SQL}, {BM25_CTE},
q AS (SELECT item_id AS query_id, item_id % 4 <> 0 AS named, CASE WHEN item_id % 4 <> 0 AND item_id % 7 <> 0 THEN item_id * 50 + 1 END AS okey, item_id % 3 <> 0 AS g, item_id % 2 = 0 AS l, item_id % 5 = 0 AS hint FROM benchmark),
nh AS (SELECT query_id, count(*) AS n FROM lx WHERE rank <= 3 AND bm25 > 0 GROUP BY 1),
nf AS (SELECT query_id, least(count(*), 12) AS n FROM q JOIN orders ON o_orderkey = okey JOIN b ON b.node = 'Customer:' || o_custkey GROUP BY 1),
r AS (SELECT q.*, coalesce(nh.n, 0) AS h, coalesce(nf.n, 0) AS f, hint AND NOT g AS g2, named AND NOT l AS l2 FROM q LEFT JOIN nh USING (query_id) LEFT JOIN nf USING (query_id))
SELECT query_id, CASE WHEN g2 OR l2 THEN 2 ELSE 1 END::BIGINT AS rounds, array_to_string(list_filter([CASE WHEN g OR g2 THEN 'reasoner' END, 'searcher', CASE WHEN l OR l2 THEN 'watcher' END], lambda x: x IS NOT NULL), ',') AS executed,
  (g2::INT + l2::INT)::BIGINT AS requests, (g2::INT + l2::INT)::BIGINT AS replies, CASE WHEN g2 AND f = 0 THEN 'graph' ELSE '' END AS declined,
  h AS n_hits, CASE WHEN g OR g2 THEN f ELSE 0 END AS n_facts, (named AND (l OR l2))::BIGINT AS n_live FROM r""")
def ask_rounds(spark, d):
    """How many rounds each question took, who ran for it, what was asked for and declined, and the
    evidence that search, graph and lookups gave. No row says that a worker failed, so then the query fails."""
    asked, team = _asked(spark, d), _team(spark, d)
    # the router's choices, as a plan
    wanted = F.array_compact(F.array(F.lit("searcher"), F.when(F.col("need_graph"), F.lit("reasoner")), F.when(F.col("need_live"), F.lit("watcher"))))
    done = ask_in_rounds(asked, team, asked.select("query_id", F.explode(wanted).alias("agent")), max_rounds=3, strict=True)
    story = done.collaboration(asked)
    n = counts(asked.select("query_id"), done.evidence)
    long = lambda c: F.col(c).cast("long").alias(c)
    return story.join(n, "query_id").select(
        "query_id", long("rounds"), F.array_join("executed", ",").alias("executed"), long("requests"), long("replies"), F.array_join("declined", ",").alias("declined"),
        long("n_hits"), long("n_facts"), long("n_live"),
    )


@query("""SELECT 'orders' AS stage, true AS ok, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS errors FROM orders
UNION ALL SELECT 'pages', true, count(DISTINCT url), 0 FROM pages UNION ALL SELECT 'broken', false, 0, 0 UNION ALL SELECT 'unread', false, 0, 0""")
def stage_metrics(spark, d):
    """Rows, failed rows and outcome of four stages that run at the same time; one fails while it
    is written and one when it is built."""
    stages = Stages(spark)
    stages.run_all([
        Branch("orders", lambda: read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey long, o_orderstatus string", errors=F.col("o_orderstatus") == "F"),
        Branch("pages", lambda: read(spark, d, "pages").select("url").where("url IS NOT NULL").distinct(), "url string"),
        Branch("broken", lambda: read(spark, d, "orders").select(F.raise_error(F.lit("no answer")).cast("string").alias("x")), "x string"),
        Branch("unread", lambda: read(spark, d, "no_such_table"), "x string"),
    ])
    return stages.table().select("stage", "ok", "rows", "errors")
