"""Queries of plans, evidence and retried calls, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agents, live
from .catalogue import query, read

REGISTRY = [("searcher", ["retrieval"], 0), ("reasoner", ["graph", "retrieval"], 1), ("watcher", ["live"], 2), ("spare", ["graph"], 3)]


def _registry(spark):
    return spark.createDataFrame(REGISTRY, "agent string, capabilities array<string>, seq int")


def _routed(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("query_id"), F.when(k % 3 != 0, k % 2 == 0).alias("need_graph"), (k % 5 != 0).alias("need_live"))


@query("""WITH n AS (SELECT o_orderkey AS query_id, list_filter(['retrieval', CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'graph' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'live' END], lambda x: x IS NOT NULL) AS c FROM orders)
SELECT query_id, step, capability, CASE capability WHEN 'retrieval' THEN 'searcher' WHEN 'graph' THEN 'reasoner' ELSE 'watcher' END AS agent FROM (
  SELECT query_id, unnest(c) AS capability, generate_subscripts(c, 1) - 1 AS step FROM n)""")
def agent_plan(spark, d):
    return agents.plan(_routed(spark, d), _registry(spark)).withColumn("step", F.col("step").cast("long"))


@query("""WITH l AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 7 = 0 THEN list_filter(['searcher', CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'reasoner' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'watcher' END], lambda x: x IS NOT NULL)
  WHEN o_orderkey % 4 = 0 THEN ['searcher', 'watcher'] WHEN o_orderkey % 4 = 2 THEN ['reasoner', 'watcher'] ELSE ['watcher'] END AS a FROM orders)
SELECT query_id, unnest(a) AS agent, generate_subscripts(a, 1) - 1 AS step FROM l""")
def agent_plan_from_answers(spark, d):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*(F.lit(x) for x in ("Searcher", "ghost", "GRAPH", "watcher"))), (k % 4 + 1).cast("int"))
    text = F.concat(F.lit('Sure: {"subtasks": [{"agent": "'), name, F.lit('"}, {"capability": "live"}, {"agent": "nobody"}]} done'))
    answers = read(spark, d, "orders").select(k.alias("query_id"), F.when(k % 7 == 0, "no plan").otherwise(text).alias("answer"))
    made = agents.plan_from_answers(answers, _routed(spark, d), _registry(spark))
    return made.select("query_id", "agent", F.col("step").cast("long").alias("step"))


@query("""SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'retrieval' WHEN 1 THEN 'live' ELSE 'other' END AS capability,
  (o_orderkey % 5 - o_orderkey % 3)::BIGINT AS d_hits, (o_orderkey % 2)::BIGINT AS d_live,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 5 > o_orderkey % 3 WHEN 1 THEN o_orderkey % 2 > 0 ELSE o_orderkey % 5 - o_orderkey % 3 + o_orderkey % 2 > 0 END AS gained FROM orders""")
def evidence_gain(spark, d):
    k = F.col("o_orderkey")
    rows = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    none = F.array().cast("array<string>")
    side = lambda hits, seen: F.struct(rows(hits).alias("hits"), none.alias("facts"), rows(seen).alias("live"), F.lit(None).cast("array<string>").alias("actions"))
    kind = F.when(k % 3 == 0, "retrieval").when(k % 3 == 1, "live").otherwise("other")
    rounds = read(spark, d, "orders").select(k.alias("query_id"), kind.alias("capability"), side(k % 3, F.lit(1)).alias("before"), side(k % 5, k % 2 + 1).alias("after"))
    return agents.evidence_gain(rounds).select("query_id", "capability", F.col("d_hits").cast("long").alias("d_hits"), F.col("d_live").cast("long").alias("d_live"), "gained")


CALLS_SQL = """a AS (SELECT l_orderkey AS call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS attempt, l_returnflag AS f FROM lineitem),
s AS (SELECT call_id, coalesce(min(attempt) FILTER (f <> 'R' OR attempt > 2), max(attempt)) AS attempt FROM a GROUP BY 1),
o AS (SELECT call_id, attempt AS attempts, CASE f WHEN 'N' THEN 'ok' WHEN 'A' THEN 'not_found' ELSE 'failed' END AS outcome,
  [0e0, 5e-1, 15e-1][attempt] AS waited, attempt - (f <> 'R')::BIGINT AS breaker_failures FROM s JOIN a USING (call_id, attempt))"""


def _outcomes(spark, d):
    """Line items as attempts of their orders' calls: N succeeds, A finds nothing, R fails."""
    flag = F.col("l_returnflag")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag"))
    status = F.when(flag == "A", 404).when(flag == "R", 503)
    attempts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), place.alias("attempt"), (flag == "N").alias("ok"), status.alias("status"))
    return agents.retry_outcomes(attempts)


@query(f"WITH {CALLS_SQL} SELECT * FROM o")
def retry_outcomes(spark, d):
    long = lambda c: F.col(c).cast("long").alias(c)
    return _outcomes(spark, d).select("call_id", long("attempts"), "outcome", "waited", long("breaker_failures"))


@query(f"""WITH {CALLS_SQL} SELECT (call_id % 4)::BIGINT AS adapter, count(*) AS calls, sum(attempts - 1)::BIGINT AS retries,
  count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'failed') AS failures FROM o GROUP BY 1""")
def adapter_counters(spark, d):
    return agents.adapter_counters(_outcomes(spark, d).withColumn("adapter", (F.col("call_id") % 4).cast("long")))


@query("""SELECT o_orderkey, trim(coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END, ''), nullif(CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority || ' ' END, ''), '')) AS picked FROM orders""")
def first_value(spark, d):
    k = F.col("o_orderkey")
    result, context = F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    return read(spark, d, "orders").select("o_orderkey", agents.first_value(result, context, F.lit("")).alias("picked"))


@query("""SELECT event_id AS id FROM events WHERE event_type = 'view' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'purchase')""")
def unanswered_requests(spark, d):
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "purchase", "reply")
    ledger = read(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") - 1).alias("reply_to"))
    return live.open_requests(ledger).select("id")
