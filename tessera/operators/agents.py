"""Plans of agents for sets of questions, their evidence, and the outcomes of retried calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff, retryable
from .live import assign_agents
from .ranking import by_rows

#: The evidence that each capability adds to.
CHANNELS = {"retrieval": "hits", "graph": "facts", "live": "live", "action": "actions"}
#: Other names of capabilities.
SYNONYMS = {
    "semantic": "retrieval", "bm25": "retrieval", "keyword": "retrieval", "reasoning": "graph", "kg": "graph",
    "api": "live", "realtime": "live", "actions": "action", "ticket": "action",
}
PLAN = "subtasks array<struct<agent:string,capability:string>>"


def first_value(*sources: Column) -> Column:
    """The first source that is neither null nor empty, trimmed; empty if there is none."""
    return F.trim(F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in sources), F.lit("")))


def plan(questions: DataFrame, agents: DataFrame) -> DataFrame:
    """query_id, step, capability, agent: retrieval always, graph and live unless the question's
    need_graph or need_live is false. ``agents`` has agent, capabilities and seq."""
    need = lambda flag, name: F.when(F.coalesce(F.col(flag), F.lit(True)), F.lit(name))
    wanted = F.array_compact(F.array(F.lit("retrieval"), need("need_graph", "graph"), need("need_live", "live")))
    needs = questions.select("query_id", F.posexplode(wanted).alias("step", "capability"))
    who = assign_agents(needs.select("capability").distinct().select(F.lit(0).alias("query_id"), "capability"), agents)
    return needs.join(F.broadcast(who.drop("query_id")), "capability").select("query_id", "step", "capability", "agent")  # three rows at most


def plan_from_answers(answers: DataFrame, questions: DataFrame, agents: DataFrame) -> DataFrame:
    """query_id, step, agent of plans that a model wrote as JSON inside a noisy ``answer``.

    A subtask names an agent or a capability, in any case; unknown ones are dropped, and an agent
    named twice stays at its first place. Questions without a usable plan take :func:`plan`.
    """
    named = agents.select(F.lower("agent").alias("token"), F.struct(F.lit(0), "seq", "agent").alias("who"))
    able = agents.select(F.explode("capabilities").alias("c"), "seq", "agent").select(F.lower("c").alias("token"), F.struct(F.lit(1), "seq", "agent").alias("who"))
    known = by_rows(named.union(able).groupBy("token").agg(F.min("who").alias("who")).select("token", F.col("who.agent").alias("who")))
    parsed = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), PLAN)
    tasks = answers.select("query_id", F.posexplode(parsed["subtasks"]).alias("at", "t"))
    token = lambda c: F.lower(F.trim(F.col(f"t.{c}")))
    tasks = tasks.join(known.toDF("a", "by_name"), token("agent") == F.col("a"), "left").join(known.toDF("c", "by_capability"), token("capability") == F.col("c"), "left")
    picked = tasks.withColumn("agent", F.coalesce("by_name", "by_capability")).where("agent IS NOT NULL").groupBy("query_id", "agent").agg(F.min("at").alias("at"))
    step = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "agent")) - 1
    made = picked.select("query_id", step.alias("step"), "agent")
    rest = questions.join(made.select("query_id").distinct(), "query_id", "left_anti")
    return made.unionByName(plan(rest, agents).select("query_id", "step", "agent"))


def evidence_gain(rounds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, capability, the columns ``keep``, one difference for each kind of evidence, and gained: whether the
    round added to the capability's own kind, or to any if it has none. ``rounds`` has query_id,
    capability, and before and after, each a struct of the arrays hits, facts, live and actions."""
    n = lambda side, c: F.coalesce(F.array_size(f"{side}.{c}"), F.lit(0))
    diff = {c: n("after", c) - n("before", c) for c in CHANNELS.values()}
    channels = CHANNELS | {k: CHANNELS[c] for k, c in SYNONYMS.items()}
    own = F.coalesce(*(F.when(F.col("capability") == k, diff[c]) for k, c in channels.items()), sum(diff.values(), F.lit(0)))
    return rounds.select("query_id", "capability", *keep, *(d.alias(f"d_{c}") for c, d in diff.items()), (own > 0).alias("gained"))


def retry_outcomes(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """call_id, attempts, outcome, waited, breaker_failures of calls whose attempts (call_id,
    attempt from 1, ok, status) would have ended so.

    A call ends with its first success, its first definite refusal (4xx but 408 and 429: never
    tried again, and no failure to a breaker), or after ``retries`` more attempts. The outcome is
    ok, not_found (404), refused or failed; one aggregation by call decides all.
    """
    definite = F.coalesce(~F.col("ok") & F.col("status").isNotNull() & ~retryable(F.col("status")), F.lit(False))
    row = F.struct(F.col("attempt").alias("n"), F.col("ok").alias("ok"), definite.alias("definite"), F.col("status").alias("status"))
    ends = F.col("ok") | definite | (F.col("attempt") > retries)
    last = attempts.groupBy("call_id").agg(F.coalesce(F.min(F.when(ends, row)), F.max(row)).alias("e"))
    n, settled = F.col("e.n").cast("int"), F.col("e.ok") | F.col("e.definite")
    outcome = F.when(F.col("e.ok"), "ok").when(F.col("e.definite") & (F.col("e.status") == 404), "not_found").when(F.col("e.definite"), "refused").otherwise("failed")
    waits = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: backoff(i))).otherwise(F.array().cast("array<double>"))
    waited = F.aggregate(waits, F.lit(0.0), lambda s, x: s + x)
    return last.select("call_id", n.alias("attempts"), outcome.alias("outcome"), waited.alias("waited"), (n - settled.cast("int")).alias("breaker_failures"))


def adapter_counters(calls: DataFrame) -> DataFrame:
    """adapter, calls, retries, not_found, failures of calls (adapter, attempts, outcome): an
    answer that there is no such record isn't a failure, every other lack of one is."""
    return calls.groupBy("adapter").agg(
        F.count("*").alias("calls"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
        F.count_if(F.col("outcome") == "not_found").alias("not_found"), F.count_if(F.col("outcome").isin("failed", "refused")).alias("failures"),
    )
