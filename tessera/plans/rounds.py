"""Questions answered in rounds: plan, run workers, judge the evidence, ask for what is missing.

The state of all questions is kept in tables: who has run for which question, the evidence, and
a ledger of requests and replies. A round is one pass over the questions that still have
somebody to run; each worker is a stage (:mod:`.stages`), so one that fails only leaves its
evidence out, and is told apart from one that found nothing. It ends when nobody is left to run or the rounds are used up. A worker runs once
for a question, so there are never more rounds than workers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agents, live
from ..sources.scratch import stored
from .stages import Branch, Stages

CRITIC, CHAIR = "critic", "chair"
LEDGER = "id string, query_id long, round int, kind string, reply_to string, capability string, by string, status string, ask string"
EVIDENCE = "query_id long, channel string, place int, item string, score double"


@dataclass
class Worker:
    """``run`` takes questions and gives evidence (query_id, place, item, score) for ``channel``;
    the first worker of the roster that has a capability is the one asked for it."""

    agent: str
    capabilities: tuple[str, ...]
    channel: str
    run: Callable[[DataFrame], DataFrame]
    role: str = ""
    errors: object = None


@dataclass
class Outcome:
    """What the rounds left: evidence, ran (query_id, round, agent, source, ok), the ledger, and the
    stages. A worker that failed is not ok for all its questions. ``rounds`` is how many passes there were for the question with the most."""

    evidence: DataFrame
    ran: DataFrame
    ledger: DataFrame
    stages: Stages
    rounds: int
    failed: list[str] = field(default_factory=list)

    def collaboration(self, questions: DataFrame) -> DataFrame:
        """query_id, rounds, executed (sorted), negotiated (more than one round), delegated (a
        request that the critic didn't make), requests, replies, declined (sorted capabilities
        that were refused or that nobody could serve), failed (sorted agents that ran and failed)."""
        none = F.array().cast("array<string>")
        per = self.ran.groupBy("query_id").agg(F.max("round").alias("rounds"), F.array_sort(F.collect_set("agent")).alias("executed"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("agent")))).alias("failed"))
        request, refused = F.col("kind") == "request", F.col("status").isin("declined", "unavailable")
        said = self.ledger.groupBy("query_id").agg(
            F.count_if(request).alias("requests"), F.count_if(~request).alias("replies"), F.array_sort(F.collect_set(F.when(refused, F.col("capability")))).alias("declined"),
            F.coalesce(F.bool_or(request & (F.col("by") != CRITIC)), F.lit(False)).alias("delegated"),
        )
        q = questions.select(F.col("query_id").cast("long").alias("query_id")).join(per, "query_id", "left").join(said, "query_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return q.select(
            "query_id", zero("rounds"), F.coalesce("executed", none).alias("executed"), (zero("rounds") > 1).alias("negotiated"), F.coalesce("delegated", F.lit(False)).alias("delegated"),
            zero("requests"), zero("replies"), F.coalesce("declined", none).alias("declined"), F.coalesce("failed", none).alias("failed"),
        )


def counts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``questions`` with n_hits, n_facts and n_live."""
    per = evidence.groupBy("query_id").agg(*(F.count_if(F.col("channel") == c).alias(f"n_{c}") for c in ("hits", "facts", "live")))
    joined = questions.join(per, "query_id", "left")
    return joined.withColumns({f"n_{c}": F.coalesce(f"n_{c}", F.lit(0)) for c in ("hits", "facts", "live")})


def _channels(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, seen: a struct of the items of each channel (bounded by what workers give for a question)."""
    per = evidence.groupBy("query_id").agg(*(F.collect_list(F.when(F.col("channel") == c, F.col("item"))).alias(c) for c in agents.CHANNELS.values()))
    none = F.array().cast("array<string>")
    joined = questions.select("query_id").join(per, "query_id", "left")
    return joined.select("query_id", F.struct(*(F.coalesce(c, none).alias(c) for c in agents.CHANNELS.values())).alias("seen"))


def ask_in_rounds(
    questions: DataFrame, workers: list[Worker], plan: DataFrame, max_rounds: int = 2,
    delegate: Callable[[DataFrame, DataFrame], DataFrame] | None = None, stages: Stages | None = None, strict: bool = False,
) -> Outcome:
    """Run the planned workers (``plan``: query_id, agent) for ``questions`` (query_id, query,
    order_id, sku), then, up to ``max_rounds``, those that the critic's requests, and requests
    that ``delegate`` (evidence, ran) gives as (query_id, by, capability, ask), lead to.

    A request is served by the first worker with the capability. It is declined at once if the
    capability was declined before, and unavailable if nobody has it or that worker has run
    already. One that is served is failed if its worker fails, provided if its channel has grown in
    the round, else declined. With ``strict`` a worker that fails ends the rounds with an error.
    """
    spark = questions.sparkSession
    stages = stages or Stages(spark)
    questions = stored(questions.select(F.col("query_id").cast("long").alias("query_id"), "query", "order_id", "sku"), "questions")
    roster = spark.createDataFrame([(w.agent, list(w.capabilities), i) for i, w in enumerate(workers)], "agent string, capabilities array<string>, seq int")
    skills = F.broadcast(roster.select("agent", F.explode("capabilities").alias("capability")))  # one row for each capability of a worker
    evidence = spark.createDataFrame([], EVIDENCE)
    ran = spark.createDataFrame([], "query_id long, round int, agent string, source string, ok boolean")
    ledger = spark.createDataFrame([], LEDGER)
    known = [w.agent for w in workers]
    pending = plan.select(F.col("query_id").cast("long").alias("query_id"), "agent").where(F.col("agent").isin(known)).distinct().withColumn("source", F.lit("plan"))
    served = None
    rounds = 0
    while rounds < max_rounds:
        pending = stored(pending, "pending")
        busy = {r.agent for r in pending.select("agent").distinct().collect()}  # workers, not questions
        if not busy:
            break
        rounds += 1
        branches = []
        for w in (w for w in workers if w.agent in busy):
            mine = questions.join(pending.where(F.col("agent") == w.agent).select("query_id"), "query_id", "left_semi")
            make = lambda w=w, mine=mine: w.run(mine).withColumn("channel", F.lit(w.channel))
            branches.append(Branch(f"{w.agent}#{rounds}", make, EVIDENCE, w.role, w.errors))
        begun = stages.runs()
        found = stages.run_all(branches)
        lost = stages.failures(begun)
        if strict and lost:
            raise RuntimeError("workers failed: " + "; ".join(f"{stage}: {summary}" for stage, summary in sorted(lost)))
        failed = [stage.rsplit("#", 1)[0] for stage, _ in lost]
        before, evidence = evidence, reduce(DataFrame.unionByName, found.values(), evidence)
        ran = ran.unionByName(pending.select("query_id", F.lit(rounds).alias("round"), "agent", "source", (~F.col("agent").isin(failed)).alias("ok")))
        if served is not None:
            both = _channels(before, questions).withColumnRenamed("seen", "before").join(_channels(evidence, questions).withColumnRenamed("seen", "after"), "query_id")
            gains = agents.evidence_gain(served.select("query_id", "capability", "id", "who").join(both, "query_id"), keep=("id", "who"))
            status = F.when(F.col("who").isin(failed), "failed").when(F.col("gained"), "provided").otherwise("declined")
            ledger = ledger.unionByName(stored(_replies(gains, rounds, F.col("who"), status), "replies"))
        if rounds == max_rounds:
            break
        # a question for which nobody ran is done
        active = questions.join(pending.select("query_id").distinct(), "query_id", "left_semi")
        pending, served, ledger = _next(active, evidence, ran, ledger, roster, skills, rounds, delegate)
    left = live.open_requests(ledger)
    ledger = stored(ledger.unionByName(_replies(left, rounds, F.lit(CHAIR), F.lit("unavailable"))), "ledger")
    return Outcome(evidence, ran, ledger, stages, rounds, stages.failed())


def _replies(requests: DataFrame, rnd: int, by, status) -> DataFrame:
    return requests.select(
        F.concat(F.col("id"), F.lit(":reply")).alias("id"), "query_id", F.lit(rnd).alias("round"), F.lit("reply").alias("kind"), F.col("id").alias("reply_to"), "capability",
        by.alias("by"), status.alias("status"), F.lit("").alias("ask"),
    )


def _next(questions, evidence, ran, ledger, roster, skills, rnd, delegate):
    """(who runs next, the requests that they serve, the ledger) after a round."""
    no = F.array().cast("array<string>")
    done = ran.join(skills, "agent").groupBy("query_id").agg(F.collect_set("capability").alias("done"))
    refused = ledger.where("kind = 'reply' AND status IN ('declined', 'unavailable')").groupBy("query_id").agg(F.collect_set("capability").alias("declined"))
    state = counts(questions, evidence).join(done, "query_id", "left").join(refused, "query_id", "left")
    state = state.withColumns({c: F.coalesce(c, no) for c in ("done", "declined")})
    asked = live.critic(state).select("query_id", F.explode("missing").alias("capability"), F.lit(CRITIC).alias("by"), F.lit("evidence is missing").alias("ask"))
    if delegate is not None:
        more = delegate(evidence, ran).select(F.col("query_id").cast("long").alias("query_id"), "capability", "by", "ask")
        asked = asked.unionByName(more.join(questions.select("query_id"), "query_id", "left_semi"))
    # one open request for a capability is enough; the critic's comes first
    once = asked.groupBy("query_id", "capability").agg(F.min_by(F.struct("by", "ask"), F.struct(F.col("by") != CRITIC, "by", "ask")).alias("r"))
    waiting = live.open_requests(ledger).select("query_id", "capability")
    once = once.join(waiting, ["query_id", "capability"], "left_anti")
    fresh = once.select(
        F.concat_ws(":", F.col("query_id").cast("string"), F.lit(str(rnd)), "capability").alias("id"), "query_id", F.lit(rnd).alias("round"), F.lit("request").alias("kind"),
        F.lit(None).cast("string").alias("reply_to"), "capability", "r.by", F.lit(None).cast("string").alias("status"), "r.ask",
    )
    ledger = stored(ledger.unionByName(fresh), "ledger")
    open_ = live.open_requests(ledger)
    who = live.assign_agents(open_.select("query_id", "capability").distinct(), roster).withColumnRenamed("agent", "who")
    has_run = ran.select("query_id", F.col("agent").alias("who"), F.lit(True).alias("has_run")).distinct()
    judged = open_.join(who, ["query_id", "capability"], "left").join(has_run, ["query_id", "who"], "left").join(refused, "query_id", "left")
    was_refused = F.coalesce(F.array_contains("declined", F.col("capability")), F.lit(False))
    fate = F.when(was_refused, "declined").when(F.col("who").isNull() | F.col("has_run").isNotNull(), "unavailable")
    judged = stored(judged.withColumn("fate", fate), "judged")
    closed = judged.where("fate IS NOT NULL")
    served = judged.where("fate IS NULL")
    source = F.when(F.bool_or(F.col("by") == CRITIC), "negotiation").otherwise("delegation")
    pending = served.groupBy("query_id", F.col("who").alias("agent")).agg(source.alias("source"))
    return pending, served, ledger.unionByName(stored(_replies(closed, rnd, F.lit(CHAIR), F.col("fate")), "closed"))


