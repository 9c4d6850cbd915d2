"""Lookups of live business records, their outcomes and cards, and the records of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import contains_any
from .ranking import by_rows

CARD = ("type", "adapter", "order_id", "sku", "status", "stock", "note", "error")


def lookup(requests: DataFrame, records: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """``requests`` with the columns of ``records`` for the key and an outcome: ``found``,
    ``not_found`` (the source answered, but has no such row) or ``unavailable`` (the key is
    listed in ``failures`` (key, error, attempts)). Requests without a key are ``not_asked``."""
    bad = failures.select(F.col(key).alias("_bad"), "error", "attempts")
    known = records.withColumn("_hit", F.lit(True))
    joined = requests.join(known, key, "left").join(by_rows(bad), F.col(key) == F.col("_bad"), "left")
    outcome = (
        F.when(F.col(key).isNull(), "not_asked").when(F.col("_bad").isNotNull(), "unavailable")
        .when(F.col("_hit").isNotNull(), "found").otherwise("not_found")
    )
    return joined.withColumn("outcome", outcome).drop("_bad", "_hit")


def prompts(question: Column, order_id: Column, sku: Column) -> Column:
    """What to ask for if a question wants live data but names no id: an array of notes."""
    q = F.coalesce(question, F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    order = F.when(blank(order_id) & contains_any(q, V.ORDER_WORDS), F.lit(V.ORDER_PROMPT))
    stock = F.when(blank(sku) & contains_any(q, V.STOCK_WORDS), F.lit(V.STOCK_PROMPT))
    return F.array_compact(F.array(order, stock))


def card_type(degraded: Column, not_found: Column, status: Column, order_id: Column, stock: Column, sku: Column, note: Column) -> Column:
    """What a live record shows: an outage before a miss before an order before stock before a prompt."""
    has = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return (
        F.when(F.coalesce(degraded, F.lit(False)), "degraded").when(F.coalesce(not_found, F.lit(False)), "not_found")
        .when(status.isNotNull() | has(order_id), "order").when(stock.isNotNull() | has(sku), "inventory").when(has(note), "prompt")
    )


def incomplete(kind: Column, status: Column, stock: Column) -> Column:
    return F.when(kind == "order", F.coalesce(status, F.lit("")) == "").when(kind == "inventory", stock.isNull()).otherwise(F.lit(False))


def latest_within(requests: DataFrame, fetches: DataFrame, key: str, ttl: float) -> DataFrame:
    """Each request (request_id, key, ts) with the latest successful fetch (key, ts, value) of its
    key that is younger than ``ttl`` seconds, or null: cached values, and misses to fetch.

    Both sides are put in one order by time in each key and the last fetch is carried forward,
    so the cost is a sort, not a join of all pairs.
    """
    requests, fetches = (df.withColumn("ts", F.col("ts").cast("timestamp")) for df in (requests, fetches))
    r = requests.select(key, "ts", F.lit(1).alias("_side"), "request_id", F.lit(None).cast("timestamp").alias("_at"), F.lit(None).cast(dict(fetches.dtypes)["value"]).alias("value"))
    f = fetches.select(key, "ts", F.lit(0).alias("_side"), F.lit(None).cast(dict(requests.dtypes)["request_id"]).alias("request_id"), F.col("ts").alias("_at"), "value")
    w = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.union(f).withColumn("last", F.last(F.when(F.col("_side") == 0, F.struct("_at", "value")), ignorenulls=True).over(w))
    age = F.col("ts").cast("double") - F.col("last._at").cast("double")
    fresh = age < ttl
    return both.where("_side = 1").select("request_id", key, "ts", F.when(fresh, F.col("last.value")).alias("value"), F.coalesce(fresh, F.lit(False)).alias("cached"))


def action_status(requests: DataFrame) -> DataFrame:
    """``requests`` (action, order_id, field, value, amount, subject, priority, confirmed) with
    status ``executed``, ``needs_confirmation`` or ``rejected``, and the error of the latter."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    need = F.create_map(
        F.lit("create_ticket"), F.array_compact(F.array(F.when(blank("subject"), F.lit("subject")))),
        F.lit("update_order"), F.array_compact(F.array(*(F.when(blank(c), F.lit(c)) for c in ("order_id", "field", "value")))),
        F.lit("request_refund"), F.array_compact(F.array(F.when(blank("order_id"), F.lit("order_id")), F.when(F.col("amount").isNull(), F.lit("amount")))),
        F.lit("list_tickets"), F.array().cast("array<string>"),
    )
    df = requests.withColumn("_missing", F.coalesce(F.try_element_at(need, F.col("action")), F.array().cast("array<string>")))
    known = F.col("action").isin("create_ticket", "update_order", "request_refund", "list_tickets")
    error = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown action")
        .when(F.size("_missing") > 0, F.concat(F.lit("missing: "), F.array_join("_missing", ",")))
        .when((F.col("action") == "create_ticket") & ~F.coalesce(F.upper("priority"), F.lit("P2")).isin(*V.TICKET_SLA), "bad priority")
        .when((F.col("action") == "update_order") & ~F.col("field").isin(*V.FIELD_LABELS), "bad field")
        .when((F.col("action") == "request_refund") & (F.col("amount") <= 0), "bad amount")
    )
    waits = (F.col("action") == "request_refund") & ~F.coalesce("confirmed", F.lit(False))
    invalid = F.when(~F.coalesce(known, F.lit(False)) | (F.size("_missing") > 0), True).otherwise(False)
    status = F.when(invalid, "rejected").when(waits, "needs_confirmation").when(error.isNotNull(), "rejected").otherwise("executed")
    return df.withColumn("status", status).withColumn("error", F.when(F.col("status") == "rejected", error)).drop("_missing")


def action_effects(executed: DataFrame) -> DataFrame:
    """Triples that executed ``create_ticket`` actions write: the ticket with its customer and its
    product, where those are known. ``executed`` has action_id, action, status, ticket_id,
    customer, product, seq."""
    done = executed.where((F.col("action") == "create_ticket") & (F.col("status") == "executed"))
    both = F.array(
        F.struct(F.lit("SUBMITTED_BY").alias("rel"), F.lit("Customer").alias("object_type"), F.col("customer").alias("object")),
        F.struct(F.lit("ABOUT_PRODUCT").alias("rel"), F.lit("Product").alias("object_type"), F.col("product").alias("object")),
    )
    rows = done.select("action_id", "ticket_id", "seq", F.explode(both).alias("t")).where(F.trim(F.coalesce("t.object", F.lit(""))) != "")
    return rows.select(F.lit("Ticket").alias("subject_type"), F.col("ticket_id").alias("subject"), "t.rel", "t.object_type", "t.object", F.col("action_id").alias("doc_id"), "seq")


def critic(questions: DataFrame) -> DataFrame:
    """``questions`` (query, order_id, sku, n_hits, n_facts, n_live, done, declined) with missing:
    the capabilities of retrieval, graph and live that are wanted, lack evidence and have neither
    been tried nor declined; and need_more."""
    q = F.coalesce("query", F.lit(""))
    open_ = lambda c: ~F.array_contains("done", c) & ~F.array_contains("declined", c)
    named = (F.coalesce("order_id", F.lit("")) != "") | (F.coalesce("sku", F.lit("")) != "")
    missing = F.array_compact(
        F.array(
            F.when((F.col("n_hits") == 0) & open_("retrieval"), F.lit("retrieval")),
            F.when((F.col("n_facts") == 0) & open_("graph") & contains_any(q, V.GRAPH_HINTS), F.lit("graph")),
            F.when((named | contains_any(q, V.LIVE_HINTS)) & (F.col("n_live") == 0) & open_("live"), F.lit("live")),
        )
    )
    return questions.withColumn("missing", missing).withColumn("need_more", F.size("missing") > 0)


def assign_agents(needs: DataFrame, agents: DataFrame) -> DataFrame:
    """The first registered agent (agent, capabilities, seq) of each needed capability (query_id, capability)."""
    offers = agents.select("agent", "seq", F.explode("capabilities").alias("capability"))
    first = Window.partitionBy("query_id", "capability").orderBy("seq")
    return needs.join(by_rows(offers), "capability").withColumn("_k", F.row_number().over(first)).where("_k = 1").select("query_id", "capability", "agent")


def open_requests(ledger: DataFrame) -> DataFrame:
    """Requests of a ledger (id, kind, reply_to) that have no reply."""
    replies = ledger.where("kind = 'reply'").select(F.col("reply_to").alias("id"))
    return ledger.where("kind = 'request'").join(replies, "id", "left_anti")
