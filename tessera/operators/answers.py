"""Answers from evidence, by template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import without_question


def live_line(c: Column) -> Column:
    """A live card (type, adapter, order_id, sku, status, carrier, eta, stock, warehouse, error,
    attempts, short_circuited, non_retryable, note) in a line; unknown types show their note."""
    s = lambda name: F.coalesce(c[name].cast("string"), F.lit(""))
    why = (
        F.when(F.coalesce(c["short_circuited"], F.lit(False)), F.lit("熔断开路，未发起调用"))
        .when(F.coalesce(c["non_retryable"], F.lit(False)), F.concat(F.lit("请求被后端拒绝，未重试（"), s("error"), F.lit("）")))
        .otherwise(F.concat(F.lit("尝试 "), F.coalesce(c["attempts"].cast("string"), F.lit("0")), F.lit(" 次仍失败")))
    )
    target = F.coalesce(F.nullif(c["order_id"], F.lit("")), c["sku"], F.lit(""))
    return (
        F.when(c["type"] == "order", F.concat(F.lit("订单 "), s("order_id"), F.lit("："), s("status"), F.lit("（"), s("carrier"), F.lit(" 预计 "), s("eta"), F.lit("）")))
        .when(c["type"] == "inventory", F.concat(F.lit("SKU "), s("sku"), F.lit("：库存 "), s("stock"), F.lit("（"), s("warehouse"), F.lit("）")))
        .when(c["type"] == "not_found", F.concat(s("adapter"), F.lit("：未查询到 "), target, F.lit("（后端明确返回不存在，非故障）")))
        .when(c["type"] == "degraded", F.concat(s("adapter"), F.lit("：实时数据暂不可用（"), why, F.lit("）")))
        .otherwise(F.concat(s("adapter"), F.lit("："), s("note")))
    )


def _section(head: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(V.SECTIONS[head])), lines)).otherwise(F.array().cast("array<string>"))


def synthesise(evidence: DataFrame, most_paths: int = 5) -> DataFrame:
    """``evidence`` (query_id, actions, live, paths, hits: arrays of text, in order) with summary
    and answer. Sections come in the order of actions, live data, paths and knowledge; the
    summary is the best hit without its question, 160 characters at most, or else the first
    action, or else a sentence that nothing was found."""
    none = F.array().cast("array<string>")
    actions, live, paths, hits = (F.coalesce(F.col(c), none) for c in ("actions", "live", "paths", "hits"))
    clean = F.transform(hits, without_question)
    top = F.coalesce(F.substring(F.get(clean, F.lit(0)), 1, 160), F.lit(""))
    shown = F.slice(paths, 1, most_paths)
    numbered = lambda a: F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    empty = (F.size(actions) == 0) & (F.size(live) == 0) & (F.size(shown) == 0)
    summary = (
        F.when((top == "") & empty, F.lit(V.NOTHING_FOUND))
        .when((top == "") & (F.size(actions) > 0), F.substring(F.get(actions, F.lit(0)), 1, 160)).otherwise(top)
    )
    parts = F.concat(_section("actions", F.transform(actions, lambda a: F.concat(F.lit("- "), a))), _section("live", live), _section("paths", numbered(shown)), _section("knowledge", numbered(clean)))
    out = evidence.withColumn("summary", summary)
    return out.withColumn("answer", F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(F.col("summary")))
