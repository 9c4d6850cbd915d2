"""The corpus operators over the driver's tables, and the SQL for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, conversation_sql, divergence_rules, fill_in_middle, mixing, ngram_join, overlap_bpe, piece_counts, repeat_spans, rule_ensemble, secret_scan, template_decontam, token_files, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to wavelet-matrix files and read back; see :mod:`.token_files`."""
    return token_files.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; see :mod:`.rule_ensemble`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.score(docs, model)
    out = F.coalesce(rule_ensemble.held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= rule_ensemble.KEEP_AT).cast("int").alias("predicted"))


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, and which; see :mod:`.template_decontam`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return template_decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).drop("digest")


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; see :mod:`.divergence_rules`."""
    return divergence_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op5_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; see :mod:`.mixing`."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match piece counts of every document; see :mod:`.piece_counts`."""
    return piece_counts.count_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; see :mod:`.ngram_join`."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings, as digests and as text (bytes of
    a character that a cut parts come out as U+FFFD); see :mod:`.repeat_spans`."""
    left = repeat_spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=True)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document; see :mod:`.secret_scan`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, path="doc_id")
    parts = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    base = [k for k, *_ in secret_scan.BASE]
    is_base = lambda s: F.substring_index(s, ":", 1).isin(base)
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(F.array_join(F.filter(parts, is_base), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(parts, ",").alias("spans"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page; see :mod:`.url_filter`."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every damaged conversation; see :mod:`.conversation_repair`."""
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_repair.repair(damaged)


def op12_overlap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to; see :mod:`.overlap_bpe`."""
    return overlap_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and digests of it and of the text restored from it; see :mod:`.fill_in_middle`."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP10_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM b
), rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), d AS (
  SELECT c.page_id, c.host, c.path, r.h || r.p AS rule, r.v, row_number() OVER (
    PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM c LEFT JOIN rules r ON (c.host = r.h OR c.host LIKE '%.' || r.h) AND starts_with(c.path, r.p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM d WHERE k = 1
"""

OP13_SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), b AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM a
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b
), d AS (
  SELECT *, substring(t, 1, x) AS p, substring(t, x + 1, y - x) AS m, substring(t, y + 1) AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM d
"""

QUERIES = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_template_decontam": op3_template_decontam,
    "op4_divergence_rules": op4_divergence_rules,
    "op5_flow_mix": op5_flow_mix,
    "op6_ngram_join": op6_ngram_join,
    "op7_repeat_spans": op7_repeat_spans,
    "op8_secret_ledger": op8_secret_ledger,
    "op9_piece_counts": op9_piece_counts,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_overlap_bpe": op12_overlap_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL = {"op10_url_filter": OP10_SQL, "op11_conversation_repair": conversation_sql.SQL, "op13_fill_in_middle": OP13_SQL}
