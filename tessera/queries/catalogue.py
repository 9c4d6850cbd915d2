"""Queries of the engine over the driver's tables, each with SQL for the same rows.

Lexicons for the Latin-script tables are parameters here; the fixed Chinese ones are the
defaults of the operators and are tested with fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluation, logs, ranking
from ..operators.embedders import embedder
from ..sources.files import clean_markdown, page_text
from . import chunk_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark, d):
    """Documents as chunks of the search operators: id, text."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def questions(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]')"

# ---------------------------------------------------------------- tokens and lexical ranking


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_terms FROM documents")
def tokenize_stats(spark, d):
    t = T.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query(f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
GROUP BY term ORDER BY df DESC, term LIMIT 50""")
def term_df_top(spark, d):
    tf = ranking.term_frequencies(chunks(spark, d))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(50)


BM25_CTE = f"""tok AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS id, len({TOKENS}) AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, id, round(sum(qtf * ln((n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS bm25
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY query_id, id),
lx AS (SELECT *, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS norm FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM bm) WHERE rank <= 30)"""


@query(f"WITH {BM25_CTE} SELECT query_id, id, bm25, rank FROM lx WHERE rank <= 10")
def bm25_batch(spark, d):
    scores = ranking.bm25(chunks(spark, d), questions(spark, d), top=10)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id"))
    return scores.withColumn("rank", rank.cast("long")).where("rank <= 10")


@query(f"WITH {BM25_CTE} SELECT query_id, id, bm25 FROM bm ORDER BY bm25 DESC, query_id, id LIMIT 10")
def bm25_topk(spark, d):
    """The ten best matches of all questions."""
    return ranking.bm25(chunks(spark, d), questions(spark, d), top=10).orderBy(F.desc("bm25"), "query_id", "id").limit(10)


@query(f"WITH {BM25_CTE} SELECT query_id, id, norm FROM lx WHERE bm25 > 0")
def bm25_norm(spark, d):
    return ranking.top_lexical(ranking.bm25(chunks(spark, d), questions(spark, d), top=30), 30).select("query_id", "id", "norm")


def _embed_sql(table: str, key: str) -> str:
    low = "('0x' || substr(md5(term), 13, 4))::INT"
    return f"""SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
  SELECT id, {low} % 1024 AS idx, sum(CASE WHEN ({low} >> 7) & 1 = 1 THEN 1e0 ELSE -1e0 END) AS w
  FROM (SELECT {key} AS id, unnest({TOKENS}) AS term FROM {table}) GROUP BY ALL) WHERE w <> 0"""


@query(f"SELECT id, idx::INT AS idx, round(weight, 6) AS weight FROM ({_embed_sql('documents', 'doc_id')})")
def hash_embed(spark, d):
    return ranking.hash_embedding(chunks(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"SELECT id, round(sum(weight * weight), 3) AS norm2, count(*) AS n_slots FROM ({_embed_sql('documents', 'doc_id')}) GROUP BY id")
def hash_embed_norm(spark, d):
    e = ranking.hash_embedding(chunks(spark, d))
    return e.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 3).alias("norm2"), F.count("*").alias("n_slots"))


HYBRID_CTE = BM25_CTE + f""",
de AS ({_embed_sql('documents', 'doc_id')}), qe AS ({_embed_sql('benchmark', 'item_id')}),
cs AS (SELECT qe.id AS query_id, de.id, round(sum(qe.weight * de.weight), 6) AS vec_score FROM qe JOIN de USING (idx) GROUP BY ALL),
vx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_score DESC, id) AS rank FROM cs) WHERE rank <= 30),
lp AS (SELECT * FROM lx WHERE bm25 > 0),
fu AS (SELECT query_id, id, v.vec_score, l.bm25, l.norm,
  round(coalesce(1e0 / (60 + v.rank), 0) + coalesce(1e0 / (60 + l.rank), 0), 6) AS rrf,
  round(coalesce(v.vec_score, 3e-1 * coalesce(l.norm, 0)), 7) AS score,
  CASE WHEN l.rank IS NOT NULL THEN 'bm25' ELSE 'vector' END AS source
  FROM vx v FULL OUTER JOIN lp l USING (query_id, id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fu)"""


@query(f"WITH {HYBRID_CTE} SELECT query_id, id, score, rrf, source, rank FROM rk WHERE rank <= 5")
def hybrid_rrf(spark, d):
    hits = ranking.hybrid_search(chunks(spark, d), questions(spark, d))
    return hits.select("query_id", "id", "score", "rrf", "source", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HYBRID_CTE} SELECT query_id, id, score, rank FROM (SELECT query_id, id, round(3e-1 * norm, 7) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1e0 / (60 + rank), 6) DESC, id) AS rank FROM lp) WHERE rank <= 5")
def hybrid_structured_mode(spark, d):
    hits = ranking.hybrid_search(chunks(spark, d), questions(spark, d), mode="structured")
    return hits.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HYBRID_CTE} SELECT query_id, id, score, rank FROM (SELECT query_id, id, vec_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1e0 / (60 + rank), 6) DESC, id) AS rank FROM vx) WHERE rank <= 5")
def hybrid_vector_mode(spark, d):
    hits = ranking.hybrid_search(chunks(spark, d), questions(spark, d), mode="vector")
    return hits.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {HYBRID_CTE}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS r FROM fu
  WHERE NOT (vec_score IS NOT NULL AND vec_score < 35e-2 AND coalesce(norm, 0) < 3e-1))
SELECT query_id, count(*) AS n_hits, max(score) AS best FROM kept WHERE r <= 5 GROUP BY query_id""")
def hybrid_threshold(spark, d):
    hits = ranking.hybrid_search(chunks(spark, d), questions(spark, d), min_score=0.35)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"))


@query(f"""WITH {HYBRID_CTE}, top AS (SELECT query_id, score FROM rk WHERE rank = 1)
SELECT query_id, score, CASE WHEN score >= 35e-2 THEN '高' WHEN score >= 2e-1 THEN '中' ELSE '低' END AS label,
  round(CASE WHEN score = 0 THEN score ELSE least(1e0, score + 3e-2 * least(query_id % 4, 2)) END, 6) AS boosted,
  CASE WHEN score < 2e-1 THEN 'escalate' ELSE 'pass' END AS guardrail FROM top""")
def confidence_and_guardrail(spark, d):
    top = ranking.hybrid_search(chunks(spark, d), questions(spark, d), top_k=5).where("rank = 1")
    s, facts = F.col("score"), (F.col("query_id") % 4).cast("int")
    return top.select("query_id", "score", ranking.confidence_label(s).alias("label"), F.round(ranking.confidence_boost(s, facts), 6).alias("boosted"), ranking.guardrail(s).alias("guardrail"))


def _projection_sql(table: str, key: str) -> str:
    part = lambda at, width: f"('0x' || substr(md5(term), {at}, {width}))::INT"
    slots = " UNION ALL ".join(f"SELECT id, {part(1 + 4 * j, 4)} % 256 AS idx, CASE WHEN {part(17 + j, 1)} >= 8 THEN w ELSE -w END AS w FROM l" for j in range(4))
    return f"""SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
  WITH l AS (SELECT id, term, 1 + ln(count(*)) AS w FROM (SELECT {key} AS id, unnest({TOKENS}) AS term FROM {table}) GROUP BY ALL)
  SELECT id, idx, sum(w) AS w FROM ({slots}) GROUP BY ALL) WHERE abs(w) > 1e-9"""


@query(f"SELECT id, idx::INT AS idx, round(weight, 6) AS weight FROM ({_projection_sql('documents', 'doc_id')})")
def embed_projection(spark, d):
    """All documents by the projection embedder."""
    return embedder("projection").embed(chunks(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"""WITH de AS ({_projection_sql('documents', 'doc_id')}), qe AS ({_projection_sql('benchmark', 'item_id')}),
cs AS (SELECT qe.id AS query_id, de.id, round(sum(qe.weight * de.weight), 6) AS vec_score FROM qe JOIN de USING (idx) GROUP BY ALL)
SELECT query_id, id, vec_score AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_score DESC, id) AS rank FROM cs) WHERE rank <= 5""")
def search_projection(spark, d):
    """Vector search by the projection embedder in place of the hash embedder."""
    hits = ranking.hybrid_search(chunks(spark, d), questions(spark, d), mode="vector", embedder=embedder("projection"))
    return hits.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def _mmr_sql(candidates: str, pairs: str, key: str) -> str:
    """CTEs c (query_id, id, score, place), p (query_id, a, b, sim) and the greedy choice of five of c."""
    return f"""c AS MATERIALIZED ({candidates}), p AS MATERIALIZED ({pairs}),
g AS (SELECT query_id, [first(id ORDER BY score DESC, place)] AS sel, 1 AS k FROM c GROUP BY query_id UNION ALL
  SELECT query_id, list_append(any_value(sel), first(id ORDER BY val DESC, place)), any_value(k) + 1 FROM (
    SELECT g.query_id, g.sel, g.k, c.id, c.place, round(6e-1 * c.score - 4e-1 * greatest(0, max(p.sim)), 9) AS val
    FROM g JOIN c ON c.query_id = g.query_id JOIN p ON p.query_id = c.query_id AND p.a = c.id AND list_contains(g.sel, p.b)
    WHERE g.k < 5 AND NOT list_contains(g.sel, c.id) GROUP BY g.query_id, g.sel, g.k, c.id, c.place, c.score) GROUP BY query_id),
ch AS (SELECT query_id, unnest(sel) AS id, generate_subscripts(sel, 1) AS rank FROM (SELECT query_id, arg_max(sel, k) AS sel FROM g GROUP BY query_id)),
fewer AS (SELECT query_id FROM c GROUP BY query_id HAVING count(*) <= 5)
SELECT query_id, id AS {key}, c.score, CASE WHEN query_id IN (FROM fewer) THEN c.place ELSE rank END AS rank FROM ch JOIN c USING (query_id, id)"""


@query("WITH RECURSIVE " + HYBRID_CTE + ", " + _mmr_sql(
    "SELECT query_id, id, score, rank AS place FROM rk",
    """SELECT query_id, a, b, coalesce(sum(x.weight * y.weight), 0) AS sim FROM (SELECT a.query_id, a.id AS a, b.id AS b FROM c a JOIN c b USING (query_id))
  LEFT JOIN de x ON x.id = a LEFT JOIN de y ON y.id = b AND y.idx = x.idx GROUP BY ALL""", "id",
))
def hybrid_mmr(spark, d):
    hits = ranking.hybrid_search(chunks(spark, d), questions(spark, d), lam=0.6)
    return hits.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- vectors and metrics

COS = "round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6)"
VEC_CTE = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
al AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, {COS} AS score FROM q, v),
rv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM al)"""


def _vectors(spark, d):
    """All vectors, and the stated query set: every row whose id is divisible by 50."""
    v = read(spark, d, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def _ranked(spark, d, k):
    v, q = _vectors(spark, d)
    hits = ranking.vector_top_k(v, q.select("query_id", "embedding"), k)
    labels = v.select("vec_id", "label")
    return hits.join(ranking.by_rows(q.select("query_id", "query_label")), "query_id").join(labels, "vec_id")


@query(f"WITH {VEC_CTE} SELECT query_id, vec_id, score, rank FROM rv WHERE rank <= 10")
def vector_batch_topk(spark, d):
    v, q = _vectors(spark, d)
    return ranking.vector_top_k(v, q, 10).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT list(m ORDER BY i) AS e FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY i))
SELECT vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score
FROM q, v ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark, d):
    """The vectors nearest to the mean of all."""
    v = read(spark, d, "embeddings")
    means = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("q"))  # a number for each dimension
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(ranking.cosine(F.col("q"), F.col("embedding")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"WITH {VEC_CTE} SELECT query_id, count(*) AS n FROM rv WHERE rank <= 20 AND score >= 2e-1 GROUP BY query_id")
def vector_threshold(spark, d):
    v, q = _vectors(spark, d)
    return ranking.vector_top_k(v, q, 20).where("score >= 0.2").groupBy("query_id").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + VEC_CTE + ", " + _mmr_sql(
    "SELECT query_id, vec_id AS id, score, rank AS place FROM rv WHERE rank <= 30",
    f"SELECT a.query_id, a.id AS a, b.id AS b, {COS} AS sim FROM c a JOIN c b USING (query_id) JOIN v q ON q.vec_id = a.id JOIN v ON v.vec_id = b.id", "vec_id",
))
def mmr_rerank(spark, d):
    v, q = _vectors(spark, d)
    hits = ranking.vector_top_k(v, q, 30).drop("rank").join(v.select("vec_id", "embedding"), "vec_id")
    return ranking.mmr(hits, 5, 0.6, "vec_id").withColumn("rank", F.col("rank").cast("long"))


METRICS = ", ".join(
    f"""round(avg(CASE WHEN own_rank <= {k} THEN 1e0 ELSE 0 END), 4) AS strict_recall_{k}, round(avg(CASE WHEN first <= {k} THEN 1e0 ELSE 0 END), 4) AS semantic_recall_{k},
round(avg(coalesce(dcg{k}, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least({k}, greatest(n_rel, 1))) t(i))), 4) AS ndcg_{k}, round(avg(coalesce(hits{k}, 0) / {k}e0), 4) AS precision_{k}"""
    for k in (1, 3, 5)
)


@query(f"""WITH {VEC_CTE}, o AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, label = query_label AS rel FROM al WHERE vec_id <> query_id),
w AS (SELECT query_id, min(CASE WHEN rel THEN rank END) AS first, {", ".join(f"sum(CASE WHEN rel AND rank <= {k} THEN 1 ELSE 0 END) AS hits{k}, sum(CASE WHEN rel AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg{k}" for k in (1, 3, 5))} FROM o GROUP BY query_id),
s AS (SELECT query_id, min(rank) AS own_rank FROM rv WHERE vec_id = query_id GROUP BY query_id),
n AS (SELECT q.vec_id AS query_id, count(v.vec_id) AS n_rel FROM q LEFT JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id GROUP BY 1)
SELECT round(avg(coalesce(1e0 / first, 0)), 4) AS mrr, count(*) AS n_queries, {METRICS} FROM n LEFT JOIN w USING (query_id) LEFT JOIN s USING (query_id)""")
def ranking_metrics(spark, d):
    """Relevance is an equal label; a query's own row counts for strict recall only. The whole
    ranking of each query is measured, as the MRR has no cutoff; what lies below the cutoffs of
    the other metrics is counted, not listed."""
    v, q = _vectors(spark, d)
    r = _ranked(spark, d, 6)
    others = r.where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    rows = others.select("query_id", "rank", F.lit(False).alias("own"), (F.col("label") == F.col("query_label")).alias("rel"))
    rows = rows.where("rank <= 5").union(r.where("vec_id = query_id").select("query_id", "rank", F.lit(True), F.lit(False)))
    rows = rows.union(ranking.first_relevant_rank(v, q).where("rank > 5").select("query_id", F.col("rank").cast("int"), F.lit(False), F.lit(True)))
    n = v.groupBy("label").agg(F.count("*").alias("c"))
    relevant = q.join(n, q["query_label"] == n["label"], "left").select("query_id", (F.col("c") - 1).alias("n_rel"))
    return evaluation.ranking_metrics(rows, relevant)


@query(f"WITH {VEC_CTE} SELECT round(avg(score), 6) AS avg_top1 FROM (SELECT query_id, max(score) AS score FROM al WHERE vec_id <> query_id GROUP BY 1)")
def top1_similarity(spark, d):
    v, q = _vectors(spark, d)
    top = ranking.vector_top_k(v, q, 2).where("vec_id <> query_id").groupBy("query_id").agg(F.max("score").alias("s"))
    return top.agg(F.round(F.avg("s"), 6).alias("avg_top1"))


KEY_SQL = r"regexp_replace(lower(text), '[\p{P}\p{S}\s]+', '', 'g')"


@query(f"SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_shared, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicates FROM (SELECT {KEY_SQL} AS k, count(*) AS n FROM documents GROUP BY 1)")
def duplicate_groups(spark, d):
    g = read(spark, d, "documents").groupBy(F.sha2(T.question_key(F.col("text")).cast("binary"), 256).alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_shared"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicates"))


# ---------------------------------------------------------------- chunks


@query(chunk_sql.FINE)
def chunk_structured(spark, d):
    return chunking.chunk(read(spark, d, "documents"))


@query(chunk_sql.PLAIN)
def chunk_plain(spark, d):
    return chunking.chunk(read(spark, d, "documents"), strategy="plain")


LINES_SQL = r"SELECT doc_id, trim(l, E' \t\n\r\x0b\x0c') AS line FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]')) AS l FROM documents) WHERE trim(l, E' \t\n\r\x0b\x0c') <> ''"


@query(f"SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM ({LINES_SQL}) GROUP BY doc_id")
def line_stats(spark, d):
    return chunking.lines(read(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"""WITH l AS ({LINES_SQL}), m AS (SELECT doc_id, line, regexp_extract(line, '^([^：:]{{2,12}})[：:]\\s*(.+)$', 2) AS v FROM l),
s AS (SELECT *, list_filter(list_transform(string_split_regex(v, '[，,；;]'), lambda x: trim(x)), lambda x: x <> '') AS vs FROM m),
k AS (SELECT *, len(vs) >= 2 AND len(list_filter(vs, lambda x: regexp_matches(x, '\\d+(\\.\\d+)?\\s*(分钟|小时|工作日|自然日|天|日|%)'))) >= 2 AS cut FROM s)
SELECT doc_id, sum(CASE WHEN cut THEN len(vs) ELSE 1 END)::BIGINT AS n_parts FROM k GROUP BY doc_id""")
def enumerated_split(spark, d):
    return chunking.enumerated_lines(read(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_parts"))


def _turn_chunks(spark, d):
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))


@query("SELECT conv_id AS doc_id, count(*) AS n_chunks, substr(coalesce(arg_min(text, turn) FILTER (length(text) > 0), ''), 1, 60) AS preview FROM conversations GROUP BY 1")
def document_listing(spark, d):
    return chunking.document_list(_turn_chunks(spark, d))


@query("SELECT conv_id AS doc_id, string_agg(text, E'\\n' ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def document_rebuild(spark, d):
    return chunking.document_text(_turn_chunks(spark, d))


@query("SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
def history_last6(spark, d):
    return logs.last_turns(read(spark, d, "conversations")).select("conv_id", "turn", "role", F.col("back").cast("long").alias("back"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, E'\\n' ORDER BY turn) AS prompt FROM (
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id""")
def conversation_prompts(spark, d):
    return logs.conversation_prompt(read(spark, d, "conversations"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark, d):
    return read(spark, d, "pages").select("page_id", page_text(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '\A---\s*\n.*?\n---\s*(\n|\z)', '', 's'), '```.*?```', ' ', 'gs'), E' \t\n\r\x0b\x0c'))::BIGINT AS n FROM documents""")
def markdown_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(clean_markdown(F.col("text"))).cast("long").alias("n"))
