"""Entities and triples from text by rules. Lexicons are parameters; defaults are fixed values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import occurrences

CAPS = V.EXTRACTION_CAPS


def category_lexicon(spark: SparkSession, lexicon: dict = V.CATEGORY_KEYWORDS) -> DataFrame:
    """category, keyword, place (of the category)."""
    rows = [(c, k, i) for i, (c, words) in enumerate(lexicon.items()) for k in words]
    return spark.createDataFrame(rows, "category string, keyword string, place int")


def match_categories(docs: DataFrame, lexicon: dict = V.CATEGORY_KEYWORDS, key: str = "doc_id", text: str = "text", most: int = CAPS["categories"]) -> DataFrame:
    """key, category, n, rank: categories by occurrences of their words, the first three. The
    words are compiled into the projection, so texts are neither joined nor shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    counts = F.array(*(F.struct((-sum((occurrences(t, w) for w in words), F.lit(0))).alias("m"), F.lit(i).alias("place"), F.lit(c).alias("category")) for i, (c, words) in enumerate(lexicon.items())))
    best = F.slice(F.array_sort(F.filter(counts, lambda c: c["m"] < 0)), 1, most)
    rows = docs.select(key, F.posexplode(best).alias("_i", "c"))
    return rows.select(key, F.col("c.category").alias("category"), (-F.col("c.m")).alias("n"), (F.col("_i") + 1).alias("rank"))


def match_words(docs: DataFrame, words=V.SOLUTIONS, key: str = "doc_id", text: str = "text", most: int = CAPS["solutions"], name: str = "solution") -> DataFrame:
    """key, name, rank: the first words of the list that occur."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.slice(F.array_compact(F.array(*(F.when(t.contains(w), F.lit(w)) for w in words))), 1, most)
    return docs.select(key, F.posexplode(found).alias("_i", name)).select(key, name, (F.col("_i") + 1).alias("rank"))


def match_pattern(docs: DataFrame, pattern: str, most: int, name: str, key: str = "doc_id", text: str = "text", distinct: bool = False, trim: str = " ") -> DataFrame:
    """key, name, rank: matches of group 1 in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(1)), lambda m: F.btrim(m, F.lit(trim)))
    found = F.array_distinct(found) if distinct else found
    return docs.select(key, F.posexplode(F.slice(found, 1, most)).alias("_i", name)).select(key, name, (F.col("_i") + 1).alias("rank"))


def _nearest(before: str, after: str) -> str:
    ahead = [(after.find(a), i, a) for i, a in enumerate(V.SLA_ACTIONS) if a in after]
    if ahead:
        return min(ahead)[2]
    behind = [(-before.rfind(a), i, a) for i, a in enumerate(V.SLA_ACTIONS) if a in before]
    return min(behind)[2] if behind else ""


def sla_clauses(text: str) -> list[tuple[str, str]]:
    """(name, evidence) of time limits and the action nearest to each in its clause."""
    out: dict[str, str] = {}
    for m in re.finditer(V.SLA_TIME, text):
        before = re.split(V.CLAUSE_MARKS, text[max(0, m.start() - 12) : m.start()])[-1]
        after = re.split(V.CLAUSE_MARKS, text[m.end() : m.end() + 12])[0]
        limit, action = m.group(1) + m.group(3), _nearest(before, after)
        name = f"{limit}内{action}" if action else f"{limit}时限"
        out.setdefault(name, text[max(0, m.start() - 20) : m.end() + 20].replace("\n", " ").strip())
    return list(out.items())[: CAPS["sla"]]


def products(text: str) -> list[str]:
    named = [m.group(1).strip() for m in re.finditer(V.PRODUCT, text)]
    words = [w for w in V.PRODUCT_WORDS if re.search(rf"\b{w}\b", text)]
    return list(dict.fromkeys([n for n in named if len(n) >= 2] + words))[: CAPS["products"]]


def causes(text: str) -> list[str]:
    found = (m.group(1).strip(V.CAUSE_TRIM) for m in re.finditer(V.CAUSE, text))
    return list(dict.fromkeys(c for c in found if 2 <= len(c) <= 24))[: CAPS["causes"]]


def triples_of(text: str, doc_id: str, lexicon: dict = V.CATEGORY_KEYWORDS) -> list[tuple[str, str, str, str, str, str]]:
    """(subject_type, subject, rel, object_type, object, evidence) of one text, the ontology kept."""
    if not text.strip():
        return []
    ranked = sorted(((-sum(map(text.count, words)), i, c) for i, (c, words) in enumerate(lexicon.items())))
    found = [c for n, _, c in ranked if n < 0][: CAPS["categories"]]
    main = found[0] if found else None
    tickets = [m.group(1).strip() for m in re.finditer(V.TICKET, text)][: CAPS["tickets"]]
    customers = [m.group(1).strip() for m in re.finditer(V.CUSTOMER, text)][: CAPS["customers"]]

    def evidence(word: str) -> str:
        at = text.find(word)
        return text[max(0, at - 20) : at + 60].replace("\n", " ").strip() if at >= 0 else ""

    def attach(rel: str, kind: str, name: str, said: str):
        return ("IssueCategory", main, rel, kind, name, said) if main else ("Document", doc_id, "MENTIONS", kind, name, said)

    out = [("Document", doc_id, "MENTIONS", "IssueCategory", c, evidence(c[:2])) for c in found]
    out += [attach("GOVERNED_BY", "SLAClause", n, e) for n, e in sla_clauses(text)]
    out += [attach("SOLVED_BY", "Solution", s, evidence(s)) for s in [w for w in V.SOLUTIONS if w in text][: CAPS["solutions"]]]
    out += [attach("ABOUT_PRODUCT", "Product", p, evidence(p)) for p in products(text)]
    out += [("IssueCategory", main, "CAUSED_BY", "RootCause", c, evidence(c)) for c in causes(text)] if main else []
    out += [("Ticket", t, "CATEGORY_OF", "IssueCategory", main or V.UNCATEGORISED, evidence(t)) for t in tickets]
    out += [("Ticket", tickets[0], "SUBMITTED_BY", "Customer", c, evidence(c)) for c in customers] if tickets else []
    allowed = {(r, s, o) for r, (subjects, objects) in V.RELATIONS.items() for s in subjects for o in objects}
    return [t for t in out if (t[2], t[0], t[3]) in allowed and (t[1] or "").strip() and t[4].strip()]


def extract_triples(docs: DataFrame, key: str = "doc_id", text: str = "text", lexicon: dict = V.CATEGORY_KEYWORDS) -> DataFrame:
    """doc_id, seq (place in the document), subject_type, subject, rel, object_type, object,
    evidence of all documents; match positions need code, so batches go through Arrow."""
    names = ["doc_id", "seq", "subject_type", "subject", "rel", "object_type", "object", "evidence"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, i, *t) for k, x in zip(pdf["k"], pdf["t"], strict=True) for i, t in enumerate(triples_of(x or "", k, lexicon))]
            yield pd.DataFrame(found, columns=names)

    own = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    return own.mapInPandas(rows, "doc_id string, seq long, subject_type string, subject string, rel string, object_type string, object string, evidence string")


def parse_llm_triples(answer: str) -> list[dict]:
    """Triples in the first JSON array of a noisy answer; malformed ones are left out."""
    import json

    a, b = answer.find("["), answer.rfind("]")
    try:
        rows = json.loads(answer[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        rows = []
    want = ("subject", "subject_type", "relation", "object", "object_type")
    return [r for r in rows if isinstance(r, dict) and all(str(r.get(k) or "").strip() for k in want)]


def query_entities(questions: DataFrame, key: str = "query_id", text: str = "query", lexicon: dict = V.CATEGORY_KEYWORDS) -> DataFrame:
    """query_id, name, seq: distinct names other than the document that a question mentions."""
    t = extract_triples(questions, key, text, lexicon)
    names = t.select("doc_id", "seq", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("subject_type").alias("t"), F.col("subject").alias("n")), F.struct(F.lit(1).alias("e"), F.col("object_type").alias("t"), F.col("object").alias("n")))).alias("x"))
    first = names.where("x.t <> 'Document'").groupBy("doc_id", "x.n").agg(F.min(F.col("seq") * 2 + F.col("x.e")).alias("seq"))
    return first.select(F.col("doc_id").alias("query_id"), F.col("n").alias("name"), "seq")


def primary(categories: DataFrame, key: str = "doc_id") -> DataFrame:
    return categories.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("_k = 1").select(key, "category")
