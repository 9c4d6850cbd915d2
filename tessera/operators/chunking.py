"""Documents to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import LINE_ENDS, strip

_HEADING, _KEY_VALUE, _AMOUNT = re.compile(V.HEADING), re.compile(V.KEY_VALUE), re.compile(V.AMOUNT_WITH_UNIT)
_QUESTION, _ANSWER = re.compile(V.QUESTION_LINE), re.compile(V.ANSWER_LINE)


def windows_of(text: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> list[str]:
    """A text in overlapping windows: each ends after the last break character of its second
    half if there is one, and the next begins ``overlap`` before that end."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = max((text.rfind(c, start + size // 2 + 1, end) for c in V.BREAK_CHARS), default=-1)
            end = cut + 1 if cut >= 0 else end
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def enumerated(line: str) -> list[str]:
    """``key: a, b, c`` as one line for each value, if two values or more carry an amount."""
    m = _KEY_VALUE.match(line.strip())
    if m:
        values = [v.strip() for v in re.split(r"[，,；;]", m.group(2)) if v.strip()]
        if len(values) > 1 and sum(bool(_AMOUNT.search(v)) for v in values) > 1:
            return [f"{m.group(1).strip()}：{v}" for v in values]
    return [line]


def structured_units(text: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> list[str]:
    """Self-contained chunks: headings prefix what follows, a question stays with its answer,
    enumerations are split, and long units are cut into windows."""
    units: list[tuple[str, str]] = []
    heading, question = "", None
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        head, asked, answered = _HEADING.match(line), _QUESTION.match(line), _ANSWER.match(line)
        if question is not None and not answered:
            units.append((heading, f"Q：{question}"))
            question = None
        if head:
            heading = head.group(1)
        elif asked:
            question = asked.group(1)
        elif answered:
            units.append((heading, f"Q：{question} A：{answered.group(1)}" if question is not None else answered.group(1)))
            question = None
        else:
            units += [(heading, u) for u in enumerated(line.lstrip("-*•· \t").strip()) if u]
    if question is not None:
        units.append((heading, f"Q：{question}"))
    whole = [f"{h} / {u}" if h else u for h, u in units]
    return [w for u in whole for w in (windows_of(u, size, overlap) if len(u) > size else [u])] if whole else windows_of(text, size, overlap)


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, strategy: str = "fine") -> DataFrame:
    """key, chunk_index, char_len, content of every document; strategy ``fine`` or ``plain``.
    Null and blank texts have no chunks."""
    cut = windows_of if strategy == "plain" else structured_units

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, i, len(c), c) for k, t in zip(pdf[key], pdf[text], strict=True) for i, c in enumerate(cut(t or "", size, overlap))]
            yield pd.DataFrame(found, columns=[key, "chunk_index", "char_len", "content"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInPandas(rows, f"{key} {kind}, chunk_index int, char_len int, content string")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line (stripped, blank ones left out, numbers kept)."""
    parts = docs.select(key, F.posexplode(F.split(text, LINE_ENDS)).alias("line_no", "line"))
    return parts.withColumn("line", strip(F.col("line"))).where("line <> ''")


def enumerated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, part: lines with enumerations split, by column functions alone."""
    values = F.filter(F.transform(F.split(F.regexp_extract("line", V.KEY_VALUE, 2), "[，,；;]"), lambda v: strip(v)), lambda v: v != "")
    head = strip(F.regexp_extract("line", V.KEY_VALUE, 1))
    with_unit = F.size(F.filter("values", lambda v: v.rlike(V.AMOUNT_WITH_UNIT)))
    split = F.transform("values", lambda v: F.concat("head", F.lit("："), v))
    df = lines(docs, key, text).withColumn("values", values).withColumn("head", head)
    parts = F.when((F.size("values") >= 2) & (with_unit >= 2), split).otherwise(F.array("line"))
    return df.select(key, "line_no", F.explode(parts).alias("part"))


def document_list(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chunks, preview: the first 60 characters of the first chunk with content."""
    first = F.min_by("content", F.when(F.length("content") > 0, F.col("chunk_index")))
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.substring(F.coalesce(first, F.lit("")), 1, 60).alias("preview"))


def document_text(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: the chunks of each document in order, a line break between them."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c["content"]), "\n").alias("text"))
