"""Files to documents."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

EXTENSIONS = ("md", "markdown", "txt", "text", "docx", "pdf")


def clean_markdown(text: Column) -> Column:
    """Without leading front matter, and with fenced blocks replaced by a blank."""
    bare = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*(\n|\z)", "")
    return strip(F.regexp_replace(bare, r"(?s)```.*?```", " "))


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, blank ones left out."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def pdf_text(content: bytes) -> str:
    """Pages of a PDF file; needs the optional package pypdf."""
    from pypdf import PdfReader

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)


def _packed_text(kind: Column, content: Column) -> Column:
    def unpack(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for k, c in zip(kinds, contents, strict=True):
            try:
                rows.append((docx_text(c) if k == "docx" else pdf_text(c), None))
            except Exception as e:  # a bad file is reported in its row and must not stop the scan
                rows.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "error"])

    return F.pandas_udf(unpack, "struct<text:string,error:string>")(kind, content)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, text, error of every file under ``path``. Plain kinds are decoded by the JVM
    (malformed bytes are replaced); DOCX and PDF are unpacked in Arrow batches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = files.select("path", kind.alias("kind"), "content")
    packed = F.col("kind").isin("docx", "pdf")
    plain = rows.where(~packed).select("path", clean_markdown(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.lit(None).cast("string").alias("error"))
    other = rows.where(packed).withColumn("r", _packed_text(F.col("kind"), F.col("content"))).select("path", "r.text", "r.error")
    return plain.unionByName(other)


def read_folder(spark: SparkSession, path: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and (path, error): documents of the known extensions, and files that
    failed. doc_id is the prefix and the relative path without its extension, separators as _."""
    found = read_files(spark, path).where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*EXTENSIONS))
    base = re.sub(r"^[a-z]+:/*", "/", path).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    doc_id = F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(relative, r"\.[^./\\]+$", ""), r"[/\\]+", "_"))
    ok = found.where("error IS NULL").select(doc_id.alias("doc_id"), "text")
    return ok, found.where("error IS NOT NULL").select("path", "error")


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags, blanks joined."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


GOLDEN = "question string, expect_contains string, expect_not_contains array<string>, order_id string, sku string, min_confidence double"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array or JSON-lines file. An expectation is a word or a group
    of synonyms; all become groups. Missing fields get their defaults."""
    first = spark.read.text(path, wholetext=True).select(F.ltrim("value").startswith("[").alias("array")).first()
    raw = spark.read.schema(GOLDEN).option("multiLine", str(bool(first and first.array)).lower()).json(path)
    raw = raw.where("question IS NOT NULL")
    items = F.coalesce(F.from_json("expect_contains", "array<string>"), F.array().cast("array<string>"))
    group = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    return raw.select(
        "question", F.transform(items, group).alias("expect"), F.coalesce("expect_not_contains", F.array().cast("array<string>")).alias("forbid"),
        "order_id", "sku", F.coalesce("min_confidence", F.lit(0.0)).alias("min_confidence"),
    )
