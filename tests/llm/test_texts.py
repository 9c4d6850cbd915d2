"""Byte-level BPE in chunks and fill-in-the-middle forms, against the library and plain Python."""

from __future__ import annotations

import base64
import hashlib
import random

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as fim
from tessera.llm import overlap_bpe
from tessera.llm.queries import QUERIES


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(overlap_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "don't  stop", "'s's'll 'llx 're've", "a" * 300, " " * 200 + "x", "x" + "\n" * 99 + "y", "1234567 8 ⅷ½", "漢字かな 語" * 40, "ֈ։꟎a ab\U000107bb1",
    "é́ ü 　 z", "\x1c\x1d \x85 a", "🙂🙃 🙂x" * 30, "<|endoftext|>", "\t\r\n \t", "''''''''", "a" * 40 + " " * 40 + "!" * 40 + "'ll" * 20,
]


def odd_docs(spark):
    rows = corpus.rows()
    rows += [(1000 + k, t, *rows[0][2:]) for k, t in enumerate(ODD)]
    rows += [(None, None, *rows[0][2:]), (1000, ODD[0], *rows[0][2:])]
    return rows, spark.createDataFrame(rows, corpus.SCHEMA).repartition(5)


def by_library(library, rows):
    out = []
    for doc, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode_bytes(ids))))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("chunk", "overlap"), [(overlap_bpe.CHUNK, overlap_bpe.OVERLAP), (9, 4), (64, 16), (700, 90)])
def test_chunks_encode_as_the_library_does(spark, library, chunk, overlap):
    rows, docs = odd_docs(spark)
    assert got(overlap_bpe.round_trip(docs, chunk=chunk, overlap=overlap)) == by_library(library, rows)
    assert overlap_bpe.round_trip(docs.limit(0), chunk=chunk, overlap=overlap).count() == 0


def test_parts_are_real_ids_and_bytes(spark, library):
    rows, docs = odd_docs(spark)
    parts = overlap_bpe.decode(overlap_bpe.encode(docs, chunk=100, overlap=20)).collect()
    assert max(p.part for p in parts) > 100
    texts = {}
    for p in sorted(parts, key=lambda p: (p.key or 0, p.part)):
        if p.key is None:
            assert p.part == 0 and list(np.frombuffer(p.ids, "<u4")) == library.encode_ordinary(bytes(p.bytes).decode())
        else:
            ids, raw = texts.setdefault(p.key, ([], []))
            ids += np.frombuffer(p.ids, "<u4").tolist()
            raw.append(bytes(p.bytes))
    long = [t for _, t, *_ in rows if t and len(t.encode()) > 100]
    assert sorted(b"".join(raw).decode() for _, raw in texts.values()) == sorted(long)
    for ids, raw in texts.values():
        assert ids == library.encode_ordinary(b"".join(raw).decode())


def test_letter_classes_are_those_of_the_library(library):
    import public_tokenizers

    foreign = overlap_bpe._foreign_letters(public_tokenizers.PATTERN)
    assert 0x61 not in foreign and 0x6F22 not in foreign
    own = overlap_bpe.Bpe()
    for c in random.Random(1).sample(foreign, min(200, len(foreign))) + [0xE9, 0x2167, 0x6F22, 0x1F642]:
        text = f"a{chr(c)}b1{chr(c)}2 {chr(c)}!"
        ids = own.encode(np.frombuffer(text.encode(), np.uint8))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_query_over_the_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(QUERIES["op12_overlap_bpe"](spark, "/root/testdata/sf0.001")) == by_library(library, docs.select("doc_id", "text").collect())


# ---------------------------------------------------------------- fill in the middle


@pytest.mark.parametrize("n", [0, 1, 63, 64, 512, 5000])
def test_rank_and_select(n):
    bits = np.random.default_rng(n).random(n) < 0.3
    own = fim.RankSelect(bits)
    assert own.rank(np.arange(n + 1)).tolist() == [int(bits[:i].sum()) for i in range(n + 1)]
    places = np.flatnonzero(bits)
    assert own.select(np.arange(len(places) + 2)).tolist() == [*places.tolist(), n, n]


def by_hand(doc, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, text)
    p, m, s = text[:x], text[x:y], text[y:]
    if h4 % 100 < 20:
        return (doc, n, "spm", x, y - x, f"<S>{s}<P>{p}<M>{m}")
    return (doc, n, "psm", x, y - x, f"<P>{p}<S>{s}<M>{m}")


def test_forms_and_their_way_back(spark):
    rows, _ = odd_docs(spark)
    extra = ["a<P>b", "<S>", "x<M>", "<P", "<", "P>", "<S<S", ">M>", "<M<P", "é" * 700, "🙂" * 65]
    rows += [(5000 + 40 * i + k, t, *rows[0][2:]) for k, t in enumerate(extra) for i in range(40)]
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(5)
    made = fim.fill_in_middle(docs)
    assert got(made) == sorted((by_hand(r[0], r[1]) for r in rows), key=repr)
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert got(back) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_shares_and_seed_are_parameters(spark):
    docs = spark.createDataFrame([(k, "some words of a text") for k in range(300)], "doc_id long, text string")
    forms = {r.form: r["count"] for r in fim.fill_in_middle(docs, plain_percent=0, suffix_first_percent=100).groupBy("form").count().collect()}
    assert forms == {"spm": 300}
    other = fim.fill_in_middle(docs, seed="2").exceptAll(fim.fill_in_middle(docs))
    assert other.count() > 200
    assert {r.form for r in fim.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}


def test_fill_query_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        made = by_hand(r.doc_id, r.text)
        want.append((*made[:5], sha(made[5].encode()), sha((r.text or "").encode())))
    assert got(QUERIES["op13_fill_in_middle"](spark, "/root/testdata/sf0.001")) == sorted(want, key=repr)


def test_urls_with_columns_named_like_inner_ones(spark):
    from tessera.llm import url_filter

    pages = spark.createDataFrame([(1, "https://a.example.org/es/x", "b"), (2, None, "c")], "page_id long, url string, `__best` string")
    out = {r.page_id: (r["__best"], r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert out == {1: ("b", "block"), 2: ("c", "allow")}
