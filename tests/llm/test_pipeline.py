"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import collections
import random
import zlib

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components

import corpus_pipeline as cp
from tessera.llm import mixing, rule_ensemble

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "Question about the seven rivers of the northern plain and which of them reaches the sea first in spring"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    rows = [r[:5] for r in corpus.rows()]
    rows += [(1000 + i, "\n".join(corpus.sentence(rng, rng.randint(5, 18)) for _ in range(rng.randint(3, 14))), "en", rng.choice("abc"), 1) for i in range(60)]
    around = [corpus.sentence(rng, 12) for _ in range(8)]
    rows += [(2000, "\n".join([*around[:4], ITEM + ".", *around[4:]]), "en", "a", 1)]
    rows += [(3000 + i, f"buy $$$ now {i} ### " * rng.randint(5, 60), "en", "b", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(1000 + i, 1, 0) for i in range(60)] + [(3000 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def one_of_each(rows):
    """The doc_id of the row that stays of each component; rows without words stay, once each."""
    blank = {(r[0], r[1]) for r in rows if not corpus.words(r[1])}
    solid = [r for r in rows if corpus.words(r[1])]
    # components of places, so that rows of one id are told apart
    at = collections.defaultdict(list)
    for i, _, c in brute_components([(i, r[1]) for i, r in enumerate(solid)]):
        at[c].append(solid[i][0])
    return sorted([d for d, _ in blank] + [min(ids, key=lambda d: (d is None, d)) for ids in at.values()], key=repr)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = rows_of(docs)
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mix", "token_output"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "token_output":
            assert out.columns == COLUMNS
            after = rows_of(out)
        if name == "quality_classifier":
            model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            stats = rule_ensemble.statistics(F.col("text"))
            x = docs.select(*COLUMNS, *(stats[k].alias("s_" + k) for k in rule_ensemble.NAMES)).toPandas()
            keep = model.score(x[["s_" + k for k in rule_ensemble.NAMES]].to_numpy(float)) >= rule_ensemble.KEEP_AT
            assert len(after) == keep.sum() and not collections.Counter(after) - collections.Counter(before)
            assert {r[0] for r in after} >= set(range(1000, 1060)) and not {r[0] for r in after} & set(range(3000, 3020))
        elif name == "ngram_jaccard_join":
            assert sorted((r[0] for r in after), key=repr) == one_of_each(before)
        elif name == "benchmark_decontamination":
            assert sorted(after, key=repr) == sorted((r for r in before if ITEM not in (r[1] or "")), key=repr) and len(after) < len(before)
        elif name == "source_mix":
            taken = collections.Counter()
            for r in mixing.mix_documents(docs).collect():  # two texts may have one id
                taken[r.doc_id] += r.taken // max(r["size"], 1)
            assert collections.Counter(r[0] for r in after) == +taken
        else:
            from tokenizers import Tokenizer

            from tessera.llm.token_files import vocabulary

            tokenizer, start, want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0, []
            for r in sorted(before, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
                ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
                want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
        if name != "token_output":
            docs, before = out, after


def test_null_and_repeated_ids_drop_no_unlinked_text(spark):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words)
    near = " ".join([*words[:30], "changed", *words[31:]])
    rows = [
        (None, "one text without an id that stands alone"), (None, "another text without an id, of other words"), (None, "   "),
        (1, text), (2, near), (2, "a text of its own under an id that a near copy has too"), (3, "twice the same"), (3, "twice the same"),
        (None, text), (4, None), (4, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [tuple(r) for r in cp.ngram_jaccard_join(spark, docs, "").collect()]
    assert sorted(out, key=repr) == sorted([rows[i] for i in (0, 1, 2, 3, 5, 6, 9)], key=repr)
    assert sorted((r[0] for r in out), key=repr) == one_of_each(rows)


def test_unlinked_texts_of_one_id_all_stay(spark):
    rows = [(5, "a text of some words on rivers"), (5, "quite another one about the hills"), (6, "and a third of trees in spring"), (5, "a text of some words on rivers")]
    out = cp.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(map(tuple, out.collect())) == sorted(rows[:3])


def test_columns_named_like_inner_ones(spark, sf_dir):
    clash = ("__key", "__twin", "__c", "__id", "__row", "__digest", "__own", "__d", "__place", "__at", "__times", "__copy", "__best")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).withColumns({c: F.lit(c) for c in clash})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert all(r[c] == c for r in out.select(*clash).collect() for c in clash) and (name == "source_mix" or out.count() > 0)


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
