"""Leaf paths of JSON over VARIANT against a walk."""

import json
import random

from pyspark.sql import functions as F

from tessera.functions.json_paths import json_leaf_paths, leaf_paths


def value(rng, depth):
    kind = rng.choice(["dict", "list", "scalar"]) if depth else "scalar"
    if kind == "dict":
        return {rng.choice("abcdefg") + str(i): value(rng, depth - 1) for i in range(rng.randint(0, 3))}
    if kind == "list":
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, True, None, "x", "", '{"a": 1}', "[1]"])


def test_leaf_paths_as_by_a_walk(spark):
    rng = random.Random(2)
    texts = [json.dumps(value(rng, rng.randint(0, 9))) for _ in range(300)] + ["{", "", None, "null", '"s"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    made = df.select("i", json_leaf_paths("j").alias("p"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.p for r in made.collect()}
    for i, text in enumerate(texts):
        try:
            want = leaf_paths(json.loads(text))
        except (TypeError, ValueError):
            want = []
        assert sorted(got[i] or []) == sorted(want), text
    assert df.select(F.coalesce(json_leaf_paths("j"), F.array(F.lit("?"))).alias("p")).where(F.array_contains("p", "?")).count() == 0
