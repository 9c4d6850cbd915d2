"""Streams into files: order by event time, restarts, and states that go."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.streaming import state

EVENTS = "client string, ts double, place long"


def files(spark, folder, batches):
    """A stream that takes one file at a time."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            if name.endswith(".parquet"):
                os.utime(f"{folder}/{i}/{name}", (time.time() - 100 + i,) * 2)
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def by_hand(rows, limit, seconds):
    at, out = {}, set()
    for client, ts, place in sorted(rows, key=lambda r: (r[1], r[2])):
        at[client], ok = state.limit_step(at.get(client), ts, limit, seconds)
        out.add((client, place, at[client][1], ok))
    return out


def test_events_of_later_batches_are_put_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), 1000.0 + rng.randint(0, 400) / 4, i) for i in range(120)]
    # the second batch holds earlier events too, within the lateness; the last lets all pass
    batches = [rows[:60], rows[60:], [("~", 90_000.0, 999)]]
    s = state.limit_stream(files(spark, f"{tmp_path}/in", batches), 3, 20, late="200 seconds")
    out = state.drained(s, f"file://{tmp_path}/out")
    assert {(r.client, r.place, r.n, r.admitted) for r in out.collect()} == by_hand(rows, 3, 20)


def test_a_restart_goes_on_and_idle_states_go(spark, tmp_path):
    first, second = [("a", 10.0, 1), ("a", 11.0, 2), ("b", 12.0, 3)], [("a", 500.0, 4), ("c", 501.0, 5)]
    path = f"file://{tmp_path}/out"

    def run(batches):
        q = state.to_files(state.limit_stream(files(spark, f"{tmp_path}/in", batches), 1, 30, late="5 seconds"), path)
        q.awaitTermination()
        return q

    run([first, [("~", 100.0, 90)]])
    done = spark.read.parquet(path)
    assert done.count() == 3
    states = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in run([[], [], second, [("~", 2000.0, 91)], [("~", 3000.0, 92)]]).recentProgress if p.stateOperators]
    got = {(r.client, r.place, r.n, r.admitted) for r in spark.read.parquet(path).where("client <> '~'").collect()}
    assert got == by_hand(first + second, 1, 30)
    assert states[-1] < max(states)  # a, b and c are forgotten, only what still waits is left


def test_breaker_stream_as_step_by_step(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("xy"), 1000.0 + i, i, rng.random() < 0.5) for i in range(40)]
    schema = "backend string, ts double, place long, ok boolean"
    spark.createDataFrame([*rows, ("~", 9e5, 99, True)], schema).write.parquet(f"{tmp_path}/in")
    out = state.drained(state.breaker_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, 4), f"file://{tmp_path}/out")
    at, want = {}, set()
    for backend, ts, place, ok in rows:
        at[backend], called, after = state.breaker_step(at.get(backend), ts, ok, 2, 4)
        want.add((backend, place, called, after))
    assert {(r.backend, r.place, r.called, r.state) for r in out.where("backend <> '~'").collect()} == want
    batch = state.breaker_states(spark.createDataFrame(rows, schema), 2, 4)
    assert {(r.backend, r.place, r.called, r.state) for r in batch.collect()} == want


@pytest.mark.parametrize("by", [None, ["g"]])
def test_nearest_rank_looks_into_few_ranges(spark, by):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 60))])) for _ in range(500)] + [("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    qs = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {((r.g if by else None), r.q): r.value for r in evaluation.nearest_rank(df, "v", qs, by).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g if by else None, []).append(v)
    assert got == {(g, q): sorted(vs)[round((len(vs) - 1) * q)] for g, vs in groups.items() for q in qs}
    plan = evaluation.nearest_rank(df, "v", qs, by)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert evaluation.nearest_rank(df.limit(0), "v", qs, by).count() == 0 and df.agg(F.count("*")).first()[0] == 501
