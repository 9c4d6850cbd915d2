"""Connected components of links: contraction inside tasks, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, stored

#: Links that a task contracts at once (some 50 MB). No more than so many are ever solved by one task.
CHUNK = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node but the least ones themselves."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    led = label != np.arange(len(nodes))
    return nodes[led], nodes[label[led]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v; u > v) that connect the same nodes: of what a task reads at once, stars."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out():
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= CHUNK:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return links.select("u", "v").mapInArrow(lean(rows), "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v; any order, repeats allowed): root is the
    smallest node of its component. Each task first contracts the links it holds to stars. Once
    at most ``CHUNK`` links are left, one task contracts them to the components; while more are
    left, large and small stars alternate with contraction. Links never come to the driver, each
    round is written as a table, and a hub's links are joined with its smallest neighbour, never
    gathered."""
    edges = stored(contracted(links.where("u <> v")), "edges")
    state = _state(edges)
    while state[0] > CHUNK:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        own = large.join(least, "u")
        small = own.select("v", "m").union(least.select(F.col("u").alias("v"), "m")).where("v <> m")
        edges = stored(contracted(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    if 0 < state[0] <= CHUNK:
        edges = stored(contracted(edges.coalesce(1)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
