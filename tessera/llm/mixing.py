"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. Each set supplies its words
once at no cost and again at a cost that rises with each repetition; each source demands its
target. A min-cost flow routes the words of sets to sources, and documents are then selected
in a seeded order: each that still fits is taken, until no document left fits.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, by_size, stored

WEIGHTS = (5, 2, 1)
#: Hundredths of all words that the mix takes.
SHARE = 150
#: Most times that a document is taken.
REPEATS = 2
SEED = 20
#: About so many documents share a slot of the seeded order.
SLOT = 2048
BROADCAST_GROUPS = 100_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = REPEATS) -> list[float]:
    """Targets that share ``total`` by weight, none above ``most`` times its size; the excess is
    shared again by weight until none is above."""
    targets, left, open_ = [0.0] * len(sizes), float(total), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def min_cost_flow(supplies: Sequence[int], members: Sequence[Sequence[int]], demands: Sequence[int], repeats: int = REPEATS) -> dict[tuple[int, int, int], int]:
    """(set, source, repetition): words, by successive shortest paths.

    Repetition r of a set supplies its words at cost r*r, which is convex, so no document is
    repeated while a fresh one could be routed. Nodes: start, sets, sources, end.
    """
    n = 2 + len(supplies) + len(demands)
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> int:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, 0))
        cost.extend((w, -w))
        return len(to) - 2

    end = n - 1
    for p, s in enumerate(supplies):
        for r in range(repeats):
            arc(0, 1 + p, s, r * r)
    routes = {(p, s): arc(1 + p, 1 + len(supplies) + s, 1 << 62, 0) for p, own in enumerate(members) for s in own}
    for s, d in enumerate(demands):
        arc(1 + len(supplies) + s, end, d, 0)
    potential = [0] * n
    while True:
        dist, via, heap = [None] * n, [-1] * n, [(0, 0)]
        dist[0] = 0
        done = [False] * n
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            for e in graph[v]:
                if cap[e] > 0:
                    x = d + cost[e] + potential[v] - potential[to[e]]
                    if dist[to[e]] is None or x < dist[to[e]]:
                        dist[to[e]], via[to[e]] = x, e
                        heapq.heappush(heap, (x, to[e]))
        if dist[end] is None:
            break
        far = max(d for d in dist if d is not None)
        for v in range(n):
            potential[v] += far if dist[v] is None else dist[v]
        step, v = 1 << 62, end
        while v:
            step, v = min(step, cap[via[v]]), to[via[v] ^ 1]
        v = end
        while v:
            cap[via[v]] -= step
            cap[via[v] ^ 1] += step
            v = to[via[v] ^ 1]
    flow: dict[tuple[int, int, int], int] = {}
    used = [0] * len(supplies)
    for (p, s), e in sorted(routes.items()):
        left = cap[e ^ 1]
        while left > 0:  # a set's first repetition is filled before its second
            r = used[p] // supplies[p]
            x = min(left, supplies[p] * (r + 1) - used[p])
            flow[p, s, r] = flow.get((p, s, r), 0) + x
            used[p] += x
            left -= x
    return flow


def place_of(doc_id: Column, text: Column) -> Column:
    """A seeded place between 0 and 1 for a document."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    key = F.concat_ws("\x00", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sizes_of(docs: DataFrame, sources: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, members (sorted array of sources) and a seeded place of every row."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), size.alias("size"), sources.alias("members"), place_of(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("place"))


def _before(column: str, keys: list[str], order: str) -> Column:
    """The sum of ``column`` over the rows before this one."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def first_fit(placed: DataFrame, open_: Sequence[int], largest: Sequence[int]) -> list[list[tuple[int, int, int, int | None]]]:
    """For each set g the runs (low, high, most, one) of documents that are taken when all are
    offered in order and each that fits into what is left of ``open_[g]`` is taken: in a run,
    those with ``low < end <= high`` whose size is ``most`` at most, and the one with ``end == one``.

    ``placed``: g, slot, size and end, the words up to and with the document in its set's order.
    A run takes small documents until fewer words than ``most``, the larger of those that still
    come or half of what is left, stay open, or a large one fits. So what is left is halved by
    each run at least, however sizes are ordered; a run is one pass over what may still fit.
    """
    spark = placed.sparkSession
    sized = placed.where("size > 0").select("g", "slot", "size", "end")
    runs: list[list[tuple[int, int, int, int | None]]] = [[] for _ in open_]
    state = {g: (0, int(x)) for g, x in enumerate(open_) if x > 0}
    while state:
        rows = [(g, low, left, min(left // 2, largest[g])) for g, (low, left) in state.items()]
        now = spark.createDataFrame(rows, "g int, low long, left long, most long")
        free = sized.join(by_size(now, len(rows), BROADCAST_GROUPS), "g").where("end > low AND size <= left")
        free = free.withColumn("small", F.when(F.col("size") <= F.col("most"), F.col("size")).otherwise(0))
        slots = free.groupBy("g", "slot").agg(F.sum("small").alias("s"))
        slots = slots.select("g", "slot", _before("s", ["g"], "slot").alias("before_slot"))
        run = F.col("before_slot") + F.sum("small").over(Window.partitionBy("g", "slot").orderBy("end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        free = free.join(slots, ["g", "slot"]).withColumn("run", run)
        one = (F.col("small") == 0) & (F.col("run") + F.col("size") <= F.col("left"))
        stop = one | ((F.col("small") > 0) & (F.col("run") > F.col("left") - F.col("most")))
        first = F.min(F.when(stop, F.struct("end", one.alias("one"), (F.col("run") + F.when(one, F.col("size")).otherwise(0)).alias("words"))))
        found = free.groupBy("g").agg(first.alias("first")).collect()
        before, state = state, {}
        for g, x in found:
            (low, left), most = before[g], min(before[g][1] // 2, largest[g])
            if x is None:  # all small documents that still come fit, and no large one does
                runs[g].append((low, 1 << 62, most, None))
            else:
                runs[g].append((low, x.end, most, x.end if x.one else None))
                if left > x.words:
                    state[g] = (x.end, left - x.words)
    return runs


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(taken, targets). ``sized`` comes from :func:`sizes_of`, written as a table.

    ``targets``: source, source_size, target. Sources are ordered by code point, null last,
    and weigh ``weights`` in turn; a document that belongs to several sources counts for the
    size of each. ``taken``: the columns of ``sized`` and taken, the words the mix takes of
    each row: whole documents, at most ``repeats`` times each.

    Only one row for each distinct set of sources comes to the driver. The order inside a set
    is a seeded hash, cut into slots of about 2,048 documents: sums of slots place each slot,
    and running sums inside a slot place each document, so that a set which holds most of the
    corpus is spread over many tasks. Documents are taken first-fit in this order; see
    :func:`first_fit`.
    """
    spark = sized.sparkSession
    groups = sized.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
    names = sorted({s for g in groups for s in g.members if s is not None}) + ([None] if any(None in g.members for g in groups) else [])
    at = {s: i for i, s in enumerate(names)}
    supplies = [int(g.words) for g in groups]
    members = [[at[s] for s in g.members] for g in groups]
    sizes = [0] * len(names)
    for w, own in zip(supplies, members, strict=True):
        for s in own:
            sizes[s] += w
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(supplies) * share / 100, repeats)
    live = [p for p, w in enumerate(supplies) if w > 0 and members[p]]
    flow = min_cost_flow([supplies[p] for p in live], [members[p] for p in live], [round(t) for t in targets], repeats)
    want = [[0] * repeats for _ in groups]
    for (p, _, r), x in flow.items():
        want[live[p]][r] += x
    # a set's words go round its documents: whole rounds first, then one partial round
    total = [sum(int(x) for x in w) for w in want]
    copies = [t // w if w else 0 for t, w in zip(total, supplies, strict=True)]
    open_ = [t - c * w for t, c, w in zip(total, copies, supplies, strict=True)]
    rows = [(i, list(g.members), max(1, round(g.n / SLOT)), c) for i, (g, c) in enumerate(zip(groups, copies, strict=True))]
    plan = spark.createDataFrame(rows, "g int, members array<string>, slots long, copies long")
    quota = spark.createDataFrame([(s, sizes[i], targets[i]) for s, i in at.items()], "source string, source_size long, target double")

    joined = sized.join(by_size(plan, len(rows), BROADCAST_GROUPS), "members")
    slotted = joined.withColumn("slot", F.floor(F.col("place") * F.col("slots")).cast("long"))
    slot_sums = slotted.groupBy("g", "slot").agg(F.sum("size").alias("s"))
    slot_sums = slot_sums.select("g", "slot", _before("s", ["g"], "slot").alias("before_slot"))
    inside = Window.partitionBy("g", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(inside) + F.col("before_slot")
    placed = stored(slotted.join(slot_sums, ["g", "slot"]).withColumn("end", end), "placed")
    runs = first_fit(placed, open_, [int(g.largest) for g in groups])
    runs = spark.createDataFrame([(i, x) for i, x in enumerate(runs) if x], "g int, runs array<struct<low:long,high:long,most:long,one:long>>")
    placed = placed.join(by_size(runs, len(rows), BROADCAST_GROUPS), "g", "left")
    chosen = F.exists("runs", lambda x: (F.col("end") > x["low"]) & (F.col("end") <= x["high"]) & ((F.col("size") <= x["most"]) | (F.col("end") == x["one"])))
    placed = placed.withColumn("extra", F.coalesce(chosen, F.lit(False)).cast("int"))
    taken = placed.select("doc_id", "size", "members", "place", (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken"))
    return taken, quota


def mix_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, taken for a table whose rows have one source.

    Null texts have size 0 and are never taken; null sources form a source of their own;
    repeated rows are documents of their own; other columns are ignored; an empty table gives
    no rows; a source without words has target 0. Reruns agree, as the order is seeded by
    doc_id and text.
    """
    sized = stored(sizes_of(docs, F.array(F.col(f"`{source}`").cast("string"))), "sized")
    taken, quota = mix(sized)
    taken = taken.select("doc_id", "size", F.col("members")[0].alias("source"), "taken")
    return taken.join(by_size(quota.withColumnRenamed("source", "s"), quota.count(), BROADCAST_GROUPS), F.col("source").eqNullSafe(F.col("s"))).drop("s")
