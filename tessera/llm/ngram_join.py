"""Jaccard join of documents on word n-grams, and the components of its links.

The join is a product of the sparse document by n-gram matrix with its transpose, taken in
blocks and only where the size-derived bounds leave a pair possible:

* Documents of equal sets form one class; only classes are joined.
* N-grams have one order for all documents: by hash, but with the frequent ones last (a bounded
  list of them, counted over all documents; it changes the work, never the result). Each set
  lists its first ``n // 4 + 1`` n-grams and ``n // 10`` more. Of two linked sets, take the one
  whose list ends first: at most ``n // 4`` of its n-grams are missing from the other, so any
  ``n // 4 + 1`` of its list hold one that the other lists too. It therefore suffices to probe
  with its rarest ones, and a set whose list has that many n-grams of its own needs no probe:
  what many documents share is left out, and only near copies are left.
* How many n-grams the two lists must share grows with the other set's size, so each probe holds
  for partners up to a size only, and the rarest probes for the largest.
* Each set is first compared with one leader: the most central set (of the most widely shared
  n-grams) that most of its probes lead to. Components of these links are then known, and only
  sets of different components are compared further. The sets whose leaders are in one component
  are a family; families are cut into blocks, and the product of two blocks is taken inside a task, so the
  pairs of a large group are never rows. Sets that heavy n-grams bring together, those with many
  probes and members, are multiplied in the same way. Other pairs of different families are found
  by the probes, for two components first the pair that shares most of them.
* Sizes bound what two linked sets may lack of each other. Pairs whose sizes exclude the
  similarity, or whose lists have fewer n-grams in common than the sizes demand, are dropped
  before any set is fetched; for the rest, a block's overlap counts are accumulated from its
  incidence rows, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import by_size, lean, shingle_sets, small_batches, stored

WORDS = 5
#: Hundredths of the union that the intersection must reach.
SIMILARITY = 75
#: The list of frequent n-grams has so many entries at most (8 MB), each counted so often at least.
MOST_FREQUENT, LEAST_FREQUENT = 1 << 20, 6
#: A set lists its first n // 4 + 1 n-grams and this share of it more, so that frequent ones needn't be probed.
SLACK = 10
_ALL = (1 << 63) - 1
#: About so many sets of a family, of so many n-grams together, are multiplied with so many others at once.
BLOCK, BLOCK_GRAMS = 192, 1 << 17
#: Blocks of a family that one task multiplies with all blocks that may be linked with them.
PART_BLOCKS = 8
#: An n-gram that would lead to more pairs of sets than this has its sets multiplied in blocks too.
HEAVY_PAIRS = 4096
#: Products of single n-grams that are spread out at once.
SPREAD = 1 << 20
#: N-grams counted at once in a worker.
_COUNTED = 1 << 21
#: Tables up to so many rows of one or two numbers are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: The same for tables of one number, as 64 bits.
BROADCAST_GRAMS = 2_000_000


def frequent_grams(texts: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, rarest first, and their counts: those that repeat among the documents a worker
    counts at once, summed over all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(grams[twice].view(np.int64)), pa.array(counts[twice])], names=["gram", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                held.append(s)
                n += len(s)
                if n >= _COUNTED:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    counted = texts.mapInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    counted = stored(counted, "frequent")
    # how many n-grams have each count: the counts above some size are few
    level, room = None, MOST_FREQUENT
    sizes = counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    for r in sizes:
        if r["count"] > room:
            break
        level, room = r.n, room - r["count"]
    if level is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counted.where(F.col("n") >= level).toPandas().sort_values(["n", "gram"])
    return found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)


def class_table(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS) -> DataFrame:
    """doc_id, n, class (and rest: two halves of a digest of the set), the n-grams that the set
    lists (rare by hash, then frequent from the rarest), the counts of the frequent ones, and
    ``upto``, where in the order of all n-grams the list ends."""
    grams, counts = frequent
    order = np.argsort(grams, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((grams[order], order, counts[order]))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, count = shared.value
        none = np.zeros(0, np.int64)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([none, *x])))
        for batch in batches:
            sizes, digests, rare, often, times, limits = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n = len(s)
                sizes.append(n)
                digests.append(hashlib.md5(s.tobytes()).digest())
                most = min(n, n // 4 + 1 + n // SLACK)
                late = late_counts = none
                place = -1
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    if hit.any():
                        own = at[hit][np.argsort(rank[at[hit]], kind="stable")]
                        s = s[~hit]
                        own = own[: max(0, most - len(s))]
                        late, late_counts = known[own].view(np.int64), count[own]
                        place = int(rank[own[-1]]) if len(own) else -1
                s = s[:most]
                limits.append(_ALL if most == n else (1 << 62) + place if place >= 0 else int(s[-1] >> np.uint64(2)))
                rare.append(s.view(np.int64))
                often.append(late)
                times.append(late_counts)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists(rare), lists(often), lists(times), pa.array(limits, pa.int64())],
                names=["doc_id", "n", "class", "rest", "rare", "often", "times", "upto"],
            )

    schema = "doc_id long, n long, class long, rest long, rare array<long>, often array<long>, times array<long>, upto long"
    table = stored(docs.select("doc_id", "text").mapInArrow(lean(rows), schema), "classes")
    shared.unpersist()
    return table


def _shared_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (gram, class) sorted by both: each row once of grams that two classes have, with the
    number of classes. A group that goes on in the next batch waits for it."""
    rest = None
    schema = pa.schema([("gram", pa.int64()), ("class", pa.int64()), ("times", pa.int64())])

    def out(g, c):
        once = np.append(True, (np.diff(g) != 0) | (np.diff(c) != 0))
        g, c = g[once], c[once]
        first = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1))
        sizes = np.diff(np.append(first, len(g)))
        times = np.repeat(sizes, sizes)
        many = times > 1
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (g, c, times)], schema=schema)

    for batch in batches:
        g, c = (batch.column(i).to_numpy() for i in range(2))
        if rest is not None:
            g, c = (np.concatenate(x) for x in zip(rest, (g, c), strict=True))
        if not len(g):
            continue
        last = int(np.searchsorted(g, g[-1]))
        rest = g[last:], c[last:]
        if last:
            yield out(g[:last], c[:last])
    if rest is not None:
        yield out(*rest)


def class_sets(docs: DataFrame, carriers: DataFrame, n: int, words: int = WORDS) -> DataFrame:
    """class, n, grams (the sorted set as bytes) of the classes in ``carriers`` (class, doc_id)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), words))
            classes = [int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n", "grams"])

    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    wanted = carriers.select(key.alias("key"), "class")
    texts = docs.withColumn("key", key).join(by_size(wanted.select("key").distinct(), n, BROADCAST_ROWS), "key", "left_semi").select("text")
    made = texts.mapInArrow(lean(rows), "class long, n long, grams binary")
    return stored(made.join(by_size(carriers.select("class"), n, BROADCAST_ROWS), "class", "left_semi"), "sets")


def _overlaps(rows: list[np.ndarray], column: np.ndarray) -> np.ndarray:
    """Overlap counts of a block of incidence rows with one document: a sparse product."""
    ends = np.cumsum([len(r) for r in rows])
    grams = np.concatenate(rows)
    at = np.minimum(np.searchsorted(column, grams), len(column) - 1)
    return np.bincount(np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0)), weights=column[at] == grams, minlength=len(rows)).astype(np.int64)


def _possible(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) that sizes and lists leave possible; ``own`` has n, upto and the shared
    n-grams that each class lists. Of the two, the set whose list ends first lacks no more of
    its list than of itself, and lists what it shares together with the other."""
    side = lambda k: own.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("upto").alias(f"upto{k}"), F.transform("grams", lambda g: g["gram"]).alias(f"g{k}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(100 * F.least("nu", "nv") >= SIMILARITY * F.greatest("nu", "nv"))
    overlap = F.ceil(F.lit(SIMILARITY) * (F.col("nu") + F.col("nv")) / F.lit(float(100 + SIMILARITY)) - F.lit(1e-6))
    need = lambda k: _listed(F.col(f"n{k}")) - F.col(f"n{k}") + overlap
    least = F.when(F.col("uptou") < F.col("uptov"), need("u")).when(F.col("uptou") > F.col("uptov"), need("v")).otherwise(F.least(need("u"), need("v")))
    return both.where(F.size(F.array_intersect("gu", "gv")) >= least).select("u", "v")


def _listed(n: Column) -> Column:
    """How many n-grams a set of ``n`` lists."""
    return F.least(n, F.floor(n / 4) + 1 + F.floor(n / SLACK))


def linked(docs: DataFrame, table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) of classes whose sets reach the similarity, as a table."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(u), bool)
            cut = np.flatnonzero(np.diff(v)) + 1
            for a, b in zip([0, *cut], [*cut, len(v)], strict=True):  # rows come by v: a block each
                if a == b:
                    continue
                block = [np.frombuffer(batch.column(2)[i].as_py(), np.uint64) for i in range(a, b)]
                column = np.frombuffer(batch.column(3)[a].as_py(), np.uint64)
                both = _overlaps(block, column)
                union = np.array([len(r) for r in block]) + len(column) - both
                keep[a:b] = 100 * both >= SIMILARITY * union
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    pairs = stored(pairs, "pairs")
    classes = pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct()
    carriers = stored(table.where("n > 0").join(classes, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "carriers")
    grams = class_sets(docs, carriers, carriers.count()).select("class", "grams")
    full = pairs.join(grams.toDF("u", "gu"), "u").join(grams.toDF("v", "gv"), "v").select("u", "v", "gu", "gv")
    return stored(full.mapInArrow(lean(rows), "u long, v long").distinct(), "links")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (class, ...) with root: the smallest class linked with it, or itself."""
    roots = connected_components(links).toDF("class", "r")
    return nodes.join(roots, "class", "left").withColumn("root", F.coalesce("r", "class")).drop("r")


def _product(grams_a: list[np.ndarray], grams_b: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks of incidence rows: their sparse product, by postings."""
    empty = np.zeros(0, np.int64)
    all_b = np.concatenate([empty, *grams_b])
    of_b = np.repeat(np.arange(len(grams_b)), [len(g) for g in grams_b])
    order = np.argsort(all_b, kind="stable")
    all_b, of_b = all_b[order], of_b[order]
    out = np.zeros((len(grams_a), len(grams_b)), np.int64)
    g = np.concatenate([empty, *grams_a])
    of_a = np.repeat(np.arange(len(grams_a)), [len(x) for x in grams_a])
    lo = np.searchsorted(all_b, g, "left")
    n = np.searchsorted(all_b, g, "right") - lo
    met = np.flatnonzero(n)
    lo, n, of_a = lo[met], n[met], of_a[met]
    stop = np.cumsum(n)
    i = 0
    while i < len(n):  # a posting has a row for each set of the block at most
        base = stop[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(stop, base + SPREAD, side="right")))
        at = np.arange(stop[j - 1] - base) + np.repeat(lo[i:j] - (stop[i:j] - n[i:j] - base), n[i:j])
        np.add.at(out.reshape(-1), np.repeat(of_a[i:j] * len(grams_b), n[i:j]) + of_b[at], 1)
        i = j
    return out


_ROW = "class long, root long, n long, upto long, grams array<long>"


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of blocks (x, y: lists of rows) of each family that has several roots; the block
    x never belongs to the family's main root, so its largest component isn't multiplied with itself.

    ``rows`` has family and the columns of a row. Blocks are cut by a hash of the class, so that
    each holds about ``BLOCK`` sets and ``BLOCK_GRAMS`` n-grams at most (or one longer set)."""
    parts = rows.groupBy("family", "root").agg(F.count("*").alias("c"), F.sum(F.size("grams")).alias("w"))
    main = parts.groupBy("family").agg(
        F.count("*").alias("k"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max(F.struct("c", "root", "w")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w")
    ).where("k > 1")
    size = lambda c, w: F.greatest(F.ceil(c / F.lit(float(BLOCK))), F.ceil(w / F.lit(float(BLOCK_GRAMS))), F.lit(1)).cast("long")
    main = main.select("family", "main", size(F.col("most.c"), F.col("most.w")).alias("b_main"), size(F.col("c") - F.col("most.c"), F.col("w") - F.col("most.w")).alias("b_rest"))
    # each part of a family has some of its blocks on one side, and all that may meet them on the other
    main = main.withColumn("parts", F.ceil((F.col("b_main") + F.col("b_rest")) / F.lit(float(PART_BLOCKS))).cast("long"))
    cut = rows.join(main, "family").withColumn("is_main", F.col("root") == F.col("main"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("is_main"), F.col("b_main")).otherwise(F.col("b_rest"))))
    row = F.struct("class", "root", "n", "upto", "grams")
    blocks = stored(cut.groupBy("family", "parts", "is_main", "block").agg(F.collect_list(row).alias("rows")), "family-blocks")
    x = blocks.where("NOT is_main").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("block").alias("bx"), F.col("rows").alias("x"))
    y = blocks.select("family", F.pmod(F.xxhash64("is_main", "block"), F.col("parts")).alias("part"), "is_main", "block", F.col("rows").alias("y"))
    return x.join(y, ["family", "part"]).where("is_main OR bx <= block").select("x", "y")


def _read_block(column: pa.Array, i: int):
    rows = column[i].values
    fields = {k: rows.field(k) for k in ("class", "root", "n", "upto", "grams")}
    grams = [np.asarray(g.values, np.int64) for g in fields.pop("grams")]
    return {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()}, grams


def _each_product(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            (x, gx), (y, gy) = _read_block(batch.column(0), i), _read_block(batch.column(1), i)
            yield x, y, _product(gx, gy)


def _plausible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of block pairs with a partner of another root that sizes and lists leave possible."""
    for x, y, both in _each_product(batches):
        nx, ny, ux, uy = x["n"][:, None], y["n"][None, :], x["upto"][:, None], y["upto"][None, :]
        overlap = -(-SIMILARITY * (nx + ny) // (100 + SIMILARITY))
        listed = lambda n: np.minimum(n, n // 4 + 1 + n // SLACK)
        need_x, need_y = listed(nx) - nx + overlap, listed(ny) - ny + overlap
        need = np.where(ux < uy, need_x, np.where(ux > uy, need_y, np.minimum(need_x, need_y)))
        ok = (both >= need) & (x["root"][:, None] != y["root"][None, :]) & (100 * np.minimum(nx, ny) >= SIMILARITY * np.maximum(nx, ny))
        found = np.concatenate((x["class"][ok.any(axis=1)], y["class"][ok.any(axis=0)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], names=["class"])


def _family_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One link for each two roots that a block pair links."""
    for x, y, both in _each_product(batches):
        union = x["n"][:, None] + y["n"][None, :] - both
        i, j = np.nonzero((100 * both >= SIMILARITY * union) & (x["root"][:, None] != y["root"][None, :]))
        _, first = np.unique(np.stack((x["root"][i], y["root"][j]), axis=1), axis=0, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(x["class"][i[first]]), pa.array(y["class"][j[first]])], names=["u", "v"])


def _as_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(g.as_py(), np.int64) for g in batch.column(4)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["family", "class", "root", "n", "grams"])


def _inside(docs: DataFrame, filled: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v) between different roots of each family of ``rows``, as a table. Products of
    what sets list say which sets may have a link; those are fetched whole and multiplied again."""
    plausible = stored(_block_pairs(rows).mapInArrow(lean(_plausible), "class long").distinct(), "plausible")
    carriers = stored(filled.join(plausible, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "carriers")
    sets = class_sets(docs, carriers, carriers.count()).dropDuplicates(["class"])
    whole = rows.select("family", "class", "root").join(sets, "class").select("family", "class", "root", "n", "grams")
    full = whole.mapInArrow(lean(_as_grams), "family long, class long, root long, n long, grams array<long>")
    return stored(_block_pairs(full.withColumn("upto", F.lit(0).cast("long"))).mapInArrow(lean(_family_links), "u long, v long").distinct(), "links")


def _heavy(probes: DataFrame, members: DataFrame, placed: DataFrame) -> DataFrame:
    """gram: probed n-grams whose probes and members make more than ``HEAVY_PAIRS`` pairs and don't
    all have one root, as a table. As many sets probe or list an n-gram as share it at most, so
    only those that enough sets share are counted."""
    likely = stored(probes.where(F.col("times") * F.col("times") > HEAVY_PAIRS).select("gram").distinct(), "likely")
    n = likely.count()
    roots = placed.select("class", "root")

    def of(df: DataFrame, name: str) -> DataFrame:
        few = df.select("class", "gram").join(by_size(likely, n, BROADCAST_GRAMS), "gram", "left_semi").join(roots, "class")
        return few.groupBy("gram").agg(F.count("*").alias(name), F.min("root").alias(f"least_{name}"), F.max("root").alias(f"most_{name}"))

    if not n:
        return likely
    both = of(probes, "x").join(of(members, "y"), "gram")
    apart = F.least("least_x", "least_y") != F.greatest("most_x", "most_y")
    return stored(both.where((F.col("x") * F.col("y") > HEAVY_PAIRS) & apart).select("gram"), "heavy")


def class_components(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(class, root) of every class that any link reaches; ``table`` is the class table."""
    filled = table.where("n > 0")
    # frequent n-grams are known to be shared; they need no count and are never dealt by n-gram
    rare = filled.select(F.explode("rare").alias("gram"), "class").repartition("gram").sortWithinPartitions("gram", "class")
    often = filled.select(F.explode(F.arrays_zip("often", "times")).alias("x"), "class").select("x.often", "class", "x.times").distinct()
    shared = stored(rare.mapInArrow(lean(_shared_rows), "gram long, class long, times long").union(often), "shared")
    sizes = filled.groupBy("class").agg(F.min("n").alias("n"), F.min("upto").alias("upto"))
    # a set's probes: what its list lacks of n // 4 + 1 n-grams that no other set lists
    lists = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("grams"), F.avg("times").alias("central"))
    own = stored(lists.join(sizes, "class"), "own")
    listed, quarter, g = _listed(F.col("n")), F.floor(F.col("n") / 4), F.size("grams")
    probing = own.withColumn("open", (g - listed + quarter + 1).cast("int")).where("open > 0")
    probing = probing.select("class", "n", "upto", g.alias("g"), listed.alias("listed"), F.posexplode(F.slice("grams", F.lit(1), F.col("open"))).alias("i", "x"))
    # probe i serves partners that must share g - i listed n-grams at most
    most = F.floor((F.col("g") - F.col("i") - F.col("listed") + F.col("n")) * F.lit((100 + SIMILARITY) / SIMILARITY) + 1e-6) - F.col("n")
    probes = stored(probing.select("class", F.col("x.gram").alias("gram"), F.col("x.times").alias("times"), most.alias("most")), "probes")
    probed = stored(probes.select("gram").distinct(), "probed")
    members = shared.select("gram", "class").join(by_size(probed, probed.count(), BROADCAST_GRAMS), "gram", "left_semi")
    members = stored(members.join(own.select("class", "central"), "class"), "members")
    leaders = members.groupBy("gram").agg(F.max_by("class", F.struct("central", "class")).alias("v"))
    votes = probes.join(leaders, "gram").where("class <> v").groupBy("class", "v").agg(F.count("*").alias("c"))
    star = stored(votes.groupBy("class").agg(F.max_by("v", F.struct("c", "v")).alias("v")).toDF("u", "v"), "star")
    links = linked(docs, table, _possible(star, own))
    # families: sets whose leaders are in one component, with those leaders
    nodes = stored(members.select("class").distinct(), "nodes")
    roots = stored(_roots(nodes, links), "roots")
    led = star.toDF("class", "v").join(roots.toDF("v", "family"), "v").select("class", "family")
    leads = star.select(F.col("v").alias("class")).distinct().withColumn("leads", F.lit(True))
    placed = roots.join(led, "class", "left").join(leads, "class", "left")
    placed = placed.withColumn("family", F.when(F.col("leads"), F.col("root")).otherwise(F.coalesce("family", "root")))
    placed = stored(placed.select("class", "root", "family"), "placed")
    rows = placed.join(own, "class").select("family", "class", "root", "n", "upto", F.transform("grams", lambda x: x["gram"]).alias("grams"))
    links = links.union(_inside(docs, filled, rows))
    # pairs of different families
    families = placed.select("class", "family")
    placed = stored(_roots(nodes, links).join(families, "class").join(own.select("class", "n", "upto"), "class"), "placed")
    heavy = _heavy(probes, members, placed)
    many = heavy.count()
    if many:
        # their sets are one family for each component of sets and heavy n-grams
        met = probes.select("gram", "class").union(members.select("gram", "class")).join(by_size(heavy, many, BROADCAST_GRAMS), "gram", "left_semi").distinct()
        met = stored(met, "heavy-sets")
        stars = met.join(met.groupBy("gram").agg(F.min("class").alias("v")), "gram").where("class <> v").select(F.col("class").alias("u"), "v")
        together = connected_components(stored(stars.distinct(), "heavy-links")).toDF("class", "family")
        rows = together.join(placed.select("class", "root"), "class").join(own, "class").select("family", "class", "root", "n", "upto", F.transform("grams", lambda x: x["gram"]).alias("grams"))
        links = links.union(_inside(docs, filled, rows))
        placed = stored(_roots(nodes, links).join(families, "class").join(own.select("class", "n", "upto"), "class"), "placed")
    light = lambda df: df.join(by_size(heavy, many, BROADCAST_GRAMS), "gram", "left_anti") if many else df
    x = light(probes.select("class", "gram", "most")).join(placed, "class").select("gram", *(F.col(c).alias(f"{c}_x") for c in ("class", "root", "family", "n", "upto")), "most")
    y = light(members.select("class", "gram")).join(placed, "class")
    cross = x.join(y, "gram").where(
        (F.col("root_x") != F.col("root")) & (F.col("family_x") != F.col("family")) & (F.col("upto_x") <= F.col("upto"))
        & (F.col("n") <= F.col("most")) & (100 * F.col("n") >= SIMILARITY * F.col("n_x"))
    )
    pair = F.greatest("class_x", "class").alias("u"), F.least("class_x", "class").alias("v")
    roots = F.greatest("root_x", "root").alias("ru"), F.least("root_x", "root").alias("rv")
    cross = stored(cross.groupBy(*pair, *roots).agg(F.count("*").alias("c")), "cross")
    # of two components first the pair that shares most probes; then what is still apart
    best = cross.groupBy("ru", "rv").agg(F.max_by(F.struct("u", "v"), F.struct("c", "u", "v")).alias("p")).select("p.u", "p.v")
    links = stored(links.union(linked(docs, table, _possible(best, own))), "links")
    # `now` has one row for each class, so this neither adds nor repeats pairs
    now = stored(_roots(nodes, links), "roots")
    apart = cross.select(F.col("u").alias("class_x"), F.col("v").alias("class")).join(now.toDF("class_x", "root_x"), "class_x").join(now, "class").where("root_x <> root")
    apart = apart.select(F.col("class_x").alias("u"), F.col("class").alias("v")).join(best, ["u", "v"], "left_anti")
    more = linked(docs, table, _possible(stored(apart, "apart"), own))
    return connected_components(links.union(more)).toDF("class", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A null or empty text, or one without words, has no shingles and is linked with nothing, not
    even with another such row: its component is its own doc_id. component_id is the smallest
    doc_id of the component, nulls apart (null if it has no other). Repeated rows stay repeated;
    other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    table = class_table(own, frequent_grams(own.select("text")))
    roots = stored(class_components(own, table), "roots")
    roots = by_size(roots, roots.count(), BROADCAST_ROWS)
    placed = table.select("doc_id", "n", "class", "rest").join(roots, "class", "left")
    # the root of a class that no link reaches is the class itself, in full length
    placed = stored(placed.withColumn("r", F.coalesce("root", "class")).withColumn("q", F.when(F.col("root").isNull(), F.col("rest"))), "rooted")
    # a class that stands alone needs no answer from others
    least = placed.where("n > 0").groupBy("r", "q").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    least = stored(least, "least")
    found = by_size(least, least.count(), BROADCAST_ROWS).alias("l")
    joined = placed.alias("p").join(found, (F.col("p.n") > 0) & (F.col("p.r") == F.col("l.r")) & F.col("p.q").eqNullSafe(F.col("l.q")), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
