"""A property graph in one partitioned table, in which a batch rewrites the buckets that it touches.

Nodes, edges and the documents that state an edge are rows of three kinds in one table,
partitioned by kind and a hash bucket. A batch is merged with the old rows of its buckets and
written with dynamic partition overwrite: one write, so one commit for all three kinds. There are
as many buckets as keep each at about ``ROWS`` rows, so what a batch writes depends on the batch,
not on the graph; when buckets have outgrown that, the table is dealt anew into more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ranking import by_rows
from .scratch import stored

ROWS = 50_000
BUCKETS = 2
#: Buckets are multiplied by this when they hold this many times ``ROWS`` on average.
GROWTH = 4
COLUMNS = "key string, type string, name string, docs array<string>, props map<string,string>, src string, rel string, dst string, doc_id string, seq long, kind string, bucket int"
_EDGE = ("src", "rel", "dst")
_BY = {"node": ("key",), "edge": _EDGE, "link": (*_EDGE, "doc_id")}


class View:
    """A kind of rows as a table that is read."""

    def __init__(self, read):
        self.read = read

    def count(self) -> int:
        return self.read().count()


class GraphStore:
    """The graph at ``path``, a folder that all executors reach; ``rows`` is the size of a bucket."""

    def __init__(self, spark: SparkSession, path: str, rows: int = ROWS):
        self.spark, self.path, self.rows = spark, path.rstrip("/"), rows

    # ------------------------------------------------------------ reading

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _buckets(self) -> int:
        """The number of buckets of the present table: the largest that was written whole; 0 for none."""
        store, path = self._files()
        found = store.globStatus(path(f"{self.path}/whole-*"))
        return max((int(s.getPath().getName().removeprefix("whole-")) for s in found or ()), default=0)

    def _all(self, n: int | None = None) -> DataFrame:
        n = self._buckets() if n is None else n
        if not n:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(f"{self.path}/buckets-{n}")

    def _kind(self, kind: str, n: int | None = None) -> DataFrame:
        # a bucket that lost all its rows keeps one without a key
        return self._all(n).where((F.col("kind") == kind) & F.col("seq").isNotNull())

    def nodes(self) -> DataFrame:
        return self._kind("node").select("key", "type", "name", "docs", "seq", "props")

    def edges(self) -> DataFrame:
        """src, rel, dst, seq."""
        return self._kind("edge").select(*_EDGE, "seq")

    def links(self) -> DataFrame:
        """src, rel, dst, doc_id, seq: each document that states an edge."""
        return self._kind("link").select(*_EDGE, "doc_id", "seq")

    def edges_with_docs(self) -> DataFrame:
        """Edges with an array of their documents, in order of arrival."""
        docs = self.links().groupBy(*_EDGE).agg(F.array_sort(F.collect_list(F.struct("seq", "doc_id"))).alias("d"))
        none = F.array().cast("array<string>")
        return self.edges().join(docs, list(_EDGE), "left").select(*_EDGE, F.coalesce(F.transform("d", lambda x: x["doc_id"]), none).alias("docs"), "seq")

    def last_seq(self) -> int | None:
        return self.nodes().agg(F.max("seq").alias("s")).first().s

    # ------------------------------------------------------------ writing

    @staticmethod
    def _bucket(kind: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(c, F.lit("")) for c in _BY[kind])), F.lit(n)).cast("int").alias("bucket")

    def _rows(self, kind: str, df: DataFrame, n: int) -> DataFrame:
        names = [c.split(" ", 1) for c in COLUMNS.split(", ")]
        there = df.withColumn("kind", F.lit(kind)).withColumn("bucket", self._bucket(kind, n))
        return there.select(*((F.col(c) if c in there.columns else F.lit(None)).cast(t).alias(c) for c, t in names))

    def _write(self, rows: DataFrame, n: int) -> None:
        dealt = rows.repartition("kind", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dealt.partitionBy("kind", "bucket").parquet(f"{self.path}/buckets-{n}")
        store, path = self._files()
        store.create(path(f"{self.path}/whole-{n}"), True).close()

    def _touched(self, rows: DataFrame, n: int) -> tuple[Column, list[tuple[str, int]]]:
        """Which partitions hold the keys of ``rows``, as a filter and a list (of partitions, not of rows)."""
        places = sorted((r.kind, r.bucket) for r in rows.select("kind", "bucket").distinct().collect())
        of = {k: [b for kind, b in places if kind == k] for k in _BY}
        return F.coalesce(*(F.when(F.col("kind") == k, F.col("bucket").isin(of[k])) for k in of if of[k]), F.lit(False)), places

    def upsert(self, nodes: DataFrame, edges: DataFrame, links: DataFrame) -> int:
        """Merge nodes (one row for each key), edges (src, rel, dst, seq) and links (src, rel, dst,
        doc_id, seq) in one commit; returns how many rows were written."""
        n = self._buckets() or BUCKETS
        new = self._rows("node", nodes, n).unionByName(self._rows("edge", edges, n)).unionByName(self._rows("link", links.where("doc_id IS NOT NULL"), n))
        new = stored(new, "batch")
        where, places = self._touched(new, n)
        if not places:
            return 0
        old = self._all().where(where & F.col("seq").isNotNull())
        pick = lambda df, kind: df.where(F.col("kind") == kind)
        cols = ("key", "type", "name", "docs", "seq", "props")
        merged = self._rows("node", graph.merge_nodes(pick(old, "node").select(*cols), pick(new, "node").select(*cols)), n)
        for kind in ("edge", "link"):
            both = pick(old, kind).unionByName(pick(new, kind)).groupBy(*_BY[kind]).agg(F.min("seq").alias("seq"))
            merged = merged.unionByName(self._rows(kind, both, n))
        merged = stored(merged, "merged")
        self._write(merged, n)
        written = merged.count()
        if written > GROWTH * self.rows * len(places):
            self.deal(n * GROWTH ** max(1, round(_log(written / len(places) / self.rows))))
        return written

    def upsert_triples(self, triples: DataFrame) -> int:
        """Merge valid triples (subject_type, subject, rel, object_type, object, doc_id, seq, props)."""
        src, dst = graph.node_key(F.col("subject_type"), F.col("subject")), graph.node_key(F.col("object_type"), F.col("object"))
        links = triples.select(src.alias("src"), "rel", dst.alias("dst"), "doc_id", "seq")
        return self.upsert(graph.nodes_of(triples), links.groupBy(*_EDGE).agg(F.min("seq").alias("seq")), links)

    def deal(self, n: int) -> None:
        """Write the whole table anew with ``n`` buckets."""
        whole = self._rows("node", self._kind("node").drop("kind", "bucket"), n)
        for kind in ("edge", "link"):
            whole = whole.unionByName(self._rows(kind, self._kind(kind).drop("kind", "bucket"), n))
        self._write(whole, n)

    def known(self, edges: DataFrame) -> DataFrame:
        """Those of ``edges`` (src, rel, dst) that the graph has; their buckets only are read."""
        n = self._buckets()
        if not n:
            return edges.limit(0)
        where, _ = self._touched(self._rows("edge", edges, n), n)
        return edges.join(self._all(n).where(where & (F.col("kind") == "edge") & F.col("seq").isNotNull()).select(*_EDGE), list(_EDGE), "left_semi")

    def delete_documents(self, doc_ids: DataFrame) -> int:
        """Take out what only the documents ``doc_ids`` (doc_id) state: their links, edges that have
        no other, and Document nodes. Edges that no document states and other nodes stay.
        Returns how many edges went. Only the buckets of these rows are written."""
        n = self._buckets()
        if not n:
            return 0
        docs = by_rows(stored(doc_ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "gone"))
        links = stored(self.links().join(docs, "doc_id", "left_semi"), "links")
        stated = links.select(*_EDGE).distinct()
        left = self.links().join(by_rows(stated), list(_EDGE), "left_semi").join(docs, "doc_id", "left_anti").select(*_EDGE).distinct()
        edges = stored(stated.join(left, list(_EDGE), "left_anti"), "edges")
        nodes = docs.select(graph.node_key(F.lit("Document"), F.col("doc_id")).alias("key"))
        gone = stored(self._rows("node", nodes, n).unionByName(self._rows("edge", edges, n)).unionByName(self._rows("link", links.drop("seq"), n)), "gone")
        where, places = self._touched(gone, n)
        if not places:
            return 0
        old = self._all(n).where(where & F.col("seq").isNotNull())
        keys = ("kind", "key", *_EDGE, "doc_id")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in keys]
        kept = old.alias("o").join(gone.alias("g"), same, "left_anti")
        empty = self.spark.createDataFrame(places, "kind string, bucket int")
        names = [c.split(" ", 1) for c in COLUMNS.split(", ")]
        empty = empty.select(*((F.col(c) if c in ("kind", "bucket") else F.lit(None)).cast(t).alias(c) for c, t in names))
        self._write(stored(kept.unionByName(empty), "kept"), n)
        return edges.count()

    def clear(self) -> None:
        n = self._buckets()
        if n:
            empty = self.spark.createDataFrame([(k, b) for k in _BY for b in range(n)], "kind string, bucket int")
            names = [c.split(" ", 1) for c in COLUMNS.split(", ")]
            self._write(empty.select(*((F.col(c) if c in ("kind", "bucket") else F.lit(None)).cast(t).alias(c) for c, t in names)), n)


def _log(x: float) -> float:
    from math import log

    return log(x, GROWTH)
