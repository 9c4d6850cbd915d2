"""Versioned tables: each change writes a new version, then a pointer names it.

A reader sees the version that the pointer names, so a failed write changes nothing; the
pointer is a table of versions that is only appended to, and the highest version counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A table at ``path`` (any URI that Spark writes to) with ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _current(self) -> tuple[int, str | None]:
        log = f"{self.path}/_versions"
        if not self._exists(log):
            return 0, None
        top = self.spark.read.schema("version long, folder string").json(log).orderBy(F.desc("version"), F.desc("folder")).first()
        return (top.version, top.folder) if top else (0, None)

    def read(self) -> DataFrame:
        folder = self._current()[1]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        """Make ``df`` the next version."""
        version = self._current()[0] + 1
        folder = f"v{version:09d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(version, folder)], "version long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/_versions")

    def append(self, df: DataFrame) -> None:
        """Add rows to the present version (the first is made by it)."""
        folder = self._current()[1]
        if folder is None:
            self.replace(df)
        else:
            df.write.mode("append").parquet(f"{self.path}/{folder}")

    def delete(self, condition) -> int:
        """Rows that meet ``condition`` go; how many went."""
        now = self.read()
        gone = now.where(condition).count()
        if gone:
            self.replace(now.where(~F.coalesce(condition, F.lit(False))))
        return gone

    def count(self) -> int:
        return self.read().count()
