"""Branches of a plan as stages: each is written by itself, counted and timed while it is
written, and a failure stays its own."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..sources.scratch import kept, new_folder

ROWS = "stage string, role string, ok boolean, rows long, errors long, ms long, summary string"


@dataclass
class Branch:
    """``make`` builds the branch, whose rows have ``schema``; rows that meet ``errors`` count as failed ones."""

    name: str
    make: Callable[[], DataFrame]
    schema: str
    role: str = ""
    errors: Column | None = None


class Stages:
    """Runs branches and keeps a row of each run. A branch that fails, when it is built or when it
    is written, gives an empty table, so what joins it goes on without its rows."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "stages")
        self._rows: list[tuple] = []

    def run(self, branch: Branch) -> DataFrame:
        """The rows of a branch, read from the files that it was written to."""
        began = time.perf_counter()
        rows = errors = 0
        try:
            failed = F.lit(0) if branch.errors is None else F.coalesce(branch.errors.cast("int"), F.lit(0))
            seen = Observation()
            marked = branch.make().withColumn("_failed", failed).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum("_failed").alias("errors"))
            typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(branch.schema)]
            out = kept(marked.select(*typed), f"{self.folder}/{uuid.uuid4().hex}")
            rows, errors = seen.get["rows"], seen.get["errors"] or 0
            ok, summary = True, f"{rows} rows"
        except Exception as e:  # whatever a branch raises is its own failure
            lines = str(e).strip().splitlines() or [""]
            ok, summary = False, f"{type(e).__name__}: {lines[0]}"[:300]
            out = self.spark.createDataFrame([], branch.schema)
        ms = max(1, round((time.perf_counter() - began) * 1000))
        self._rows.append((branch.name, branch.role, ok, rows, errors, ms, summary))
        return out

    def run_all(self, branches: list[Branch]) -> dict[str, DataFrame]:
        """Branches that don't depend on each other, at the same time."""
        if not branches:
            return {}
        with ThreadPoolExecutor(max_workers=len(branches)) as pool:
            done = [pool.submit(inheritable_thread_target(self.spark)(self.run), b) for b in branches]
            return {b.name: d.result() for b, d in zip(branches, done, strict=True)}

    def table(self) -> DataFrame:
        """stage, role, ok, rows, errors, ms, summary of every run so far."""
        return self.spark.createDataFrame(self._rows, ROWS)

    def runs(self) -> int:
        return len(self._rows)

    def failures(self, since: int = 0) -> list[tuple[str, str]]:
        """(stage, summary) of the runs that failed, without the first ``since`` runs."""
        return [(r[0], r[6]) for r in self._rows[since:] if not r[2]]

    def failed(self) -> list[str]:
        return [stage for stage, _ in self.failures()]
