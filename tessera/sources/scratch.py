"""Tables between the steps of a plan, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session on one machine may leave that unset and
    gets a folder of its own; any other must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written at ``path`` and read again: what follows neither repeats it nor depends on
    an executor that was lost since."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """:func:`kept` in a new folder."""
    return kept(df, new_folder(df.sparkSession, tag))
