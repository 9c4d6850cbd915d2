"""Sources that Spark reads by name: folders of documents, and records behind an HTTP interface.

    connectors.register(spark)
    spark.read.format("document_folder").option("prefix", "p_").load("hdfs:///docs")
    spark.read.format("record_lookup").option("url", "http://host/orders/{id}").option("ids", '["A1"]').load()

Calls are made inside tasks, a partition's one after the other; what fails is a row with its
error, never an exception. For the keys of a table there is :func:`look_up`.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import fixed_values as V
from .files import EXTENSIONS, docx_text, pdf_text

#: Bytes of files that one partition of a folder reads, about.
PART_BYTES = 64 << 20


# ---------------------------------------------------------------- records behind HTTP


@dataclass(frozen=True)
class Endpoint:
    """Where records are, and how they are asked for.

    ``url`` has ``{id}`` where the key goes. ``fields`` maps a column to the dotted path of its
    value (with ``[i]`` for an element). ``auth`` is none, bearer, header or query, with the name
    of the header or parameter; a definite refusal (4xx but 408 and 429) is not tried again."""

    url: str
    fields: tuple[tuple[str, str], ...] = ()
    retries: int = 2
    timeout: float = 5.0
    wait: float = 0.5
    longest_wait: float = 8.0
    auth: str = ""
    auth_name: str = "Authorization"
    secret: str = ""

    def request(self, key: str) -> urllib.request.Request:
        url, headers = self.url.replace("{id}", urllib.parse.quote(key, safe="")), {}
        if self.secret and self.auth == "query":
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode({self.auth_name: self.secret})
        elif self.secret and self.auth in ("bearer", "header"):
            headers[self.auth_name] = f"Bearer {self.secret}" if self.auth == "bearer" else self.secret
        return urllib.request.Request(url, headers=headers)

    def call(self, key: str) -> dict:
        """body, outcome (found, not_found, refused or unavailable), status, attempts and error of one key."""
        status, error, attempts = None, "", 0
        for attempts in range(1, self.retries + 2):
            if attempts > 1:
                time.sleep(min(self.wait * 2 ** (attempts - 2), self.longest_wait))
            try:
                with urllib.request.urlopen(self.request(key), timeout=self.timeout) as answer:
                    body = json.loads(answer.read().decode("utf-8"))
                    return {"body": body, "outcome": "found", "status": answer.status, "attempts": attempts, "error": None}
            except urllib.error.HTTPError as e:
                status, error = e.code, f"HTTP {e.code} {e.reason or ''}".strip()
                if 400 <= e.code < 500 and e.code not in V.RETRYABLE_4XX:
                    break
            except Exception as e:  # refused connections, time-outs and answers that are no JSON
                status, error = None, f"{type(e).__name__}: {e}"[:200]
        definite = status is not None and 400 <= status < 500 and status not in V.RETRYABLE_4XX
        outcome = "not_found" if status == 404 else "refused" if definite else "unavailable"
        return {"body": None, "outcome": outcome, "status": status, "attempts": attempts, "error": error}

    def row(self, key: str) -> tuple:
        got = self.call(key)
        values = [value_at(got["body"], path) for _, path in self.fields]
        body = None if got["body"] is None else json.dumps(got["body"], ensure_ascii=False)
        return (key, *(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values), got["outcome"], got["status"], got["attempts"], got["error"], body)

    @property
    def schema(self) -> str:
        return "id string, " + "".join(f"`{name}` string, " for name, _ in self.fields) + "outcome string, status int, attempts int, error string, body string"


def value_at(value, path: str):
    """The value at a dotted path with optional ``[i]`` after a name; None if it isn't there."""
    for part in path.split(".") if path else ():
        name, _, index = part.partition("[")
        value = value.get(name) if isinstance(value, dict) else None
        if index:
            i = index.rstrip("]")
            value = value[int(i)] if isinstance(value, list) and i.isdigit() and int(i) < len(value) else None
    return value if path else None


def look_up(requests: DataFrame, key: str, endpoint: Endpoint, calls_at_once: int = 16) -> DataFrame:
    """``requests`` with the endpoint's fields, outcome (also ``not_asked`` for a null or empty
    key), http_status, attempts and error. Each distinct key is called once, whatever the number
    of its requests, in ``calls_at_once`` partitions."""
    names = [name for name, _ in endpoint.fields]
    keys = requests.select(F.col(key).cast("string").alias("_k")).where(F.coalesce("_k", F.lit("")) != "").distinct()

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([endpoint.row(k)[:-1] for k in pdf["_k"]], columns=["id", *names, "outcome", "status", "attempts", "error"])

    found = keys.repartition(calls_at_once).mapInPandas(call, endpoint.schema.removesuffix(", body string"))
    found = found.withColumnsRenamed({"id": "_k", "status": "http_status"} if "status" not in names else {"id": "_k"})
    joined = requests.withColumn("_own", F.col(key).cast("string")).join(found, F.col("_own") == F.col("_k"), "left").drop("_own", "_k")
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit("not_asked")))


@dataclass
class _Keys(InputPartition):
    keys: list[str]


class _LookupReader(DataSourceReader):
    def __init__(self, endpoint: Endpoint, keys: list[str], parts: int):
        self.endpoint, self.keys, self.parts = endpoint, keys, max(1, parts)

    def partitions(self):
        return [_Keys(self.keys[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.keys))))]

    def read(self, partition):
        for key in partition.keys:
            yield self.endpoint.row(key)


class LookupSource(DataSource):
    """Records of a stated list of keys. Options: url, ids (a JSON array), fields (a JSON object of
    column and path), retries, timeout, wait, auth, authName, secret, numPartitions."""

    @classmethod
    def name(cls) -> str:
        return "record_lookup"

    def _endpoint(self) -> Endpoint:
        o = self.options
        fields = tuple(json.loads(o.get("fields", "{}")).items())
        return Endpoint(
            o["url"], fields, int(o.get("retries", 2)), float(o.get("timeout", 5)), float(o.get("wait", 0.5)),
            auth=o.get("auth", ""), auth_name=o.get("authName", "Authorization"), secret=o.get("secret", ""),
        )

    def schema(self) -> str:
        return self._endpoint().schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LookupReader(self._endpoint(), [str(k) for k in json.loads(self.options.get("ids", "[]"))], int(self.options.get("numPartitions", 8)))


# ---------------------------------------------------------------- folders of documents


@dataclass
class _Files(InputPartition):
    files: list[str]


class _FolderReader(DataSourceReader):
    def __init__(self, uri: str, prefix: str, part_bytes: int):
        self.uri, self.prefix, self.part_bytes = uri if ":" in uri else f"file://{uri}", prefix, part_bytes

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def partitions(self):
        from pyarrow import fs

        store, base = self._open()
        found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.extension.lower() in EXTENSIONS]
        parts, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if size + f.size > self.part_bytes and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [_Files(p) for p in parts]

    def read(self, partition):
        store, base = self._open()
        for path in partition.files:
            relative = path.removeprefix(base).lstrip("/")
            kind = relative.rpartition(".")[2].lower()
            doc_id = self.prefix + relative.rpartition(".")[0].replace("/", "_").replace("\\", "_")
            try:
                with store.open_input_stream(path) as f:
                    content = f.read()
                text = docx_text(content) if kind == "docx" else pdf_text(content) if kind == "pdf" else content.decode("utf-8", "replace")
                yield (doc_id, relative, kind, text, None)
            except Exception as e:  # a bad file is reported in its row
                yield (doc_id, relative, kind, None, f"{type(e).__name__}: {e}"[:200])


class FolderSource(DataSource):
    """Documents of the known kinds under a folder. Options: path, prefix, partBytes."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return "doc_id string, path string, kind string, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FolderReader(self.options["path"], self.options.get("prefix", ""), int(self.options.get("partBytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (LookupSource, FolderSource):
        spark.dataSource.register(source)
