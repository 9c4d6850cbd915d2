"""Exact per-key state machines over event streams: rate limiter and circuit breaker.

Both exist as a pure function over one key's ordered events, as a batch operator, and as a
stateful stream that keeps a few numbers for each key and its events that are not in order yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LIMIT_SCHEMA = "client string, ts double, place long, n long, admitted boolean"
BREAKER_SCHEMA = "backend string, ts double, place long, called boolean, state string"


def limit_step(state: tuple[float, int] | None, ts: float, limit: int, seconds: float) -> tuple[tuple[float, int], bool]:
    """(window start, count) after a request, and whether it is admitted. A window starts at a
    client's first request; requests over the limit count on; a limit of 0 admits all."""
    start, n = state if state and ts - state[0] < seconds else (ts, 0)
    return (start, n + 1), limit <= 0 or n + 1 <= limit


def breaker_step(state: tuple[int, float] | None, ts: float, ok: bool, threshold: int, cooldown: float) -> tuple[tuple[int, float], bool, str]:
    """(failures in a row, time of opening or -1) after an event, whether the call was made, and
    the state after it: closed, open or half_open. While open nothing is called; after the
    cool-down one trial is made, whose failure restarts it."""
    failures, opened = state or (0, -1.0)
    if opened >= 0 and ts - opened < cooldown:
        return (failures, opened), False, "open"
    if ok:
        return (0, -1.0), True, "closed"
    failures += 1
    if opened >= 0 or failures >= threshold:
        return (failures, ts), True, "open"
    return (failures, -1.0), True, "closed"


def _limiter(limit: int, seconds: float):
    def run(state, rows):
        out = []
        for ts, place in rows:
            state, ok = limit_step(state, ts, limit, seconds)
            out.append((ts, place, state[1], ok))
        return state, out

    return run


def _breaker(threshold: int, cooldown: float):
    def run(state, rows):
        out = []
        for ts, place, ok in rows:
            state, called, after = breaker_step(state, ts, ok, threshold, cooldown)
            out.append((ts, place, called, after))
        return state, out

    return run


def _in_order(events: DataFrame, key: str, schema: str, columns: list[str], step) -> DataFrame:
    """Events sorted inside partitions of the key and streamed through the step: a key of any
    size needs no more memory than a batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: Any = None
        state = None
        for pdf in batches:
            out = []
            for k, *row in pdf[[key, *columns]].itertuples(index=False, name=None):
                if k != at:
                    at, state = k, None
                state, made = step(state, [tuple(row)])
                out += [(k, *m) for m in made]
            yield pd.DataFrame(out, columns=names)

    dealt = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "ts", "place")
    return dealt.mapInPandas(rows, schema)


def limit_requests(events: DataFrame, limit: int, seconds: float = 60) -> DataFrame:
    """client, ts, place, n, admitted of every request (client, ts in seconds, place)."""
    return _in_order(events, "client", LIMIT_SCHEMA, ["ts", "place"], _limiter(limit, seconds))


def breaker_states(events: DataFrame, threshold: int = 5, cooldown: float = 30) -> DataFrame:
    """backend, ts, place, called, state of every event (backend, ts, place, ok)."""
    return _in_order(events, "backend", BREAKER_SCHEMA, ["ts", "place", "ok"], _breaker(threshold, cooldown))


class InOrder(StatefulProcessor):
    """Events of one key through a step, in the order of their times.

    Events wait until the watermark has passed them, so those of a later batch may come before
    those of an earlier one; a timer at the first waiting event wakes the key. When nothing waits
    and the key was silent for ``idle`` seconds, its state is dropped if ``forgets`` says that it
    makes no difference any more.
    """

    def __init__(self, step, columns: list[str], names: list[str], waiting: str, state: str, idle: float, forgets):
        self._step, self._columns, self._names = step, columns, names
        self._waiting_schema, self._state_schema, self._idle, self._forgets = waiting, state, idle, forgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._waiting_schema)
        self._state = handle.getValueState("state", self._state_schema)

    @staticmethod
    def _ms(ts: float) -> int:
        return int(ts * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(r) for pdf in rows for r in pdf[self._columns].itertuples(index=False, name=None)]
        if fresh:
            self._waiting.appendList(fresh)
            self._handle.registerTimer(self._ms(min(r[0] for r in fresh)))
        yield pd.DataFrame(columns=self._names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self._waiting.get())
        due = [r for r in rows if self._ms(r[0]) <= now]
        rest = rows[len(due) :]
        out = []
        if due:
            before = self._state.get() if self._state.exists() else None
            after, out = self._step(tuple(before) if before is not None else None, due)
            self._state.update(after)
            self._waiting.clear()
            if rest:
                self._waiting.put(rest)
            else:
                self._handle.registerTimer(self._ms(due[-1][0] + self._idle) + 1)
        elif not rest and self._state.exists() and self._forgets(tuple(self._state.get()), now / 1000):
            self._state.clear()
        if rest:
            self._handle.registerTimer(self._ms(rest[0][0]))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=self._names)

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, schema: str, columns: list[str], waiting: str, state: str, step, idle: float, forgets, late: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    timed = stream.where(F.col(key).isNotNull()).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(key).transformWithStateInPandas(InOrder(step, columns, names, waiting, state, idle, forgets), schema, "append", "EventTime")


def limit_stream(stream: DataFrame, limit: int, seconds: float = 60, late: str = "10 minutes") -> DataFrame:
    """The limiter over a stream (client, ts in seconds, place): requests come out when the
    watermark, ``late`` behind the latest, has passed them; later ones are dropped. State is a
    window's start and count for each client, and goes when the window is over."""
    over = lambda state, now: now - state[0] >= seconds
    return _stateful(stream, "client", LIMIT_SCHEMA, ["ts", "place"], "ts double, place long", "start double, n long", _limiter(limit, seconds), seconds, over, late)


def breaker_stream(stream: DataFrame, threshold: int = 5, cooldown: float = 30, late: str = "10 minutes") -> DataFrame:
    """The breaker over a stream (backend, ts, place, ok), in order as :func:`limit_stream`. The
    state of a backend without failures goes after the cool-down."""
    well = lambda state, now: tuple(state) == (0, -1.0)
    return _stateful(stream, "backend", BREAKER_SCHEMA, ["ts", "place", "ok"], "ts double, place long, ok boolean", "failures long, opened double", _breaker(threshold, cooldown), cooldown, well, late)


def windowed_counts(stream: DataFrame, ts: str, key: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling windows, with a watermark for late ones."""
    w = F.window(ts, f"{seconds} seconds")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "key", "n")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def to_files(stream: DataFrame, path: str, format: str = "parquet", **trigger) -> StreamingQuery:
    """Append a stream to files at ``path``; its checkpoint lies beside them, so a query that is
    started again goes on where it stopped and writes nothing twice. Without a ``trigger`` it
    takes what is there and ends. States with timers need the RocksDB store, which is set for
    queries started here."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        sink = stream.writeStream.format(format).outputMode("append").option("path", path).option("checkpointLocation", f"{path.rstrip('/')}-checkpoint")
        return sink.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives for the input that is there now, read back from the files at ``path``."""
    to_files(stream, path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def retry(outcomes: list[tuple[bool, int | None]], retries: int = 2, base: float = 0.5, cap: float = 8.0) -> tuple[bool, int, float]:
    """(succeeded, attempts, seconds waited) of a call whose attempts end as ``outcomes`` (ok,
    HTTP status): definite 4xx answers are not tried again, and waits double up to the cap."""
    waited = 0.0
    for i, (ok, status) in enumerate(outcomes[: retries + 1], 1):
        if ok:
            return True, i, waited
        if status is not None and 400 <= status < 500 and status not in (408, 429):
            return False, i, waited
        if i <= retries and i < len(outcomes):
            waited += min(base * 2 ** (i - 1), cap)
    return False, min(len(outcomes), retries + 1), waited
