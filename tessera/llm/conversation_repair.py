"""Cheapest repair of conversations by a forward Viterbi pass.

A repaired conversation is empty or reads ``s?(ua)+`` in the initials of its roles. Its turns
are read in order, and for each of four grammar states (nothing yet, system, user, assistant)
the smallest (cost, audit string) is carried. After each turn the layer is closed with inserted
turns, two at most, as a third would come back to a state already reached.

Of two equally cheap audits neither begins the other: they would have the same letters for the
turns, and the longer one would have paid for more inserts. So the smaller of two stays the
smaller whatever follows, and carrying the smallest is exact.

A conversation may be of any length. Turns are dealt by ranges of conversation and turn, each
task reads its turns once and writes, for every ``SEGMENT`` turns of a conversation, what leads
from each state to each other one; segments are then put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_size, lean, small_batches, stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns in one segment: a task holds sixteen audits of this length.
SEGMENT = 4096
#: Repeated (role, text) pairs of conversations that are still broadcast.
BROADCAST_PAIRS = 1_000_000
#: Blanks of ASCII; a text of nothing else is blank.
BLANKS = " \t\n\v\f\r"
#: Letters that end a text properly.
STOPS = ".!?"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: From a state and a role's initial to the next state.
_NEXT = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The role that a state can be left with by a changed or an inserted turn.
_TURN = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_LEGAL = {"su", "ua", "au"}

Layer = list[tuple[int, str] | None]


def _better(layer: Layer, state: int, cost: int, audit: str) -> bool:
    held = layer[state]
    if held is None or (cost, audit) < held:
        layer[state] = (cost, audit)
        return True
    return False


def closed(layer: Layer) -> Layer:
    """``layer`` with inserted turns: at most two in a row lead to a new state."""
    fresh = [s for s in range(4) if layer[s] is not None]
    for _ in range(2):
        reached = []
        for s in fresh:
            cost, audit = layer[s]
            to = _TURN[s][1]
            if _better(layer, to, cost + INSERT, audit + "I"):
                reached.append(to)
        fresh = reached
    return layer


def step(layer: Layer, initial: str, times: int, must_go: bool, truncated: bool) -> Layer:
    """The closed layer after ``times`` equal turns, of which all but the first are repeats."""
    out: Layer = [None] * 4
    extra = TRUNCATED if truncated else 0
    again, lost = "D" * (times - 1), DELETE * (times - 1)
    for s, held in enumerate(layer):
        if held is None:
            continue
        cost, audit = held[0] + lost, held[1]
        _better(out, s, cost + DELETE, audit + "D" + again)
        if not must_go:
            to = _NEXT.get((s, initial))
            if to is not None:
                _better(out, to, cost + extra, audit + "K" + again)
            _better(out, _TURN[s][1], cost + REROLE + extra, audit + "R" + again)
    return closed(out)


def joined(layer: Layer, segment: list[tuple[int, str] | None]) -> Layer:
    """``layer`` after a segment, whose 16 entries lead from each state to each state."""
    out: Layer = [None] * 4
    for s, held in enumerate(layer):
        if held is not None:
            for t in range(4):
                way = segment[4 * s + t]
                if way is not None:
                    _better(out, t, held[0] + way[0], held[1] + way[1])
    return out


# ---------------------------------------------------------------- damage and faults


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``times`` (0 if the turn is dropped) of damaged turns.

    By the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes
    its full stops, exclamation and question marks, 3 repeats it, 4 gives it to the user. Nulls
    count as one space in the key, the role and the text.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


#: Within a conversation; nulls come first.
_ORDER = ("turn", "role", "digest")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of role and text), times, blank, repeated, truncated of the
    distinct turns of each conversation, and one row of ``times`` 0 for each conversation that
    has a dropped turn. No text is moved: equal turns are counted by digest where they are read."""
    there = F.col("times") > 0
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = turns.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, _digest()).alias("digest"),
        F.when(there, tail == "").alias("blank"), F.when(there, ~F.right(tail, F.lit(1)).isin(*STOPS)).alias("open"), "times",
    )
    own = ["conv_id", "turn", "role", "digest"]
    distinct = stored(narrow.groupBy(*own).agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("open").alias("open")), "turns")
    # of a role and text that stand at several turns, the first turn; a pair that stands once needs no join
    spread = distinct.where("times > 0").groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("earliest"), F.count("*").alias("n"))
    spread = stored(spread.where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "earliest"), "repeated")
    found = distinct.join(by_size(spread, spread.count(), BROADCAST_PAIRS), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    late = F.col("c").isNotNull() | F.col("d").isNotNull()
    late = late & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    return found.select(*own, "times", "blank", late.alias("late"), "open")


# ---------------------------------------------------------------- segments

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_ENDS = ("first_turn", "last_turn", "first_initial", "last_initial")
_SEGMENT = (
    "conv_id long, part long, seq long, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", first_turn long, last_turn long, first_initial string, last_initial string, costs array<long>, audits array<string>"
)


class _Segment:
    """Turns of one conversation read so far."""

    def __init__(self):
        self.n = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.size = 0
        self.layers: list[Layer] = []
        for s in range(4):
            layer: Layer = [None] * 4
            layer[s] = (0, "")
            self.layers.append(closed(layer))

    def add(self, turn, role, times, blank, late, ends_open) -> None:
        if not times:
            return
        initial = role[:1]
        must_go = blank or late
        self.size += 1
        if self.last_initial is not None and self.last_initial + initial not in _LEGAL:
            self.n["illegal"] += 1
        self.n["illegal"] += times - 1  # equal neighbours are never legal
        if self.first_initial is None:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None:
            self.n["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.n["blank"] += times if blank else 0
        self.n["duplicate"] += 0 if blank else times if late else times - 1
        self.n["truncated"] += ends_open and not must_go
        self.layers = [step(x, initial, times, must_go, ends_open and not must_go) for x in self.layers]


def _segments(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    conv, held = None, None
    done: list[tuple] = []

    def close():
        nonlocal seq
        ways = [w for layer in held.layers for w in layer]
        done.append((
            conv, part, seq, *held.n.values(), held.first_turn, held.last_turn, held.first_initial, held.last_initial,
            [None if w is None else w[0] for w in ways], [None if w is None else w[1] for w in ways],
        ))
        seq += 1

    def flushed():
        names = ["conv_id", "part", "seq", *_COUNTS, *_ENDS, "costs", "audits"]
        kinds = [pa.int64()] * 10 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string())]
        columns = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for c, *turn in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or c != conv or held.size >= most:
                if held is not None:
                    close()
                conv, held = c, _Segment()
            held.add(*turn)
            if len(done) >= SEGMENT or (done and held.size >= most):
                yield flushed()
    if held is not None:
        close()
    if done:
        yield flushed()


# ---------------------------------------------------------------- repaired texts

_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation: its segments in order, then its turns with their texts in order."""

    def __init__(self, conv):
        self.conv = conv
        self.n = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.layer: Layer = closed([(0, ""), None, None, None])
        self.sha, self.at, self.state, self.lines = hashlib.sha256(), 0, NOTHING, 0
        self.audit = None

    def segment(self, part) -> None:
        for c in _COUNTS:
            self.n[c] += part[c] or 0
        if self.last_initial is not None and part["first_initial"] is not None:
            self.n["illegal"] += self.last_initial + part["first_initial"] not in _LEGAL
        self.n["turns"] -= self.last_turn is not None and part["first_turn"] == self.last_turn
        if part["first_initial"] is not None:
            self.last_initial = part["last_initial"]
        if part["first_turn"] is not None:
            self.first_turn = part["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = part["last_turn"]
        ways = [None if c is None else (c, a) for c, a in zip(part["costs"], part["audits"], strict=True)]
        self.layer = joined(self.layer, ways)

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = min(self.layer[s] for s in (NOTHING, ASSISTANT) if self.layer[s] is not None)

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + role.encode() + b":" + text.encode())
        self.lines += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = _TURN[self.state]
            self._line(role, "")
            self.at += 1

    def turn(self, role, text, times) -> None:
        self.decide()
        self._inserted()
        edit = self.audit[self.at]
        if edit == "K":
            self._line(role, text)
            self.state = _NEXT[self.state, role[:1]]
        elif edit == "R":
            other, self.state = _TURN[self.state]
            self._line(other, text)
        self.at += times

    def row(self) -> tuple:
        self.decide()
        self._inserted()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n["turns"]
        return (self.conv, gaps, *(self.n[c] for c in _COUNTS[:4]), self.cost, self.audit, self.sha.hexdigest())


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, done, size = None, [], 0
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [x.split(" ")[0] for x in _OUT.split(", ")]

    def flushed():
        nonlocal size
        columns = list(zip(*done, strict=True))
        done.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for conv, part, role, text, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or conv != held.conv:
                if held is not None:
                    done.append(held.row())
                    size += len(done[-1][-2])
                held = _Conversation(conv)
            if part is not None:
                held.segment(part)
            else:
                held.turn(role, text, times)
            if len(done) >= SEGMENT or size >= 1 << 20:
                yield flushed()
    if held is not None:
        done.append(held.row())
    if done:
        yield flushed()


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of
    every conversation in ``turns`` (conv_id, turn, role, text; ``times`` if turns are counted,
    0 for a conversation that has lost its turns).

    Turns are taken in order of turn (nulls first), ties by role, then by digest of the text. A turn is blank
    without a word, else a duplicate if its role and text stood earlier in the conversation,
    else truncated if its last letter isn't ``.``, ``!`` or ``?``. The audit has a letter for
    each edit in order: K keeps a turn, R gives it to the user or the assistant, D deletes it
    (which blank and duplicate turns need), I inserts an empty turn. Null conv_ids are one
    conversation; null roles and texts count as one space; other columns are ignored; an empty
    table gives no rows. ``gaps`` counts the numbers missing between the first and last turn.

    The digest of a conversation is one sequence of bytes, so its kept texts pass through one
    task, which streams them and holds the audit and one batch.
    """
    small_batches(turns.sparkSession)
    blank = F.lit(" ")
    times = F.col("times") if "times" in turns.columns else F.lit(1)
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), times.cast("long").alias("times"),
    )
    judged = faults(own)
    ranged = judged.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    segments = stored(ranged.select("conv_id", "turn", "role", "times", "blank", "late", "open").mapInArrow(lean(lambda batches: _segments(batches, segment)), _SEGMENT), "segments")
    part = F.struct(*_COUNTS, *_ENDS, "costs", "audits")
    words = own.where("times > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    nothing = F.lit(None)
    both = segments.select("conv_id", F.lit(0).alias("kind"), "part", "seq", nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), nothing.cast("string").alias("digest"), nothing.cast("long").alias("times"), part.alias("segment")).unionByName(
        words.select("conv_id", F.lit(1).alias("kind"), nothing.cast("long").alias("part"), nothing.cast("long").alias("seq"), "turn", "role", "text", _digest().alias("digest"), "times", nothing.cast(segments.select(part.alias("s")).schema["s"].dataType).alias("segment"))
    )
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq", *_ORDER)
    return dealt.select("conv_id", "segment", "role", "text", "times").mapInArrow(lean(_repaired), _OUT)
