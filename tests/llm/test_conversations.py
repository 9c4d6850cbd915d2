"""Conversation repair against a search over all repairs, on odd rows and on whole tables."""

from __future__ import annotations

import functools
import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessera.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, part string, kind string, c string, d string, times_ string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """Rows after damage, one by one."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def searched(turns):
    """(cost, audit, repaired lines) by Dijkstra over (turn, last role) with whole paths in the queue."""
    goal_states = {"", "a"}
    seen_pairs, faults = set(), []
    for _, role, text in turns:
        solid = SOLID.findall(text)
        if not solid:
            faults.append("blank")
        elif (role, text) in seen_pairs:
            faults.append("duplicate")
        else:
            faults.append("truncated" if solid[-1] not in ".!?" else "")
        seen_pairs.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(turns) and state in goal_states:
            return cost, audit, lines, faults
        # of one place, only the cheapest cost is kept, with every audit of that cost
        if (i, state, cost, audit) in done:
            continue
        done.add((i, state, cost, audit))
        for role in ("user", "assistant"):
            to = after.get((state, role[0]))
            if to is not None and audit[-3:] != "III":
                heapq.heappush(queue, (cost + 3, audit + "I", i, to, (*lines, f"{role}:")))
        if i == len(turns):
            continue
        _, own, text = turns[i]
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, lines))
        if faults[i] not in ("blank", "duplicate"):
            more = 3 if faults[i] == "truncated" else 0
            to = after.get((state, own[:1]))
            if to is not None:
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, to, (*lines, f"{own}:{text}")))
            for role in ("user", "assistant"):
                to = after.get((state, role[0]))
                if to is not None:
                    heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, to, (*lines, f"{role}:{text}")))
    raise AssertionError


def by_dp(turns):
    """As :func:`searched`, by a table over whole prefixes (for long conversations)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    seen, faults = set(), []
    layer = {"": (0, "", ())}

    def close(layer):
        for _ in range(4):
            for state in list(layer):
                cost, audit, lines = layer[state]
                for role in ("user", "assistant"):
                    to = after.get((state, role[0]))
                    new = (cost + 3, audit + "I", (*lines, f"{role}:"))
                    if to is not None and (to not in layer or new[:2] < layer[to][:2]):
                        layer[to] = new
        return layer

    layer = close(layer)
    for _, own, text in turns:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (own, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((own, text))
        faults.append(fault)
        out = {}
        for state, (cost, audit, lines) in layer.items():
            ways = [(state, cost + 4, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                ways += [(after.get((state, own[:1])), cost + more, "K", (*lines, f"{own}:{text}"))]
                ways += [(after.get((state, r[0])), cost + more + 3, "R", (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            for to, c, letter, new in ways:
                if to is not None and (to not in out or (c, audit + letter) < out[to][:2]):
                    out[to] = (c, audit + letter, new)
        layer = close(out)
    return (*min(layer[s] for s in ("", "a") if s in layer), faults)


def expected(rows, solve):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for conv, turn, role, text in damaged(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(t[1], t[2])))
        cost, audit, lines, faults = solve(turns)
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows(seed=3, convs=60, longest=7):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "Why?", "open end", " \t\n", "", None, "é è ü.\v", "Stop. \r\n", "a ", "　"]
    rows = []
    for conv in [None, *range(convs)]:
        for k in range(rng.randint(1, longest)):
            turn = rng.choice([k, k, k, k, 2 * k, None, -k])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randint(0, 9)}."))
    rows += rows[5:9] + [rows[0]] * 5
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", "v") for r in rows], SCHEMA).repartition(parts)


def test_step_and_search_agree_on_short_conversations():
    rng = random.Random(5)
    for _ in range(300):
        turns = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c!", "d?"])) for k in range(rng.randint(0, 5))]
        assert searched(turns) == by_dp(turns)


def test_repair_of_odd_rows(spark):
    rows = odd_rows()
    assert got(cr.repair(cr.damage(frame(spark, rows)))) == expected(rows, searched)


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_long_conversations_over_segments_and_tasks(spark, segment):
    rng = random.Random(segment)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"T{rng.randint(0, 400)}{rng.choice('.!?x')}") for k in range(600)]
    rows += [(7, 50, "user", "Again and again.")] * 300 + [(8, None, "user", f"{k % 40}.") for k in range(90)] + odd_rows(9, 10)
    assert got(cr.repair(cr.damage(frame(spark, rows, 9)), segment)) == expected(rows, by_dp)


def test_conversations_that_lose_all_turns_and_empty_tables(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    row = cr.repair(cr.damage(frame(spark, [(lost, 1, "user", "Gone.")]))).collect()
    assert list(map(tuple, row)) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair(cr.damage(frame(spark, []))).collect() == []


def test_the_sql_repairs_odd_rows_too():
    import duckdb

    from tessera.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = odd_rows(11)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(ORACLE_SQL["op11_conversation_repair"]).fetchall(), key=repr) == expected(rows, searched)


@functools.cache
def folder():
    from pathlib import Path

    return "/root/testdata/sf0.001" if Path("/root/testdata/sf0.001").exists() else None


@pytest.mark.skipif(folder() is None, reason="the driver's tables aren't here")
def test_query_over_the_whole_table(spark):
    from tessera.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{folder()}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_conversation_repair"](spark, folder())) == expected(rows, by_dp)
