"""Every engine query against its SQL on the smallest tables."""

import os

import pytest

from tessera.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [c[0] for c in result.description]
        rows = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
        assert sorted(columns) == sorted(df.columns)
        assert got == sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)


def test_answers_move_only_the_orders_asked_for(spark):
    plan = QUERIES["answer_template"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert any("LeftSemi" in line and "o_orderkey" in line for line in plan.splitlines())


def test_entry_imports_without_the_llm_folders():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "tessera.llm" or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
