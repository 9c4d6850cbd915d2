"""The chunkers against their SQL on odd texts."""

import pytest

from tessera.operators.chunking import chunk
from tessera.queries import SQL

ODD = [
    "# 标题\nQ：多久？\nA：两天\n时效：P0 15 分钟，P1 1 小时；P2 无\n- 项目\n## 二\nQ: a\nQ: b\n\nA: c\nA: d\nplain\nQ: last", "", "  \n ", "# only\n## heads",
    "---\n* \n-", "键值：1 天，2 天，3", " x y\x85z ", "#\n####### seven", "长" * 700 + "。" + "长" * 200, "# h\n" + "字；" * 400, None,
]


@pytest.mark.parametrize(("name", "strategy"), [("chunk_structured", "fine"), ("chunk_plain", "plain")])
def test_chunks_are_those_of_the_sql(spark, name, strategy):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(ODD)))
    got = chunk(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), strategy=strategy)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(SQL[name]).fetchall())
