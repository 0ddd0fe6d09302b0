"""Every query with SQL equals DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from quillmatch.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def shown(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    own = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(own) or name == "shards_to_compact"
        return
    other = duck.execute(ORACLES[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert shown(own) == shown(other)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["query_id", "doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
