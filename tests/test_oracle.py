"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import math
from collections import Counter

import duckdb
import pytest

from evidentia.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    assert rows
    if name in oracle_sql():
        found = duck.sql(oracle_sql()[name])
        assert sorted(found.columns) == columns
        want = Counter(tuple(map(_plain, r)) for r in found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
        assert rows == want


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(oracle_sql()) <= set(queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["case_id", "status", "confidence", "reject_reason", "mail_found", "shown_as"] and df.count() > 0
