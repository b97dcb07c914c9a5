"""The registered queries against their SQL, and the rule that each operator has one."""

from collections import Counter

import duckdb
import pytest

from evidentia.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(map(str, df.select(*columns).collect()))
    assert rows
    if name in oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        found = con.sql(oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        plain = lambda v: round(v, 5) if isinstance(v, float) else v
        want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
        assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want
