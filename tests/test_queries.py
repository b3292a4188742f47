"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quarrygraph.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.astype(object).to_dict("records"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    assert len(got.columns)
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert rows(got) == rows(con.sql(sql).df())
