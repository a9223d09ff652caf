"""The numbered operators' queries against their SQL, on a whole table."""

import duckdb
import pytest

from locusframe.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, rel = QUERIES[name](spark, D), duck.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    mine = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    assert mine == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
