"""Queries of this subpackage that have SQL, against DuckDB."""

import duckdb
import pytest

import __spark_entry__
from seqweave.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cur.fetchall()))
