"""Every query with SQL against DuckDB on the small tables; those without run."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = set(__spark_entry__._llm.queries()) if __spark_entry__._llm else set()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - LLM))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    if name in __spark_entry__.oracle_sql():
        cur = duck.execute(__spark_entry__.oracle_sql()[name])
        columns = [d[0] for d in cur.description]
        want = rows_of(columns, cur.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        for g, w in zip(got[1], want[1], strict=True):
            assert len(g) == len(w)
            for x, y in zip(g, w, strict=True):
                assert x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)), (g, w)
