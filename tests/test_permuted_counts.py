"""Contexts dealt anew by packed rows, against the rows themselves and plain Python."""

import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from seqweave.operators import signif


def rows(n=300):
    rnd = random.Random(3)
    made = [(i, None if i % 90 == 7 else f"c{rnd.randrange(4)}", [rnd.choice([*"abcdef", None]) for _ in range(rnd.randrange(0, 6))]) for i in range(n)]
    return [(i, c, list(dict.fromkeys(s))) for i, c, s in made]


@pytest.mark.parametrize(("ranks", "under_way"), [(1 << 16, 1 << 26), (16, 700)])  # all at once; small blocks, two replicates at a time
def test_permuted_counts(spark, monkeypatch, ranks, under_way):
    monkeypatch.setattr(signif, "RANKS", ranks)
    monkeypatch.setattr(signif, "UNDER_WAY", under_way)
    want = Counter()
    for rep in range(1, 6):
        order = lambda side: sorted(rows(), key=lambda x: md5(f"q|{side}|{rep}|{x[0]}".encode()).hexdigest())  # noqa: B023, E731
        want.update((rep, v, b[1]) for a, b in zip(order("a"), order("b"), strict=True) for v in a[2])
    s = spark.createDataFrame(rows(), "seq_id long, ctx string, symbols array<string>").repartition(3)
    got = {(x.rep, x.sym, x.ctx): x.cnt for x in signif.permuted_counts(s, "q", 5).collect()}
    assert got == want
    each = signif.permuted(s, "q", 5).select("rep", F.explode("symbols").alias("sym"), "ctx").groupBy("rep", "sym", "ctx").count().collect()
    assert {(x.rep, x.sym, x.ctx): x["count"] for x in each} == want


def test_other_types_and_equal_bits(spark):
    whole = spark.createDataFrame([(i, i % 3, [i % 2, 5]) for i in range(40)], "seq_id long, ctx int, symbols array<int>")
    got = signif.permuted_counts(whole, "q", 2)
    assert dict(got.dtypes) == {"rep": "int", "sym": "int", "ctx": "int", "cnt": "bigint"}
    assert Counter({(x.rep, x.ctx): x.cnt for x in got.where("sym = 5").collect()}) == Counter({(r, c): 14 - (c > 0) for r in (1, 2) for c in range(3)})
    same = spark.createDataFrame([("|1", ["a"], ["x"])] * 2, "tail string, a array<string>, b array<string>")
    assert all(x.ties for x in signif._packed_cells(same, "q", range(1, 2), 8).collect())
    assert signif.permuted_counts(whole.limit(0), "q", 2).collect() == []


def test_sequences_are_not_shuffled_for_each_replicate(spark):
    s = spark.createDataFrame(rows(), "seq_id long, ctx string, symbols array<string>")
    plan = signif.context_association(s, "ctx", "q", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and signif.permuted_counts(s, "q", 5)._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 0
    x = s.select(F.lit("").alias("tail"), F.col("symbols").alias("a"), F.array("ctx").alias("b"))
    assert signif._packed_cells(x, "q", range(1, 3), 8).count() == 4  # a row for each replicate, side and cell
