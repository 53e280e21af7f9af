"""Tokens dealt anew from counts alone, without a shuffle of tokens."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqweave.operators import resampling as r


@pytest.mark.parametrize("size", [1 << 20, 7])  # one cell, or sequences that go on in the next one
def test_dealt_bigrams_are_those_of_an_even_permutation(spark, monkeypatch, size):
    monkeypatch.setattr(r, "DEALT", size)
    lens = {"x": {1: 5, 2: 3, 4: 6, 30: 1}, None: {3: 2}, "z": {1: 4}}
    bags = {"x": {"a": 30, "b": 20, "c": 10, "d": 5}, None: {"a": 6}, "z": {"a": 4}}
    states = spark.createDataFrame([(s or "", k, n) for s, x in bags.items() for k, n in x.items()], "site string, sym string, cnt long")
    lengths = spark.createDataFrame([(s or "", k, n) for s, x in lens.items() for k, n in [*x.items(), (0, 9)]], "site string, len int, n long")
    reps = 400
    found, again = (r.dealt_bigrams(states, lengths, ["site"], "q", reps).collect() for _ in range(2))
    assert sorted(found) == sorted(again)
    by = defaultdict(Counter)
    for x in found:
        by[x.site, x.rep][x.a, x.b] += x.cnt
    assert {s for s, _ in by} == {"x", ""}  # no neighbours in sequences of one
    pairs, total = 3 + 6 * 3 + 29, Counter()
    for rep in range(1, reps + 1):
        assert by["", rep] == {(0, 0): 4}
        c = by["x", rep]
        assert sum(c.values()) == pairs
        for k, n in enumerate(bags["x"].values()):  # no symbol is dealt more often than it is there
            assert sum(v for (a, _), v in c.items() if a == k) <= n and sum(v for (_, b), v in c.items() if b == k) <= n
        total.update(c)
    n = list(bags["x"].values())
    for a in range(4):
        for b in range(4):
            want = pairs * n[a] * (n[b] - (a == b)) / (65 * 64)
            assert abs(total[a, b] / reps - want) < 5 * (want / reps) ** 0.5 + 0.05, (a, b)


def test_whole_tokens_are_dealt(spark):
    """Sequences of one length whose tokens fill them in any deal: every token is there in each."""
    states = spark.createDataFrame([("x", "a", 500), ("x", "b", 1)], "site string, sym string, cnt long")
    lengths = spark.createDataFrame([("x", 501, 1)], "site string, len int, n long")
    for x in r.dealt_bigrams(states, lengths, ["site"], "q", 30).groupBy("rep").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("a") == 1, F.col("cnt"))).alias("out"), F.sum(F.when(F.col("b") == 1, F.col("cnt"))).alias("into")).collect():
        assert x.n == 500 and (x.out, x["into"]) in {(1, 1), (None, 1), (1, None)}


def test_gap_null_shuffles_no_replicated_tokens(spark):
    seq = spark.range(40).select(F.col("id").alias("seq_id"), F.when(F.col("id") % 3 > 0, "x").alias("site"), F.array(F.lit("a"), F.lit("b"), (F.col("id") % 4).cast("string")).alias("symbols"))
    found = r.gap_null(seq, ["site"], "s", 5, vocab=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and sorted(x.site or "" for x in found.collect()) == ["", "x"]
    assert all(x.null_p05 <= x.null_mean <= x.null_p95 and round(x.p * 6) in range(1, 7) for x in found.collect())
