"""Chunk search where many queries, passes and ties meet, without pairs of queries and chunks."""

import random

import pytest
from pyspark.sql import functions as F

from seqweave.operators import retrieval


@pytest.mark.parametrize("small", [False, True])
def test_queries_go_in_passes_and_blocks(spark, monkeypatch, small):
    rnd = random.Random(4)
    text = lambda n: " ".join(f"word{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(n))
    same = text(9)
    c = spark.createDataFrame([(i, 0, same if i % 4 == 0 else text(rnd.randrange(1, 30))) for i in range(200)], "doc_id long, start long, chunk string").repartition(4)
    q = spark.createDataFrame([(f"q{i}", same if i < 3 else text(5)) for i in range(40)], "item_id string, text string")
    key = ["doc_id", "start"]
    index = retrieval.build(c, key, "chunk")
    x = retrieval.weighted(index, q, "item_id", "text")
    pairs = index.meet(x).groupBy("item_id", *key).agg(F.sum(F.col("w") * F.col("qw")).alias("score")).where("score >= 0.05").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-round(r.score, 9), r.doc_id)):
        want.setdefault(r.item_id, []).append((r.doc_id, round(r.score, 8)))
    if small:
        for name, size in (("PASS", 40), ("MATRIX", 100), ("PRODUCTS", 50)):
            monkeypatch.setattr(retrieval, name, size)
    found = retrieval.search(index, x, "item_id", 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.item_id, []).append((r.doc_id, round(r.score, 8)))
    assert got == {i: v[:3] for i, v in want.items()} and len(got) == 40
