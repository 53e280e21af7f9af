"""Summaries on small cases: nulls, ties, empty tables, cases that the tables don't hold."""

from collections import Counter

import numpy as np

from seqweave.operators import summaries as s


def test_flat_network_as_loops(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 7, [str(x) for x in rng.choice(list("abcdef"), rng.integers(0, 4), p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])]) for i in range(80)]
    stream = [v for _, r in rows for v in r]
    count = Counter(stream)
    nodes = sorted((v for v in count if count[v] >= 3), key=lambda v: (-count[v], v))[:4]
    want = Counter(tuple(sorted((x, y))) for k in (1, 2, 3) for x, y in zip(stream, stream[k:], strict=False) if x in nodes and y in nodes)
    seq = spark.createDataFrame([*rows, (1000, None)], "seq_id long, symbols array<string>")
    assert {(r.a, r.b): r.weight for r in s.flat_edges(seq, 3, 3, 4, 4).collect()} == {p: w for p, w in want.items() if w >= 4}
    d = {r.sym: (r.cnt, r.degree, r.strength) for r in s.flat_degrees(seq, 3, 3, 4, 10_000).collect()}
    assert d == {v: (count[v], 0, 0) for v in nodes}


def test_grid_density(spark):
    t = lambda rows: spark.createDataFrame(rows, "sym string, cluster string")
    assert tuple(s.grid_density(t([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), (None, "3")]), t([("a", "x"), ("b", "x"), ("c", "y"), ("e", "y"), ("d", None)])).first()) == (2, 2, 2, 1, 1, 0.5)
    assert s.grid_density(t([]), t([])).first().density == 0


def test_sound_similarity(spark):
    words = spark.createDataFrame([("p", "thin"), ("p", "Tin"), ("q", "THE"), ("q", "to"), ("r", "xx"), (None, "to"), ("r", None)], "lang string, word string")
    got = {(r.x, r.y): round(r.similarity, 9) for r in s.sound_similarity(words, "word", "lang", {"TH": 1}, {"T": 2}).collect()}
    assert got == {("p", "q"): 1.0, ("p", "r"): 0.0, ("q", "r"): 0.0}


def test_readings_summary(spark):
    rows = [("ab", 1.0, "x"), ("ab", 0.5, "x"), ("cd", 1.0, ""), ("ce", None, None), (None, 0.0, "y")]
    got = {(r.dim, r.value): (r.n, r.share) for r in s.readings_summary(spark.createDataFrame(rows, "reading string, coverage double, site string"), ["site"], 2).collect()}
    assert got == {("(all)", ""): (5, 1.0), ("(full)", ""): (2, 0.4), ("reading", "ab"): (2, 0.4), ("reading", "cd"): (1, 0.2), ("site", "x"): (2, 0.4), ("site", "y"): (1, 0.2)}
    assert s.readings_summary(spark.createDataFrame([], "reading string, coverage double, site string"), ["site"]).count() == 0


def test_anchors_with_variants(spark):
    mapping = spark.createDataFrame([("a", "miin", "high"), ("a", "zz", "low"), ("b", "MIIN-2", None), ("c", "kol", "high"), ("d", None, "high")], "sym string, value string, confidence string")
    anchors = spark.createDataFrame([("a", "Miin", "HIGH"), ("a", "Miin", "HIGH"), ("c", "miin", "medium"), ("d", "miin", "high"), ("b", "miin", None)], "sym string, value string, confidence string")
    families = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("a", "g"), ("b", "g"), (None, "f")], "sym string, family string")
    got = {r.sym: (r.matches, r.variants, r.score) for r in s.anchors_with_variants(mapping, anchors, families).collect()}
    assert got == {"a": (True, 1, 3.25), "b": (True, 1, 0.75), "c": (False, 0, 0.0), "d": (False, 0, 0.0)}
