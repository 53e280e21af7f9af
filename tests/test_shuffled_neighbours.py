"""Neighbours of shuffled sequences, counted without writing the sequences, against shuffle_within and its measures."""

import random
from collections import Counter

import pytest

from seqweave.operators import nulls, positions, transforms


def corpus(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice("abcdef") for _ in range(rnd.randrange(0, 13))]) for i in range(200)] + [(i, ["a", "b"]) for i in range(200, 230)] + [(i, ["c", "a", "f"]) for i in range(230, 250)] + [(999, None), (None, ["a", "b", "b"])]
    return spark.createDataFrame(rows, "seq_id long, symbols array<string>").repartition(3)


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_neighbours_are_those_of_shuffle_within(spark, monkeypatch, chunk):
    monkeypatch.setattr(nulls, "CHUNK", chunk)
    x, want = corpus(spark), Counter()
    for rep, s in [(0, r.symbols) for r in x.collect()] + [(r.rep, r.symbols) for r in transforms.shuffle_within(x, "q", 3).collect()]:
        for i, c in enumerate(s or []):
            want[rep, c, s[i + 1] if i + 1 < len(s) else None, i == 0, i + 1 == len(s)] += 1
    got = nulls.shuffled_neighbours(x, "q", 3)
    assert {(r.rep, r.sym, r.nb, r.first, r.last): r.cnt for r in got.collect()} == want
    odd = spark.createDataFrame([(1, ["a", None, "b"]), (2, [None])], "seq_id long, symbols array<string>")
    assert sorted((r.sym or "", r.nb or "", r.first, r.last, r.cnt) for r in nulls.shuffled_neighbours(odd, "q", 0).collect()) == [("", "", True, True, 1), ("", "b", False, False, 1), ("a", "", True, False, 1), ("b", "", False, True, 1)]
    assert nulls.shuffled_neighbours(x.limit(0), "q", 3).collect() == []


def test_measures_of_neighbours_are_those_of_sequences(spark):
    x = corpus(spark).where("symbols IS NOT NULL")
    both = nulls.shuffled_neighbours(x, "q", 3)
    seqs = transforms.shuffle_within(x, "q", 3)
    targets = spark.createDataFrame([(c,) for c in "abcdz"], "sym string")
    assert sorted(nulls.neighbour_rates(both.where("rep > 0"), ["rep"]).collect()) == sorted(positions.rates(seqs, ["rep"]).collect())
    assert sorted(nulls.neighbour_labels(both).collect()) == sorted(nulls.label_counts(x).collect())
    got, want = ({r.rep: round(r.value, 9) for r in d.collect()} for d in (nulls.neighbour_polysemy(both.where("rep > 0"), ["rep"], targets, 3, 0.1), nulls.polysemy_rate(seqs, ["rep"], targets, 3, 0.1)))
    assert got == want and any(got.values())


def test_targets_meet_counts_and_not_tokens(spark):
    found = nulls.polysemy_rate(corpus(spark), ["seq_id"], spark.createDataFrame([("a",)], "sym string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all("Aggregate" in plan[i + 1] for i, line in enumerate(plan) if "LeftSemi" in line)
