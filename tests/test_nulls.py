"""Permutation tests, pairings and mapping scores against plain loops, with nulls, ties and empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from seqweave.operators import lm, nulls


def plain_pairs(rows):
    """Mutual-best rounds of one group, one round after the other."""
    left, out, r = {}, [], 0
    for x, y, s in rows:
        if None not in (x, y, s):
            left[x, y] = max(s, left.get((x, y), s))
    while left:
        r += 1
        order = sorted((-s, x, y) for (x, y), s in left.items())
        bx, by = {}, {}
        for _, x, y in order:
            bx.setdefault(x, y)
            by.setdefault(y, x)
        got = [(x, y) for x, y in bx.items() if by[y] == x]
        out += [(x, y, left[x, y], r) for x, y in got]
        gone_x, gone_y = {x for x, _ in got}, {y for _, y in got}
        left = {k: s for k, s in left.items() if k[0] not in gone_x and k[1] not in gone_y}
    return sorted(out)


def test_one_to_one_of_many_groups_equals_a_loop_over_them(spark):
    rnd = random.Random(2)
    rows = [(g, f"x{rnd.randrange(6)}", f"y{rnd.randrange(5)}", float(rnd.randrange(4))) for g in range(6) for _ in range(rnd.randrange(1, 25))]
    rows += [(0, None, "y1", 9.0), (0, "x1", None, 9.0), (0, "x1", "y1", None)]
    got = nulls.one_to_one(spark.createDataFrame(rows, "g int, x string, y string, score double"), ["g"]).collect()
    by = defaultdict(list)
    for g, *r in rows:
        by[g].append(r)
    assert sorted(map(tuple, got)) == sorted((g, *p) for g, v in by.items() for p in plain_pairs(v))
    assert nulls.one_to_one(spark.createDataFrame([], "g int, x string, y string, score double"), ["g"]).collect() == []


def test_verdicts_missing_replicates_and_ties(spark):
    rows = [("a", 0, 9.0), *[("a", i, float(i % 5)) for i in range(1, 41)], ("b", 0, 2.0), ("b", 1, 2.0), ("b", 2, None), ("c", 1, 1.0)]
    got = {r.m: r for r in nulls.tested(spark.createDataFrame(rows, "m string, rep int, value double"), ["m"], 40).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.observed, a.null_mean, a.p95, a.p99, a.p, a.verdict) == (9.0, 2.0, 4.0, 4.0, 1 / 41, "STRONGLY_CONFIRMED")
    assert math.isclose(a.null_sd, math.sqrt(2)) and math.isclose(a.z, 7 / math.sqrt(2))
    assert (b.null_mean, b.p, b.p99) == (0.05, 2 / 41, 2.0) and b.verdict == "CONFIRMED"  # 38 missing values and a null count as 0
    assert (c.observed, c.p, c.verdict) == (0.0, 1.0, "FAILED")


def test_assignment_test_of_strata(spark):
    rows = [("s", f"x{i}", f"y{j}", 10.0 if i == j else 1.0) for i in range(4) for j in range(4)] + [("t", "x", "y", 1.0), (None, "x", "y", 1.0)]
    got = {r.stratum: r for r in nulls.assignment_test(spark.createDataFrame(rows, "stratum string, x string, y string, score double"), "stratum", "q", 30).collect()}
    assert got.keys() == {"s", "t"} and got["s"].observed == 40.0 and got["s"].p < 0.1
    assert (got["t"].observed, got["t"].p, got["t"].z) == (1.0, 1.0, 0.0)


def test_best_length_pairs(spark):
    rnd = random.Random(5)
    names = [(f"n{rnd.randrange(30)}",) for _ in range(90)]
    names = [(n, 1 + int(n[1:]) % 9) for (n,) in names] + [(None, 2), ("n1", None)]
    objects = [(i, rnd.choice([1, 2, 3, 14, 20])) for i in range(40)] + [(0, None), (None, 3), (3, 2)]
    n, o = spark.createDataFrame(names, "name string, len int"), spark.createDataFrame(objects, "object long, len int")
    count = Counter(x for x in names if None not in x)
    all_pairs = sorted((-(1 - abs(lo - ln) / 5), ob, na, lo, ln, c) for (na, ln), c in count.items() if c >= 2 for ob, lo in {x for x in objects if None not in x} if abs(lo - ln) < 5)
    for k in (1, 7, 60, 5000):
        got = [(-r.score, r.object, r.name, r.object_len, r.name_len, r.occurrences) for r in nulls.best_length_pairs(n, o, k, 5, 2).collect()]
        assert [tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in got] == [tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in all_pairs[:k]]
    assert nulls.best_length_pairs(n.limit(0), o).collect() == []


def plain_polysemy(seqs, targets, least=3, bits=0.3):
    first, other = defaultdict(Counter), defaultdict(Counter)
    for s in seqs:
        for i, (a, b) in enumerate(zip(s, s[1:], strict=False)):
            (other if i else first)[a][b] += 1
    hits = 0
    for t in targets:
        ni, nr, v = sum(first[t].values()), sum(other[t].values()), first[t].keys() | other[t].keys()
        if ni >= least and nr >= least:
            p = lambda c, n, w: (c.get(w, 0) + 1) / (n + len(v))  # noqa: B023, E731
            hits += sum(p(first[t], ni, w) * math.log2(p(first[t], ni, w) / p(other[t], nr, w)) for w in v) > bits
    return hits / len(targets)


def test_polysemy_rate(spark):
    rnd = random.Random(6)
    seqs = [[rnd.choice("abcdef") for _ in range(rnd.randrange(0, 9))] for _ in range(120)] + [["a", "b"]] * 9 + [["c", "a", "f"]] * 9
    df = spark.createDataFrame([(1, s) for s in seqs] + [(2, list("abab"))], "rep int, symbols array<string>")
    targets = spark.createDataFrame([(c,) for c in "abcdefz"], "sym string")
    got = {r.rep: r.value for r in nulls.polysemy_rate(df, ["rep"], targets).collect()}
    assert math.isclose(got[1], plain_polysemy(seqs, "abcdefz")) and got[1] > 0 and 2 not in got


def plain_score(seqs, mapping, target, wp, wo, wr):
    """One mapping's score, sequence after sequence."""
    after, pairs = Counter(), Counter()
    for s in target:
        x = ["<BOW>", *s, "<EOW>"]
        pairs.update(zip(x, x[1:], strict=False))
        after.update(x[:-1])
    dec = [[mapping.get(c, "?") for c in s] for s in seqs]
    ll = sum(math.log(pairs[p] / after[p[0]] if p in pairs else 1e-8) for s in dec for x in (["<BOW>", *s, "<EOW>"],) for p in zip(x, x[1:], strict=False))

    def places(corpus):
        n = defaultdict(lambda: [0, 0, 0])
        for s in corpus:
            for i, c in enumerate(s if len(s) > 1 else []):
                n[c][0 if i == 0 else 2 if i == len(s) - 1 else 1] += 1
        return {c: [v / sum(x) for v in x] for c, x in n.items()}

    own, to = places(seqs), places(target)
    ll += sum(a * b for c, x in own.items() if mapping.get(c) in to for a, b in zip(x, to[mapping[c]], strict=True)) * abs(ll) * wp
    rate = lambda corpus: (lambda p: sum(a == b for a, b in p) / len(p) if p else 0.0)([q for s in corpus for q in zip(s, s[1:], strict=False)])
    ll -= wo * max(0.0, rate(dec) - rate(target)) * abs(ll)
    words = [s for s in target if len(s) > 1]
    logs = [math.log(n / len(words) if (n := sum({a, b} <= set(t) for t in words)) else 1e-4) for s in dec if len(s) > 1 for a in set(s) - {"?"} for b in set(s) - {"?"} if a < b]
    return ll + (wr * sum(logs) / len(logs) * abs(ll) if logs else 0.0)


@pytest.mark.parametrize("weights", [(0.005, 0.0, 0.0), (0.01, 0.7, 0.05)])
def test_full_mapping_scores(spark, weights):
    rnd = random.Random(7)
    seqs = [[rnd.choice("abcdef") for _ in range(rnd.randrange(0, 7))] for _ in range(60)]
    target = [[rnd.choice("uvwxyz") for _ in range(rnd.randrange(0, 6))] for _ in range(50)]
    maps = {r: {c: rnd.choice("uvwxyz?q") for c in "abcdefk" if rnd.random() < 0.8} for r in range(5)} | {9: {"k": "u"}}
    rows = [(r, c, v) for r, x in maps.items() for c, v in x.items()] + [(None, "a", "u"), (1, None, "u")]
    frame = lambda c: spark.createDataFrame([(s,) for s in c], "symbols array<string>")
    got = {r.run_id: r.score for r in lm.score_mappings_fully(frame(seqs), spark.createDataFrame(rows, "run_id long, sym string, value string"), frame(target), *weights).collect()}
    assert got.keys() == maps.keys()
    for r, x in maps.items():
        assert math.isclose(got[r], plain_score([s for s in seqs if s], x, [s for s in target if s], *weights), rel_tol=1e-9), r
