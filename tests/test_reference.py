"""Operators that SQL can't express, against plain Python; and cases that the small tables don't hold."""

from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.operators import align, assoc, compare, lm, strata, transforms, zones
from seqweave.operators import measures as m
from seqweave.operators import resampling as r
from seqweave.sources import corpora
from seqweave.sources.adapters import orders

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return orders(spark, SF).where("segment = 'BUILDING'").cache()


def rows(seq):
    return [(x.seq_id, x.symbols) for x in seq.select("seq_id", "symbols").collect()]


def test_label_propagation(corpus):
    edges = assoc.windowed_edges(corpus, [], 2, own=False)
    near = defaultdict(dict)
    for e in edges.collect():
        near[e.a][e.b] = near[e.b][e.a] = e.weight
    label = {v: v for v in near}
    for _ in range(20):
        new = {}
        for v, around in near.items():
            votes = Counter()
            for u, w in around.items():
                votes[label[u]] += w
            new[v] = min(votes, key=lambda x: (-votes[x], x))
        if new == label:
            break
        label = new
    assert {x.sym: x.label for x in assoc.label_propagation(edges).collect()} == label


def test_betweenness(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(rng.choice(18, 2, replace=False).tolist())) for _ in range(30)})
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for u in near[v]:
                if u not in depth:
                    depth[u] = depth[v] + 1
                    queue.append(u)
                if depth[u] == depth[v] + 1:
                    paths[u] += paths[v]
        part = defaultdict(float)
        for v in reversed(order):
            for u in near[v]:
                if depth[u] == depth[v] - 1:
                    part[u] += paths[u] / paths[v] * (1 + part[v])
            if v != s:
                want[v] += part[v] / 2
    got = assoc.betweenness(spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs], "a string, b string")).collect()
    assert {int(x.sym): round(x.betweenness, 9) for x in got} == {v: round(w, 9) for v, w in want.items()}


def gap_of(seqs):
    pairs = Counter((a, b) for s in seqs for a, b in zip(s, s[1:], strict=False))
    names = sorted({v for p in pairs for v in p})
    x = np.zeros((len(names), len(names)))
    for (a, b), n in pairs.items():
        x[names.index(a), names.index(b)] = n
    sums = x.sum(1, keepdims=True)
    x = np.where(sums > 0, x / np.maximum(sums, 1), 1 / len(names))
    return 1 - np.sort(np.abs(np.linalg.eigvals(x)))[::-1][1]


def test_spectral_gap_and_its_null(corpus):
    got = assoc.spectral_gap(corpus, ["segment"]).first()
    assert abs(got.gap - gap_of([s for _, s in rows(corpus)])) < 1e-9
    null = r.gap_null(corpus, ["segment"], "g", 5).first()
    assert null.gap == got.gap and round(null.p * 6) in range(1, 7) and null.null_p05 <= null.null_mean <= null.null_p95
    dealt = zones.shuffle_globally(corpus, "g", ["segment"])
    assert Counter(v for _, s in rows(dealt) for v in s) == Counter(v for _, s in rows(corpus) for v in s)
    assert {i: len(s) for i, s in rows(dealt)} == {i: len(s) for i, s in rows(corpus)}


def test_kmeans_separates(spark):
    rng = np.random.default_rng(1)
    data = [(f"s{i:03}", float(rng.normal(10 * (i % 3) ** 2, 0.3)), float(rng.normal(-7 * (i % 3) ** 2, 0.3))) for i in range(90)]
    got = strata.kmeans(spark.createDataFrame(data, "sym string, a double, b double"), ["a", "b"], [2, 3]).collect()
    best = max((x.silhouette, x.k) for x in got)[1]
    groups = defaultdict(set)
    for x in got:
        if x.k == best:
            groups[x.cluster].add(int(x.sym[1:]) % 3)
    assert best == 3 and sorted(map(sorted, groups.values())) == [[0], [1], [2]]


def test_gap_fill(spark):
    """Symbols between known neighbours are paired where both gaps are of one length."""
    left = spark.createDataFrame([(1, list("axb")), (2, list("axxb")), (3, list("axb")), (4, list("ayb"))], "seq_id long, symbols array<string>")
    right = spark.createDataFrame([(1, list("ATB")), (2, list("ATB")), (3, list("ATB")), (4, list("AZB"))], "seq_id long, symbols array<string>")
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "sym string, match string")
    assert [tuple(x) for x in align.gap_fill(left, right, known, 2).collect()] == [("x", "T", 2)]


def path_in_full_table(m, r):
    best = [[0] * (len(r) + 1) for _ in range(len(m) + 1)]
    for i in range(len(m) - 1, -1, -1):
        for t in range(len(r) - 1, -1, -1):
            best[i][t] = best[i + 1][t + 1] + 1 if m[i] == r[t] else max(best[i + 1][t], best[i][t + 1])
    out, i, t = [], 0, 0
    while i < len(m) and t < len(r):
        if m[i] == r[t]:
            out.append((i, t))
            i, t = i + 1, t + 1
        elif best[i + 1][t] >= best[i][t + 1]:
            i += 1
        else:
            t += 1
    return out


def test_common_subsequence():
    rng = np.random.default_rng(8)
    for k in range(400):
        letters = list("abcdefgh")[: 1 + k % 8]
        x, y = (rng.choice(letters, rng.integers(0, 40)).tolist() for _ in "xy")
        assert align.common_subsequence(x, y) == path_in_full_table(x, y)
    assert align.common_subsequence(["a"] * 10_000, ["a"] * 9_000) == [(i, i) for i in range(9_000)]
    x = rng.choice(list("abcd"), 10_000).tolist()
    y = [v for v in x if v != "d"]
    assert len(align.common_subsequence(x, y)) == len(y)


def test_gap_fill_of_long_sequences(spark):
    """10,000 symbols a side, gaps of one length between known neighbours."""
    left = spark.createDataFrame([(1, list("axyb") * 2500), (2, []), (3, None)], "seq_id long, symbols array<string>")
    right = spark.createDataFrame([(1, list("ATUB") * 2500), (2, ["A"]), (3, ["A"])], "seq_id long, symbols array<string>")
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "sym string, match string")
    assert sorted(tuple(x) for x in align.gap_fill(left, right, known, 2).collect()) == [("x", "T", 2500), ("y", "U", 2500)]


def test_bijection_of_many_symbols(spark):
    seq = spark.range(1200).select(F.col("id").alias("seq_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("s"), (F.col("id") * 10 + i).cast("string"))).alias("symbols"))
    assert transforms.bijection(seq, "s").select("to").distinct().count() == 12_000
    again = transforms.relabel(seq, "s")
    assert {i: len(s) for i, s in rows(again)} == {i: len(s) for i, s in rows(seq)}
    moved = transforms.noise(seq, "s", 0.5)
    same = sum(a == b for (i, s), (j, t) in zip(sorted(rows(seq)), sorted(rows(moved)), strict=True) for a, b in zip(s, t, strict=True))
    assert 0.45 < same / 12_000 < 0.55
    hot = spark.range(2000).select(F.col("id").alias("seq_id"), F.array(F.lit("hot"), F.concat(F.lit("r"), F.col("id").cast("string"))).alias("symbols"))
    drawn = Counter(v for _, s in rows(strata.drawn_from_frequencies(hot, "s")) for v in s)
    assert sum(drawn.values()) == 4000 and abs(drawn["hot"] / 4000 - 0.5) < 0.05


def test_long_glyph_ids(spark):
    t = spark.createDataFrame
    got = corpora.assemble(t([(1, "x")], "site_id int, name string"), t([(1, 1, "m", "R/L")], "seal_id int, site_id int, material string, direction string"), t([(1, True)], "seal_id int, is_complete boolean"), t([(1, 0, 7), (1, 1, 12345)], "seal_id int, idx int, glyph_id int"))
    assert got.first().symbols == ["007", "12345"]


def test_one_to_one_goes_on(spark):
    """Ten rounds are needed: each x prefers the y of the one before it."""
    scores = [(f"x{i}", f"y{i}", 100.0 - 2 * i) for i in range(10)] + [(f"x{i + 1}", f"y{i}", 99.0 - 2 * i) for i in range(9)]
    got = strata.one_to_one(spark.createDataFrame(scores, "x string, y string, score double")).collect()
    assert sorted((x.x, x.y, x.round) for x in got) == [(f"x{i}", f"y{i}", i + 1) for i in range(10)]


def test_strata_without_a_name(spark):
    seq = spark.createDataFrame([(1, None, list("abab")), (2, None, list("abc")), (3, "s", list("abab"))], "seq_id long, site string, symbols array<string>")
    p = {(x.site, x.a, x.b): x.cnt for x in assoc.pmi(seq, ["site"], 1).collect()}
    assert p[None, "a", "b"] == 3 and p["s", "a", "b"] == 2
    assert {x.site for x in m.frequency(seq, ["site"]).collect()} == {None, "s"}
    assert {x.site for x in m.corpus_summary(seq, ["site"]).collect()} == {None, "s"} and {x.site for x in assoc.features(seq, ["site"]).collect()} == {None, "s"}


def test_a_context_of_all_symbols(spark):
    """One neighbour that all symbols share: pairs stay exact."""
    seq = spark.range(60).select(F.col("id").alias("seq_id"), F.array(F.concat(F.lit("s"), F.col("id").cast("string")), F.lit("hub")).alias("symbols"))
    got = assoc.cosine_pairs(assoc.context_vectors(seq, []), [], 0.9)
    assert got.count() == 60 * 59 / 2


def test_divergence_of_strata(spark):
    c = spark.createDataFrame([("p", "a", 3), ("p", "b", 1), ("q", "a", 1), ("q", "c", 1), ("z", "d", 2)], "s string, sym string, cnt long")
    got = {(x.x, x.y, x.sym): (x.cx, x.cy) for x in compare.stratum_pairs(c, "s").collect()}
    names, want = {"p": {"a": 3, "b": 1}, "q": {"a": 1, "c": 1}, "z": {"d": 2}}, {}
    for x, y in (("p", "q"), ("p", "z"), ("q", "z")):
        for v in set(names[x]) | set(names[y]):
            want[x, y, v] = (names[x].get(v, 0), names[y].get(v, 0))
    assert got == want


def test_stream_model(spark):
    seq = spark.createDataFrame([(1, list("ab")), (2, ["c"]), (3, list("ab"))], "seq_id long, symbols array<string>")
    got = {(x.n, x.gram): x.p for x in lm.stream_model(seq, []).collect()}
    assert got[2, "a b"] == 0.5 and got[2, "b c"] == 0.25 and round(got[3, "b c a"], 9) == round(1 / 3, 9)


def test_places_in_context_vectors(spark):
    """The only symbol of a sequence is first and last; empty and null sequences have none."""
    from seqweave.operators import assoc

    x = spark.createDataFrame([(1, ["A", "B", "C", "B"]), (2, ["A"]), (3, []), (4, None)], "seq_id long, symbols array<string>")
    got = {(r.sym, r.feature): r.w for r in assoc.context_vectors(x, [], places=True).collect() if r.feature.startswith("P:")}
    assert got == {("A", "P:initial"): 2, ("A", "P:terminal"): 1, ("B", "P:medial"): 1, ("C", "P:medial"): 1, ("B", "P:terminal"): 1}
