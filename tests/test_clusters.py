"""Choice of clusters: known groups, gates, silhouettes against all pairs of points."""

import numpy as np

from seqweave.operators import clusters as k


def test_known_clusters_are_chosen(spark):
    rng = np.random.default_rng(2)
    centres = [(0, 0), (40, 0), (0, 40), (40, 40)]
    rows = [(f"s{i:03}", float(rng.normal(centres[i % 4][0], 1)), float(rng.normal(centres[i % 4][1], 1)), 5.0) for i in range(80)]
    points = spark.createDataFrame(rows, "sym string, a double, b double, same double")
    got = k.chosen(points, ["a", "b", "same"], [2, 3, 4, 5, 8, 500], least_clusters=4).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.cluster, set()).add(int(r.sym[1:]) % 4)
    assert len(got) == 80 and {r.k for r in got} == {4} and sorted(map(sorted, groups.values())) == [[0], [1], [2], [3]] and {r.fault for r in got} == {None}


def test_silhouettes_as_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    labels = {2: rng.integers(0, 2, 30), 5: rng.integers(0, 5, 30), 7: np.array([0] * 29 + [1]), 9: np.zeros(30, int)}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {}
    for n, own in labels.items():
        s = []
        for i in range(30):
            same = (own == own[i]) & (np.arange(30) != i)
            others = [d[i][own == c].mean() for c in set(own.tolist()) - {own[i]}]
            s.append(0.0 if not same.any() or not others else (min(others) - d[i][same].mean()) / max(min(others), d[i][same].mean()))
        want[n] = round(float(np.mean(s)), 9)
    points = spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(x)], "sym string, a double, b double")
    assigned = spark.createDataFrame([(n, str(i), int(c)) for n, own in labels.items() for i, c in enumerate(own)], "k int, sym string, cluster int")
    assert {r.k: round(r.silhouette, 9) for r in k.silhouettes(points, ["a", "b"], assigned).collect()} == want
    got = {r.k: r for r in k.choice(points, ["a", "b"], assigned, least_clusters=5).collect()}
    assert got[7].fault == got[9].fault == "crowded" and got[5].fault is None and sum(r.best for r in got.values()) == 1


def test_gates(spark):
    points = spark.createDataFrame([(str(i), float(i), None) for i in range(100)], "sym string, a double, b double")
    cut = lambda n, c: [(n, str(i), c(i)) for i in range(100)]
    assigned = spark.createDataFrame(cut(2, lambda i: i // 50) + cut(3, lambda i: i // 60) + cut(25, lambda i: i // 4), "k int, sym string, cluster int")
    assert {r.k: r.fault for r in k.choice(k.standardised(points, ["a", "b"]), ["a", "b"], assigned).collect()} == {2: "few", 3: "crowded", 25: None}
    assert {r.k: r.fault for r in k.choice(points.fillna(0), ["a", "b"], assigned, most_reduction=0.8).collect()}[2] == "flat"
    assert k.clusterings(points.where("false"), ["a"], [2]).count() == 0
