"""Similarity joins, weighted betweenness and chunk retrieval against plain versions, with nulls, ties and hot keys."""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from seqweave.operators import graphs, retrieval, similarity
from seqweave.sources.adapters import orders

SF = "/root/testdata/sf0.001"


# --- similarity joins


@pytest.fixture(scope="module")
def zipf(spark):
    """Vectors over features of a Zipf distribution, in two groups; some are equal, some scaled copies."""
    rnd = random.Random(4)
    features = [f"f{i}" for i in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(240):
        words = Counter(rnd.choices(features, share, k=rnd.randrange(1, 30)))
        if i % 12 == 1:
            words = Counter({f: 2 * c for f, c in last.items()})  # noqa: F821
        last = words  # noqa: F841
        rows += [("g" if i % 3 else "h", f"s{i}", f, c) for f, c in words.items()]
    return spark.createDataFrame(rows, "grp string, sym string, feature string, w long").repartition(4).cache()


def vectors_of(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.grp, r.sym][r.feature] = r.w
    return out


def pairs_of(v):
    return [(a, b) for a in v for b in v if a[0] == b[0] and a[1] < b[1]]


@pytest.mark.parametrize("least", [0.1, 0.7])
def test_cosine_join(zipf, least):
    v = vectors_of(zipf)
    norm = {k: math.sqrt(sum(w * w for w in x.values())) for k, x in v.items()}
    want = {}
    for a, b in pairs_of(v):
        dot = sum(w * v[b].get(f, 0) for f, w in v[a].items())
        if dot / (norm[a] * norm[b]) > least + 1e-12:
            want[(a[0], a[1], b[1])] = dot
    got = {(r.grp, r.x, r.y): r.dot for r in similarity.cosine_join(zipf, ["grp"], least).collect() if r.cosine > least + 1e-12}
    assert got == want


def test_candidates_are_far_fewer_than_pairs_that_share_a_feature(zipf):
    v = vectors_of(zipf)
    sharing = sum(1 for a, b in pairs_of(v) if v[a].keys() & v[b].keys())
    found = similarity.candidates(zipf, ["grp"], 0.8)
    n = found.count()
    assert 6 * n < sharing and found.distinct().count() == n


def test_join_splits_hot_features(spark, zipf, monkeypatch):
    whole = sorted(map(tuple, similarity.cosine_join(zipf, ["grp"], 0.6).select("grp", "x", "y", "dot").collect()))
    monkeypatch.setattr(similarity, "HOT", 3)
    assert sorted(map(tuple, similarity.cosine_join(zipf, ["grp"], 0.6).select("grp", "x", "y", "dot").collect())) == whole and whole


@pytest.mark.parametrize("least", [0.25, 1.0])
def test_jaccard_join(zipf, least):
    v = vectors_of(zipf)
    want = set()
    for a, b in pairs_of(v):
        both, either = len(v[a].keys() & v[b].keys()), len(v[a].keys() | v[b].keys())
        if both / either >= least:
            want.add((a[0], a[1], b[1], both))
    assert {(r.grp, r.x, r.y, r.shared) for r in similarity.jaccard_join(zipf, ["grp"], least).collect()} == want


@pytest.mark.parametrize("most", [0.4])
def test_divergence_join(zipf, most):
    total = zipf.groupBy("grp", "sym").agg(F.sum("w").alias("n"))
    shares = zipf.join(total, ["grp", "sym"]).select("grp", "sym", "feature", (F.col("w") / F.col("n")).alias("w"))
    v, want = vectors_of(shares), {}
    h = lambda p, q: p * math.log2(2 * p / (p + q)) if p else 0.0
    for a, b in pairs_of(v):
        js = sum(h(v[a].get(f, 0), v[b].get(f, 0)) + h(v[b].get(f, 0), v[a].get(f, 0)) for f in v[a].keys() | v[b].keys()) / 2
        if js <= most - 1e-9:
            want[(a[0], a[1], b[1])] = round(js, 9)
    assert {(r.grp, r.x, r.y): round(r.js, 9) + 0.0 for r in similarity.divergence_join(shares, ["grp"], most).collect() if r.js <= most - 1e-9} == want


def test_joins_of_nulls_and_nothing(spark):
    rows = [(None, "a", "f", 1), (None, "b", "f", 1), ("g", None, "f", 1), ("g", "c", None, 1), ("g", "d", "f", 0), ("g", "e", "f", 2)]
    df = spark.createDataFrame(rows, "grp string, sym string, feature string, w long")
    assert similarity.cosine_join(df, ["grp"], 0.1).count() == 0
    assert similarity.cosine_join(df.limit(0), ["grp"], 0.1).count() == 0
    assert sorted(tuple(r)[:3] for r in similarity.cosine_join(df, [], 0.1).collect()) == [("a", "b", 1), ("a", "e", 2), ("b", "e", 2)]


# --- betweenness


def plain_betweenness(edges, directed):
    """Brandes with Dijkstra, a source at a time."""
    out, nodes = defaultdict(dict), set()
    for a, b, d in edges:
        if a is None or b is None or d is None or a == b:
            continue
        nodes |= {a, b}
        for x, y in ((a, b),) if directed else ((a, b), (b, a)):
            out[x][y] = min(d, out[x].get(y, d))
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, before, order, heap = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0, s)]
        done = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in out[v].items():
                if u not in dist or d + w < dist[u]:
                    dist[u], count[u], before[u] = d + w, count[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif d + w == dist[u]:
                    count[u] += count[v]
                    before[u].append(v)
        need = defaultdict(float)
        for v in reversed(order):
            for u in before[v]:
                need[u] += count[u] / count[v] * (1 + need[v])
            if v != s:
                score[v] += need[v]
    return {v: x if directed else x / 2 for v, x in score.items()}


@pytest.mark.parametrize(("directed", "delta", "batch"), [(True, None, 512), (False, 3, 9)])
def test_betweenness_of_random_graphs(spark, directed, delta, batch):
    rnd = random.Random(9)
    edges = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.choice([1, 1, 2, 3, 9])) for _ in range(30)]
    edges += edges[:3] + [("far", "away", 4), ("n1", "n1", 1), (None, "n2", 1), ("n3", None, 1), ("n4", "n5", None)]
    df = spark.createDataFrame(edges, "a string, b string, length long")
    got = {r.sym: r.betweenness for r in graphs.betweenness(df, directed=directed, delta=delta, batch=batch).collect()}
    want = plain_betweenness(edges, directed)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[v], want[v], abs_tol=1e-9) for v in want)


def test_betweenness_without_edges_and_with_bad_lengths(spark):
    df = spark.createDataFrame([("a", "b", 0)], "a string, b string, length long")
    assert graphs.betweenness(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="over 0"):
        graphs.betweenness(df)


def test_weighted_betweenness_query(spark):
    pairs = Counter()
    for r in orders(spark, SF).collect():
        pairs.update(zip(r.symbols, r.symbols[1:], strict=False))
    want = plain_betweenness([(a, b, n) for (a, b), n in pairs.items()], True)
    n = len({x for p in pairs for x in p})
    got = {r.sym: r.betweenness for r in __spark_entry__.queries()["net_24_weighted_betweenness"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[v], want[v] / ((n - 1) * (n - 2)), abs_tol=2e-6) for v in want) and max(got.values()) > 0


# --- retrieval


def plain_search(chunks, queries, k, least=0.05):
    words = lambda t: re.findall("[a-z0-9]{3,}", (t or "").lower())
    posts = {key: Counter(words(t)) for key, t in chunks}
    df = Counter(t for c in posts.values() for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vector = lambda c: {t: n / sum(c.values()) * idf.get(t, 1.0) for t, n in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for q, text in queries:
        qv = vector(Counter(words(text)))
        scored = []
        for key, c in posts.items():
            v = vector(c)
            if (shared := qv.keys() & v.keys()) and (s := sum(qv[t] * v[t] for t in shared) / (size(qv) * size(v))) >= least:
                scored.append((-round(s, 9), key))
        out += [(q, i + 1, *key) for i, (_, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def shelf(spark):
    rnd = random.Random(8)
    common, rare = ["the", "and", "with", "from"], [f"word{i}" for i in range(150)]
    text = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(n))
    chunks = [((i, 0), text(rnd.randrange(3, 30))) for i in range(150)]
    chunks += [((200, 0), chunks[3][1]), ((201, 500), chunks[3][1]), ((202, 0), ""), ((203, 0), None), ((204, 0), "a b")]  # copies tie
    queries = [(i, text(6)) for i in range(12)] + [(20, chunks[3][1]), (21, "unknown terms only"), (22, None), (23, "the and unknown"), (24, "")]
    return chunks, queries


@pytest.mark.parametrize("k", [2, 200])
def test_search_finds_what_scoring_all_finds(spark, shelf, k):
    chunks, queries = shelf
    c = spark.createDataFrame([(*key, t) for key, t in chunks], "doc_id long, start long, chunk string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    index = retrieval.build(c, ["doc_id", "start"], "chunk")
    got = retrieval.search(index, retrieval.weighted(index, q, "item_id", "text"), "item_id", k)
    assert sorted(tuple(r)[:4] for r in got.collect()) == plain_search(chunks, queries, k)
    again = retrieval.without_repeats(got, c, "item_id", ["doc_id", "start"], "chunk").where("item_id = 20").collect()
    assert len(again) == len({r.text[:80] for r in again}) and min(r["rank"] for r in again) == 1


def test_common_terms_are_left_out_where_bounds_allow(spark, shelf):
    chunks, _ = shelf
    c = spark.createDataFrame([(*key, t) for key, t in chunks], "doc_id long, start long, chunk string")
    index = retrieval.build(c, ["doc_id", "start"], "chunk")
    q = spark.createDataFrame([(1, chunks[3][1])], "item_id long, text string")
    x = retrieval.with_bounds(index, retrieval.weighted(index, q, "item_id", "text"), "item_id", 1, 0.05).collect()
    left = {r.term for r in x if not r.essential}
    assert left and max(r.df for r in x) == max(r.df for r in x if r.term in left)
    assert sum(r.df for r in x if r.essential) < sum(r.df for r in x) / 2


def test_empty_index(spark):
    c = spark.createDataFrame([], "doc_id long, start long, chunk string")
    q = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    index = retrieval.build(c, ["doc_id", "start"], "chunk")
    assert retrieval.search(index, retrieval.weighted(index, q, "item_id", "text"), "item_id").collect() == []
