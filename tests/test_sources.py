"""Readers and writers on tiny files."""

import json

import pytest
from pyspark.sql import functions as F

from seqweave.operators import assoc, positions, transforms
from seqweave.sources import corpora


def found(df):
    return sorted(map(tuple, (r.symbols for r in df.select("symbols").collect())))


def test_lines_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A B  C\n\n  D\n")
    assert found(corpora.read_lines(spark, str(tmp_path / "a.txt"))) == [("A", "B", "C"), ("D",)]
    (tmp_path / "a.csv").write_text("id,seq\n1,A B\n2,C\n3,D E F\n")
    assert found(corpora.read_csv(spark, str(tmp_path / "a.csv"), "seq")) == [("A", "B"), ("D", "E", "F")]


def test_json_shapes(spark, tmp_path):
    shapes = {"a": [["A", "B"], ["C"]], "b": [{"signs": ["A"]}, {"sequence": ["B", "C"]}, {"tokens": ["D"]}], "c": {"inscriptions": [{"signs": ["E", "F"]}]}, "d": {"data": [["G"]]}, "e": ["X", "Y"]}
    for k, v in shapes.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    want = {"a": [("A", "B"), ("C",)], "b": [("A",), ("B", "C"), ("D",)], "c": [("E", "F")], "d": [("G",)], "e": [("X", "Y")]}
    for k, v in want.items():
        assert found(corpora.read_json(spark, str(tmp_path / f"{k}.json"))) == v


def test_relational_and_rows(spark):
    sites = spark.createDataFrame([(1, "north")], "site_id int, name string")
    seals = spark.createDataFrame([(10, 1, "clay"), (11, 2, "stone")], "seal_id int, site_id int, material string")
    ins = spark.createDataFrame([(10, True, "Right to Left"), (11, False, None)], "seal_id int, is_complete boolean, direction string")
    glyphs = spark.createDataFrame([(10, 7, 1), (10, 12, 0), (11, 3, 0)], "seal_id int, glyph_id int, idx int")
    rows = {r.seq_id: (r.site, r.direction, r.symbols) for r in corpora.assemble(sites, seals, ins, glyphs).collect()}
    assert rows == {10: ("north", "rtl", ["012", "007"]), 11: ("unknown", "unknown", ["003"])}
    long = spark.createDataFrame([("f", 0, "A", 1), ("f", 1, "", 1), ("f", 2, "B", 1), ("f", 0, "Z", 2)], "form string, position int, letters string, at int")
    assert found(corpora.from_rows(long, "form", "position", "letters", "at")) == [("Z", "B")]
    text = spark.createDataFrame([(1, "a b #c\nd\n@x e f")], "id int, t string")
    assert found(corpora.from_transliteration(text, "id", "t")) == [("a", "b"), ("e", "f")]


def test_export_and_union(spark, tmp_path):
    seq = spark.createDataFrame([(1, ["A", "B"])], "seq_id long, symbols array<string>")
    corpora.export(seq, str(tmp_path / "t"), "txt")
    assert found(corpora.read_lines(spark, str(tmp_path / "t"))) == [("A", "B")]
    corpora.export(seq, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    both = corpora.union({"x": seq, "y": seq.withColumn("site", F.lit("s"))})
    assert sorted((r.corpus_id, r.site) for r in both.collect()) == [("x", None), ("y", "s")]


def seqs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq_id long, symbols array<string>")


def test_known_values(spark):
    x = seqs(spark, [["A", "B", "C"], ["A", "D", "C"], ["A", "E", "C"]])
    four = {r.sym: r for r in positions.four_way_counts(x, []).collect()}
    assert (four["A"].initial, four["A"].terminal, four["C"].terminal, four["C"].initial) == (3, 0, 3, 0)
    y = {r.sym: r for r in positions.four_way_counts(seqs(spark, [["X", "Y", "Z"], ["A", "B", "Z"], ["C", "D", "Z"]]), []).collect()}
    assert y["Z"].exclusive and y["Z"].dominant == "terminal"
    near = assoc.cosine_pairs(assoc.context_vectors(seqs(spark, [["X", "A", "Y"], ["X", "B", "Y"]] * 10), []), []).collect()
    assert [r.cosine for r in near if (r.x, r.y) == ("A", "B")][0] > 0.5
    stems = assoc.paradigms(seqs(spark, [["A", "B", "C"], ["A", "B", "D"], ["A", "B", "E"]]), []).collect()
    assert [(r.slot, r.stem, r.variants) for r in stems] == [(3, "A B _", 3)]
    two = assoc.paradigms(seqs(spark, [["X", "A", "Z"], ["X", "B", "Z"], ["X", "C", "Z"], ["Y", "A", "Z"], ["Y", "B", "Z"]]), []).count()
    assert two >= 2
    edges = assoc.windowed_edges(seqs(spark, [list("AB" * 50 + "AC" * 5)]), [], 2, own=False).collect()
    w = {(r.a, r.b): r.weight for r in edges}
    assert w["A", "B"] > w["A", "C"]
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {r.sym: r.betweenness for r in assoc.betweenness(path).collect()} == {"a": 0, "b": 2, "c": 2, "d": 0}


def test_betweenness_of_all_orders(spark):
    """Against paths counted one by one; the query takes every segment and nation."""
    import random

    import __spark_entry__

    from seqweave.sources.adapters import orders

    def brute(edges):
        near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for e in edges for v in e}
        want = dict.fromkeys(near, 0.0)
        for s in near:
            depth, paths, line = {s: 0}, {s: 1}, [s]
            for v in line:
                for w in sorted(near[v]):
                    if w not in depth:
                        depth[w], paths[w] = depth[v] + 1, 0
                        line.append(w)
                    paths[w] += paths[v] if depth[w] == depth[v] + 1 else 0
            share = dict.fromkeys(line, 0.0)
            for w in reversed(line):
                for v in near[w]:
                    if depth[v] == depth[w] - 1:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                want[w] += share[w] / 2 if w != s else 0
        return want

    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(16)} | {("x", "y"), ("y", "z")}
    got = {r.sym: r.betweenness for r in assoc.betweenness(spark.createDataFrame(sorted(edges), "a string, b string")).collect()}
    assert got == pytest.approx(brute(edges))
    sf = "/root/testdata/sf0.001"
    pairs = {tuple(sorted(p)) for r in orders(spark, sf).collect() for p in zip(r.symbols, r.symbols[1:]) if p[0] != p[1]}
    assert {r.sym: r.betweenness for r in __spark_entry__.queries()["net_24_betweenness"](spark, sf).collect()} == pytest.approx(brute(pairs), abs=2e-6)


def test_whole_texts_are_keys(spark, tmp_path):
    """Documents that share their first 50 letters are different items."""
    import __spark_entry__

    start = "the same opening words of many different documents "
    rows = [(1, start + "one", "en", "a"), (2, start + "two", "en", "b"), (3, start + "TWO!", "de", "a"), (4, start + "one", "fr", "c"), (5, "?", "en", "a"), (6, start + "known", "en", "a"), (8, None, "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, start + "Known")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in run("evd_9_first_per_whole_text")) == [1, 2, 5]
    assert sorted((r.title, r.topics, r.fetched_at) for r in run("evd_2_upsert_whole_text") if r.item_id) == [("de", "a", 3), ("en", "a", 5), ("en", "a", 6), ("en", "b", 2), ("fr", "a,c", 4)]


def test_transforms(spark):
    x = seqs(spark, [["A", "A", "B"], [], ["C"]])
    got = {r.seq_id: (r.collapsed, r.run_lengths) for r in transforms.collapse_runs(x).collect()}
    assert got == {0: (["A", "B"], [2, 1]), 1: ([], []), 2: (["C"], [1])}
    big = spark.range(500).select(F.col("id").alias("seq_id"), F.array(F.lit("A"), F.lit("B"), F.lit("C")).alias("symbols"))
    n = [r.n for r in transforms.folds(big, 5).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(n) == 5 and sum(n) == 500
    shuffled = transforms.shuffle_within(big, "s", 2)
    assert shuffled.count() == 1000 and shuffled.where("array_sort(symbols) <> array('A', 'B', 'C')").count() == 0
    share = transforms.split_contiguous(big, 0.8).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert {r.part: r.n for r in share} == {"train": 400, "test": 100}
