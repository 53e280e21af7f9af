"""Vocabulary operators on small cases: nulls, ties, repeated rows, empty tables, plain loops."""

from collections import Counter

import numpy as np

from seqweave.operators import vocabulary as v

SEQ = "seq_id long, symbols array<string>"


def corpus(spark, rows):
    return spark.createDataFrame([(i, s) for i, s in enumerate(rows)], SEQ)


def test_word_matches_as_loops(spark):
    rng = np.random.default_rng(3)
    rows = [[str(x) for x in rng.choice(list("abc"), rng.integers(0, 9))] for _ in range(60)] + [None]
    vocabulary = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 9))) for _ in range(80)} | {"".join(s) for s in rows if s and len(s) > 6})
    parts, whole = Counter(), Counter("".join(s) for s in rows if s)
    for s in rows:
        for n in range(2, 6):
            parts.update("".join(s[i : i + n]) for i in range(len(s or []) - n + 1))
    want = {w: (len(w), parts[w], whole[w]) for w in vocabulary if parts[w] or whole[w]}
    words = spark.createDataFrame([(w, w.upper()) for w in vocabulary] + [(vocabulary[0], "z"), (None, "x")], "word string, meaning string")
    got = v.word_matches(corpus(spark, rows), words, separator="").collect()
    assert {r.word: (r.length, r.cnt, r.whole) for r in got} == want and all(r.meaning == r.word.upper() for r in got)
    c = v.word_coverage(corpus(spark, rows), words, separator="").first()
    assert (c.matches, c.checked, c.words) == (len(want), len(set(parts) | set(whole)), len(vocabulary)) and any(len(w) > 5 for w in want)


def test_word_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "word string, meaning string")
    assert v.word_coverage(corpus(spark, [["a", "b"]]), none).first().coverage == 0
    c = v.word_coverage(spark.createDataFrame([], SEQ), spark.createDataFrame([("a", None)], "word string, meaning string")).first()
    assert (c.matches, c.checked, c.words) == (0, 0, 1)


def test_candidate_words(spark):
    classes = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "S"), ("X", "L")], "sym string, class string")
    readings = spark.createDataFrame([("a", "ka", 0.5), ("a", "zu", 0.9), ("a", "ta", 0.9), ("b", "la", 0.5), ("b", None, 1.0)], "sym string, reading string, confidence double")
    vocabulary = spark.createDataFrame([("tala", "two"), ("tala", "one"), (None, "x")], "word string, meaning string")
    rows = [list("abXab"), list("abc"), list("aXb"), list("abababab"), [], None]
    got = {r.word: r for r in v.candidate_words(corpus(spark, rows), classes, readings, vocabulary, "S").collect()}
    assert set(got) == {"a b", "a b c", "a b a b a b"}
    assert got["a b"].reading == "tala" and got["a b"].meaning == "one" and got["a b"].occurrences == 3
    assert round(got["a b"].score, 9) == 1.4 and got["a b c"].reading == "tala?" and not got["a b c"].known
    assert round(got["a b c"].score, 9) == round(1.4 / 3, 9)


def test_boundary_coherence(spark):
    words = spark.createDataFrame([("x", list("ab")), ("x", list("ba")), ("y", ["a"]), ("y", None)], "site string, symbols array<string>")
    target = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, p double")
    got = {r.site: (round(r.coherence, 6), r.scored) for r in v.boundary_coherence(words, target, ["site"]).collect()}
    assert got == {"x": (round((np.log(0.5) + np.log(1e-8)) / 2, 6), 2), "y": (0, 0)}
    assert v.boundary_coherence(words.where("site = 'y'"), target, []).first().coherence == 0


def test_mapping_agreement(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (1, "b", "y"), (2, "a", "x"), (2, "b", "z"), (2, "c", "z"), (3, "d", "x"), (None, "a", "x"), (3, None, "x"), (3, "a", None)]
    m = spark.createDataFrame(rows, "run_id long, sym string, value string")
    got = {(r.run_a, r.run_b): (r.shared, r.same, r.share, round(r["keys"], 6)) for r in v.mapping_agreement(m).collect()}
    assert got == {(1, 2): (2, 1, 0.5, 0.666667), (1, 3): (0, 0, 0, 0), (2, 3): (0, 0, 0, 0)}
    assert tuple(v.unanimous(m).first()) == (4, 2, 1, 3)
    assert tuple(v.unanimous(m.where("false")).first()) == (0, 0, 0, 0)
