"""Words in texts by automata, against nested loops."""

import random

from seqweave.operators import automaton


def test_occurrences_against_loops(spark):
    """Overlapping words of all lengths, in one part and in many; nulls, empty and repeated rows."""
    rng = random.Random(3)
    some = lambda k: "".join(rng.choice("abé字 ") for _ in range(k))
    texts = [(i, some(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (None, "ab ab"), (5, "abab"), (62, "ab" * 5000)]
    words = [some(rng.randint(1, 5)) for _ in range(80)] + ["ab", "abab", "", None, "ab", "ab" * 300]
    df = spark.createDataFrame(texts, "id long, body string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    times = lambda t, x: sum(t.startswith(x, i) for i in range(len(t)))
    want = sorted(((i, x, times(t, x)) for i, t in texts if t for x in {x for x in words if x} if x in t), key=str)
    for part_bytes in (1 << 20, 100):
        got = automaton.occurrences(df, w, "id", "body", part_bytes)
        assert sorted(((r.id, r.word, r.cnt) for r in got.collect()), key=str) == want
    assert automaton.occurrences(df, w.limit(0), "id", "body").count() == 0
    assert automaton.occurrences(df.limit(0), w, "id", "body").count() == 0


def test_phrases(spark):
    seq = spark.createDataFrame([(1, ["a", "b", "a", "b", "a"]), (2, ["ab", "a"]), (3, []), (4, None), (5, ["x", None, "b"])], "seq_id long, symbols array<string>")
    v = spark.createDataFrame([("a b a", "m"), ("a", "one"), ("a", "an"), ("ab", None), ("x b", "gap"), ("b a b a b", "no"), ("", "none"), (None, "null")], "word string, meaning string")
    got = {r.word: (r.meaning, r.cnt, r.sequences) for r in automaton.phrase_matches(seq, v).collect()}
    assert got == {"a b a": ("m", 2, 1), "a": ("an", 4, 2), "ab": (None, 1, 1), "x b": ("gap", 1, 1)}


def test_topics(spark):
    items = spark.createDataFrame([(1, "A Seal with a SIGN"), (2, "sign | seal"), (3, None), (4, "nothing"), (5, "sig"), (5, "n")], "id long, t string")
    topics = spark.createDataFrame([("x", "Sign", None), ("x", "seal", False), ("x", "|", True), ("y", "a", False), ("y", "nothing", True), ("z", None, False), ("z", "", True), ("w", "seal", True), ("w", "seal", False)], "topic string, keyword string, excluded boolean")
    got = sorted(map(tuple, automaton.topics_by_table(items, topics, "id", "t").collect()))
    assert got == [(1, "x"), (1, "y"), (2, "y")]
