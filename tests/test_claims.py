"""Listings, links and claims on small cases: nulls, ties, empty tables, repeated rows."""

from seqweave.operators import claims as c


def test_listing(spark):
    rows = [(1, "a, b", "paper", "new", "2024-01-01 00:00:00"), (2, "ab", "paper", "new", "2024-01-03 00:00:00"), (3, "b", "paper", "seen", "2024-01-02 00:00:00"), (4, None, None, None, None), (5, "b", "paper", "new", "2024-01-02 00:00:00")]
    x = spark.createDataFrame(rows, "item_id long, topics string, kind string, status string, t string").selectExpr("item_id", "topics", "kind", "status", "timestamp(t) AS fetched_at")
    ids = lambda df: [r.item_id for r in df.collect()]
    assert ids(c.listing(x)) == [2, 3, 5, 1, 4] and ids(c.listing(x, "b")) == [3, 5, 1]
    assert ids(c.listing(x, "b", "paper", "new", "2024-01-01 12:00:00")) == [5] and ids(c.listing(x, limit=2, offset=1)) == [3, 5]
    listed = x.selectExpr("item_id", "split(topics, ', ') AS topics", "kind", "status", "fetched_at")
    assert ids(c.listing(listed, "b")) == [3, 5, 1] and ids(c.listing(x.where("false"), "b")) == []


def test_entity_links(spark):
    text = "Sign 12 and sign 12, M-77 or M77, Parpola No. 5, Fuls 9, DEDR 4321a; from Mohenjo Daro, MOHENJO DARO and Lothal."
    got = {(r.kind, r.scheme, r.target): (r.label, r.mentions) for r in c.entity_links(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert got == {("sign", "generic", "12"): ("12", 2), ("sign", "mahadevan", "77"): ("77", 2), ("sign", "parpola", "5"): ("5", 1), ("sign", "fuls", "9"): ("9", 1), ("dedr", "", "4321"): ("4321", 1), ("site", "", "mohenjo-daro"): ("Mohenjo Daro", 2), ("site", "", "lothal"): ("Lothal", 1)}


CLAIM = "claim_type string, source string, signs array<string>, value string, text string, status string"


def test_matrix(spark):
    rows = [
        ("sign_value", "p", ["fish", "jar"], "meen", "", "strongly_supported"), ("sign_value", "q", ["fish"], "x", "", "partially_falsified"), ("sign_value", "q", [], "x", "The Jar sign", None),
        (None, None, None, None, None, "contradicted"), ("position", "p", [None], "x", "boats", "untested"), ("position", "", ["jar"], "x", "", "supported in part"),
    ]
    x = spark.createDataFrame(rows, CLAIM)
    got = {r.key: (r.claims, r.sources, r.supported, r.falsified, r.untested, r.verdict) for r in c.matrix(x).collect()}
    assert got == {"fish": (2, 2, 1, 1, 0, "conflict"), "jar": (3, 2, 1, 0, 1, "supported"), "unclassified": (2, 1, 0, 1, 1, "falsified")}
    assert {r.key: r.verdict for r in c.matrix(x, "type").collect()} == {"sign_value": "conflict", "unknown": "falsified", "position": "untested"}
    assert c.matrix(x.where("false")).count() == 0


def test_compound_hypotheses(spark):
    rows = [
        ("sign_value", "p", ["fish"], "meen", "", None), ("sign_value", "p", ["fish"], "meen", "", None), ("position", "p", None, None, "initial signs", None), ("position", "q", None, None, "Initial signs are titles", None),
        ("position", "q", None, None, "signs in the initial place", None), ("position", "r", None, None, "somewhere", None), ("position", None, None, None, "terminal", None), ("archaeological", "p", None, None, "Seals lie at gates", None), ("language", "r", None, None, None, None), ("language", "p", None, None, "it agglutinates", None),
    ]
    got = c.compound_hypotheses(spark.createDataFrame(rows, CLAIM)).collect()
    assert sorted((r.kind, r.sign, r.position, r.value_source, r.other_source) for r in got) == [("sign_position", "fish", "initial", "p", "q"), ("site_language", None, None, "p", "r")]
    assert len({r.hypothesis_id for r in got}) == 2 and any("fish means meen [p]" in r.statement for r in got)
