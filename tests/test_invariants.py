"""Properties that hold whatever the corpus."""

import random

from pyspark.sql import functions as F

from seqweave.functions.exprs import kth_smallest
from seqweave.operators import compare, lm, measures, signif, strata, transforms


def corpus(spark, seed=42, n=300, letters="ABCDEFGH"):
    rng = random.Random(seed)
    rows = [(i, [rng.choice(letters[: 2 + i % 7]) for _ in range(rng.randrange(1, 9))], f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "seq_id long, symbols array<string>, site string")


def test_divergence_bounds(spark):
    x = corpus(spark)
    same = x.withColumn("site", F.lit("a")).unionByName(x.withColumn("site", F.lit("b")))
    d = compare.divergences(compare.stratum_pairs(measures.symbol_counts(same, ["site"]), "site")).first()
    assert abs(d.kl) < 1e-9 and abs(d.js) < 1e-9
    for r in compare.divergences(compare.stratum_pairs(measures.symbol_counts(x, ["site"]), "site")).collect():
        assert 0 <= r.js <= 1


def test_entropy_estimators(spark):
    rows = measures.estimators(measures.ngram_counts(corpus(spark), 1, 3, ["site"]), ["site"]).collect()
    assert all(r.miller_madow >= r.h >= 0 and r.chao_shen > 0 for r in rows)
    uniform = spark.createDataFrame([(i, [c]) for i, c in enumerate("ABCD" * 5)], "seq_id long, symbols array<string>").withColumn("g", F.lit(1))
    assert abs(measures.unigram_entropy(uniform, ["g"]).first().h_norm - 1) < 1e-9


def test_controls_keep_what_they_should(spark):
    x = corpus(spark)
    lengths = lambda d: sorted((r.seq_id, len(r.symbols)) for r in d.collect())
    for control in (transforms.relabel(x, "s"), transforms.noise(x, "s", 0.3), strata.drawn_from_frequencies(x, "s")):
        assert lengths(control) == lengths(x)
    p = signif.permuted(x.select("seq_id", F.col("site").alias("ctx"), "symbols"), "s", 2)
    assert [r.n for r in p.groupBy("rep", "ctx").agg(F.count("*").alias("n")).collect()] == [100] * 6
    code = transforms.bijection(x, "s").collect()
    assert len({r.sym for r in code}) == len({r.to for r in code}) == len(code)


def test_kth_smallest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-(10**12), 10**12), 7, 7]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    for k in (1, 2, 250, 499, 500):
        assert kth_smallest(df, "v", k) == sorted(values)[k - 1]
    assert kth_smallest(df, "v", 501) is None and kth_smallest(df.limit(0), "v", 1) is None


def test_model_probabilities(spark):
    model = lm.model(corpus(spark), ["site"])
    for r in model.where("kind = 'unigram'").groupBy("site").agg(F.sum("p").alias("p")).collect():
        assert abs(r.p - 1) < 1e-9
    assert lm.score(corpus(spark), lm.model(corpus(spark), [])).where("ll > 0").count() == 0


def test_mann_whitney_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    r = signif.mann_whitney(df, "g", "a", "b", "v").first()
    wins = sum((x > y) + 0.5 * (x == y) for x in (1, 2, 2) for y in (2, 3))
    assert r.u == wins
