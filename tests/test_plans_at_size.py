"""Plans that only fail on large tables: what the planner guesses to be small must not go through the driver."""

from pyspark.sql import functions as F

from seqweave.functions import exprs
from seqweave.functions.tables import written
from seqweave.operators import automaton, evidence, measures, positions, signif, strata, transforms, zones
from seqweave.sources import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_not_broadcast(spark):
    seq = spark.range(2000).select(F.col("id").alias("seq_id"), (F.col("id") % 3).cast("string").alias("ctx"), F.array(F.lit("a"), F.lit("b")).alias("symbols"))
    for df in (signif.permuted(written(seq), "s", 5), zones.shuffle_globally(written(seq), "s", ["ctx"])):
        assert not any("BroadcastHashJoin" in x and "rank#" in x.split("]")[0] for x in plan(df).splitlines())
        assert any("SortMergeJoin" in x and "rank#" in x for x in plan(df).splitlines())


def test_dealt_sequences_are_not_joined_back(spark):
    seq = spark.range(50).select(F.col("id").alias("seq_id"), (F.col("id") % 3).cast("string").alias("ctx"), F.array(F.lit("a"), F.lit("b"), F.col("id").cast("string")).alias("symbols"))
    lean, wide = zones.shuffle_globally(seq, "s", ["ctx"]), zones.shuffle_globally(seq.withColumn("more", F.lit(1)), "s", ["ctx"])
    assert lean.columns == ["seq_id", "ctx", "symbols"] and wide.columns == ["seq_id", "ctx", "more", "symbols"]
    assert sorted(lean.collect()) == sorted(wide.select(lean.columns).collect())
    assert plan(lean).count("SortMergeJoin") < plan(wide).count("Join")


def test_phrases_read_sequences_once(spark):
    seq = spark.range(20).select(F.col("id").alias("seq_id"), F.array(*[F.lit(x) for x in "abcdefghij"]).alias("symbols"))
    words = spark.range(60_000).select(F.concat_ws(" ", F.lpad(F.col("id").cast("string"), 40, "w")).alias("word"), F.lit("m").alias("meaning"))
    long = spark.createDataFrame([("a b c d e f g h i j", "all"), ("b c d e f g h i", "most"), ("b c d e f g h i x", "no"), ("j", "one")], "word string, meaning string")
    found = automaton.phrase_matches(seq, words.unionByName(long))  # 2 MB of words
    assert "MapInArrow" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [("a b c d e f g h i j", "all", 20, 20), ("b c d e f g h i", "most", 20, 20), ("j", "one", 20, 20)]


def test_arrays_are_made_once(spark):
    seq = spark.range(50).select(F.col("id").alias("seq_id"), F.lit("x").alias("lang"), F.array(F.lit("a"), F.col("id").cast("string")).alias("symbols"))
    shuffled = transforms.shuffle_within(seq, "s", 3)
    for df in (positions.rates(shuffled, ["rep"]), exprs.bigrams(shuffled), exprs.ngrams(shuffled, 2, 3), measures.symbol_counts(shuffled)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    read = adapters.lines(spark, "/root/testdata/sf0.001")
    assert exprs.tokens(read)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_roles_need_no_window(spark):
    seq = spark.createDataFrame([(1, "x", ["a", "a", "b"]), (2, "x", ["b"]), (3, "x", [])], "seq_id long, lang string, symbols array<string>")
    found = strata.roles(seq, ["lang"])
    assert "Window" not in plan(found)
    assert sorted((r.sym, r.n, r.roles) for r in found.collect()) == [("a", 2, "determinative,numeral"), ("b", 2, "suffix,determinative,logogram")]


def test_streams_and_summaries_read_sequences_once(spark):
    seq = spark.range(60).select(F.col("id").alias("seq_id"), F.lit("x").alias("lang"), F.array(F.lit("a"), F.col("id").cast("string"), F.lit("c")).alias("symbols"))
    for df in (measures.stream_ngram_counts(seq, 1, 3, ["lang"]), measures.corpus_summary(seq, ["lang"]), measures.template_coverage(seq, ["lang"]), zones.allographs(seq)):
        assert "Range (" not in plan(df)


def test_counts_of_templates_are_not_in_a_window(spark):
    seq = spark.range(60).select(F.col("id").alias("seq_id"), F.lit("x").alias("lang"), F.array(F.lit("a"), F.lit("b"), F.col("id").cast("string")).alias("symbols"))
    found = measures.template_coverage(seq, ["lang"])
    assert "Window" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("x", 60, 1, 1.0)]


def test_kmeans_reads_features_once(spark):
    f = spark.range(30).select(F.col("id").cast("string").alias("sym"), (F.col("id") % 3 * 10 + F.rand(1)).alias("u"), F.col("id").cast("double").alias("v"))
    found = strata.kmeans(f, ["u", "v"], [2, 3])
    assert "Range (" not in plan(found) and found.count() == 60


def test_postings_are_counted_within_rows(spark):
    rows = spark.createDataFrame([(1, "abc abc xyz"), (1, "abc"), (2, "xyz, one"), (3, None), (4, "a b")], "doc_id long, text string")
    found = written(evidence.bags(rows, ["doc_id"], "text"))
    assert sorted((r.doc_id, r.n, [tuple(b) for b in r.bag]) for r in found.collect()) == [(1, 4, [("abc", 3), ("xyz", 1)]), (2, 2, [("one", 1), ("xyz", 1)])]
    terms = evidence.idfs(found, 5)
    for most in (0, 1, 2, 100):  # none, some and all terms are common
        x = evidence.with_idf(evidence.in_bags(found, "doc_id"), terms, most)
        assert "Window" not in plan(x)
        assert sorted((r.doc_id, r.term, r.tf, r.df) for r in x.collect()) == [(1, "abc", 0.75, 1), (1, "xyz", 0.25, 2), (2, "one", 0.5, 1), (2, "xyz", 0.5, 2)]
