"""Recodings, per-corpus signatures and comparisons of symbol classes that build on the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, entropy, ngrams, null_strata, ratio, tokens, unrolled
from seqweave.functions.tables import written
from seqweave.operators import assoc, similarity
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators.transforms import hashed


def variant_stats(seq: DataFrame, variants: DataFrame) -> DataFrame:
    """Types, tokens and hapax before and after variants (sym, to) are merged; one row for each."""
    c = m.symbol_counts(seq)
    after = c.join(variants, "sym", "left").groupBy(F.coalesce("to", "sym").alias("sym")).agg(F.sum("cnt").alias("cnt"))
    one = lambda d, name: d.agg(F.lit(name).alias("stage"), F.count("*").alias("types"), F.sum("cnt").alias("tokens"), F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).alias("hapax"))
    return one(c, "before").unionByName(one(after, "after"))


def map_rate(seq: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """Share of tokens that a mapping (sym, to) knows; from counts."""
    c = m.symbol_counts(seq, by).join(mapping.select("sym", F.lit(1).alias("known")), "sym", "left")
    return c.groupBy(*by).agg(F.sum("cnt").alias("tokens"), (F.sum(F.when(F.col("known") == 1, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("map_rate"))


def drawn_from_frequencies(seq: DataFrame, seed: str, width: int = 64, block: int = 1 << 16) -> DataFrame:
    """An i.i.d. control with the sequences' lengths: each token is drawn by a hash from the cumulative frequencies.

    Symbols have intervals of the numbers from 0 to the corpus's tokens; a token's
    number is looked up in cells of so many numbers, which intervals are cut into
    in two steps. No task holds the vocabulary, and no symbol is an array of its cells.
    """
    c = m.symbol_counts(seq).withColumn("_p", F.substring("sym", 1, 2))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = c.groupBy("_p").agg(F.sum("cnt").alias("_n")).select("_p", before.alias("_b"))
    upto = F.col("_b") + F.sum("cnt").over(Window.partitionBy("_p").orderBy("sym").rowsBetween(Window.unboundedPreceding, 0))
    v = c.join(cells, "_p").select("sym", "cnt", upto.alias("upto")).withColumn("low", F.col("upto") - F.col("cnt"))
    first, last = F.floor(F.col("low") / width), F.floor((F.col("upto") - 1) / width)
    v = v.withColumn("k", F.explode(F.sequence(first, last, F.lit(block).cast("long")))).withColumn("cell", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + block - 1, last))))
    n = c.agg(F.sum("cnt").alias("_n"))
    number = F.floor(F.conv(F.substring(hashed(seed, F.col("seq_id"), F.col("pos")), 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("_n"))
    t = tokens(seq.select("seq_id", "symbols")).select("seq_id", "pos").crossJoin(F.broadcast(n)).withColumn("u", number).withColumn("cell", F.floor(F.col("u") / width))
    found = t.join(v.select("cell", "low", "upto", "sym"), "cell").where("low <= u AND u < upto")
    x = found.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sym"))).alias("x")).select("seq_id", F.col("x.sym").alias("symbols"))
    return seq.drop("symbols").join(x, "seq_id")


def shuffled_letters(df: DataFrame, word: str, seed: str) -> DataFrame:
    """Each word's letters in a hashed order."""
    keyed = F.transform(F.split(word, ""), lambda c, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(word), i.cast("string")).cast("binary")).alias("h"), c.alias("c")))
    return df.withColumn("shuffled", F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), ""))


@null_strata
def signature(seq: DataFrame, by: list[str]) -> DataFrame:
    """tokens, types, alpha, r2, e2, e3, h1 and its norm per corpus: one join of per-corpus rows."""
    uni = m.unigram_entropy(seq, by).select(*by, F.col("n").alias("tokens"), "types", F.col("h_norm").alias("h1_norm"))
    z = m.zipf(seq, by).select(*by, "alpha", "r2")
    e = m.higher_orders(m.block_entropy(m.ngram_counts(seq, 1, 3, by), by), by)
    return uni.join(z, by).join(e, by)


@null_strata
def substitution_pairs(seq: DataFrame, by: list[str]) -> DataFrame:
    """(by, pairs, comparable, rate): sequences of one length, two or more, that differ in one place, over all pairs of one length.

    Pairs are counted, not formed: rows with one stem and different symbols in its slot.
    """
    s = seq.select(*by, "symbols").where("size(symbols) >= 2")
    x = s.select(*by, "symbols", F.explode(F.sequence(F.lit(1), F.size("symbols"))).alias("slot"))
    stem = F.transform("symbols", lambda v, i: F.when(i + 1 != F.col("slot"), v))
    g = x.groupBy(*by, stem.alias("stem"), F.element_at("symbols", F.col("slot")).alias("v")).agg(F.count("*").cast("double").alias("n")).groupBy(*by, "stem").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    pairs = g.groupBy(*by).agg(((F.sum(F.col("n") * F.col("n") - F.col("nn"))) / 2).alias("pairs"))
    c = s.groupBy(*by, F.size("symbols").alias("len")).agg(F.count("*").cast("double").alias("n")).groupBy(*by).agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias("comparable"))
    return m.with_totals(pairs, c, by).withColumn("rate", ratio(F.col("pairs"), F.greatest(F.col("comparable"), F.lit(1.0))))


def polyvalent(seq: DataFrame, by: list[str], least: int = 3, score: float = 0.15) -> DataFrame:
    """(by, symbols, polyvalent, share): symbols of enough tokens, and those whose positions have two peaks or more and a score."""
    k = p.multimodality(seq, by).where(F.col("n") >= least)
    hit = (F.col("n_peaks") >= 2) & (F.round("score", 9) >= score)
    return k.groupBy(*by).agg(F.count("*").alias("symbols"), F.sum(F.when(hit, 1).otherwise(0)).alias("polyvalent"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("share"))


@null_strata
def fingerprint(seq: DataFrame, by: list[str]) -> DataFrame:
    """Ten structural dimensions: H1 over log2 V, H2 / 2 over H1, Zipf slope, type-token and hapax shares, mean positional entropy, polyvalent share, mean length, variance of the boundary bias, one-substitution rate."""
    s = m.corpus_summary(seq, by).select(*by, "h1", "h2", "ttr", "hapax_share", "types")
    z = m.zipf(seq, by).select(*by, "alpha")
    e = p.multimodality(seq, by).where("n >= 3").groupBy(*by).agg(F.avg("entropy").alias("pos_entropy"))
    q = p.four_way_counts(seq, by).where("n >= 3").groupBy(*by).agg(F.var_pop((F.col("initial") + F.col("terminal")) / F.col("n")).alias("bias_var"))
    n = m.length_stats(seq, by).select(*by, "mean_len")
    poly = polyvalent(seq, by).select(*by, F.col("share").alias("polyvalent_share"))
    pairs = substitution_pairs(seq, by).select(*by, F.col("rate").alias("substitution_rate"))
    j = s.join(z, by).join(e, by).join(q, by).join(n, by).join(poly, by).join(pairs, by, "left").fillna(0.0, ["substitution_rate"])
    return j.select(*by, (F.col("h1") / F.log2(F.col("types").cast("double"))).alias("h1_norm"), (F.col("h2") / 2 / F.col("h1")).alias("h2_ratio"), "alpha", "ttr", "hapax_share", "pos_entropy", "polyvalent_share", "mean_len", "bias_var", "substitution_rate")


def against_labels(classed: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy of classes against labels (sym, label), by label."""
    return classed.join(labels, "sym").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.when(F.col("class") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))


@null_strata
def roles(seq: DataFrame, by: list[str]) -> DataFrame:
    """Roles of symbols by rates, solo and repeat shares, concentration and PMI of their pairs; a symbol may have several."""
    from seqweave.operators.assoc import pmi

    seq = written(seq.select(*by, "symbols"), "sequences")
    follow = F.arrays_zip(F.col("symbols").alias("sym"), F.slice("symbols", F.lit(2), F.greatest(F.size("symbols"), F.lit(0))).alias("next"))
    t = unrolled(seq, follow, "pos", "p", *by, F.size("symbols").alias("len")).select(*by, "len", "pos", "p.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)) / F.count("*")
    last, first = F.col("pos") == F.col("len") - 1, F.col("pos") == 0
    g = t.groupBy(*by, "sym").agg(F.count("*").alias("n"), n(first).alias("i"), n(last).alias("t"), n(F.col("len") == 1).alias("solo"), n(F.col("next") == F.col("sym")).alias("rep"))
    bound = pmi(seq, by, 5).where("pmi >= 4")
    ends = bound.select(*by, F.explode(F.array("a", "b")).alias("sym")).distinct().withColumn("bound", F.lit(True))
    j = g.join(ends, [*by, "sym"], "left")
    found = [(F.col("t") >= 0.5, "suffix"), (F.col("i") >= 0.5, "determinative"), (F.col("rep") >= 0.1, "numeral"), (F.col("solo") >= 0.3, "logogram"), (F.coalesce("bound", F.lit(False)), "compound")]
    r = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in found]))
    return j.select(*by, "sym", "n", F.array_join(F.when(F.size(r) > 0, r).otherwise(F.array(F.lit("phonetic"))), ",").alias("roles"))


def label_hits(seq: DataFrame, initial: DataFrame, terminal: DataFrame) -> DataFrame:
    """Mean of the shares of initial labels' tokens at a start and of terminal labels' tokens at an end; from counts by symbol, so labels may be any number."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = tokens(seq.select("symbols")).groupBy("sym").agg(F.count("*").alias("n"), n(F.col("pos") == 0).alias("first"), n(F.col("pos") == F.col("len") - 1).alias("last"))
    i = c.join(initial.select("sym").distinct(), "sym", "left_semi").agg((F.sum("first") / F.sum("n")).alias("i"))
    e = c.join(terminal.select("sym").distinct(), "sym", "left_semi").agg((F.sum("last") / F.sum("n")).alias("t"))
    return i.crossJoin(F.broadcast(e)).select(F.col("i").alias("initial_hit"), F.col("t").alias("terminal_hit"), ((F.col("i") + F.col("t")) / 2).alias("score"))


def cluster_profile(seq: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    """Pooled start, end and internal rates of each cluster (sym, cluster)."""
    c = p.start_end_counts(seq, by).join(clusters, "sym")
    g = c.groupBy(*by, "cluster").agg(F.count("*").alias("types"), *[F.sum(k).alias(k) for k in ("n", "n_start", "n_end", "n_internal")])
    return g.select(*by, "cluster", "types", "n", *[(F.col(f"n_{k}") / F.col("n")).alias(f"{k}_rate") for k in ("start", "end", "internal")])


@null_strata
def interaction_information(seq: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """log2 p(abc) / (p(a) p(b) p(c)) of trigrams."""
    t3 = ngrams(seq.select(*by, "symbols"), 3, joined=False).groupBy(*by, "gram").agg(F.count("*").alias("cnt"))
    uni = m.symbol_counts(seq, by)
    n = m.with_totals(t3.groupBy(*by).agg(F.sum("cnt").alias("n3")), uni.groupBy(*by).agg(F.sum("cnt").alias("n1")), by)
    x = t3.where(F.col("cnt") >= least)
    for i, end in enumerate("abc"):
        x = x.withColumn(end, F.get("gram", F.lit(i))).join(uni.select(*by, F.col("sym").alias(end), F.col("cnt").alias(f"c{end}")), [*by, end])
    x = m.with_totals(x, n, by)
    p = lambda end: F.col(f"c{end}") / F.col("n1")
    return x.select(*by, "a", "b", "c", "cnt", F.log2(F.col("cnt") / F.col("n3") / (p("a") * p("b") * p("c"))).alias("i3"))


@null_strata
def context_shares(seq: DataFrame, by: list[str], side: str = "right") -> DataFrame:
    """(by, sym, feature, w): the shares of each symbol's neighbours on one side."""
    a, b = ("a", "b") if side == "right" else ("b", "a")
    v = bigrams(seq.select(*by, "symbols")).groupBy(*by, F.col(a).alias("sym"), F.col(b).alias("feature")).agg(F.count("*").alias("c"))
    return v.join(v.groupBy(*by, "sym").agg(F.sum("c").alias("total")), [*by, "sym"]).select(*by, "sym", "feature", (F.col("c") / F.col("total")).alias("w"))


@null_strata
def context_divergence(seq: DataFrame, by: list[str], side: str = "right", most: float | None = None) -> DataFrame:
    """JS divergence in bits between the contexts of symbols; of all pairs that share one, or of those up to most.

    With common contexts c only: JS = 1 + (sum over c of p log2 p/(p+q) + q log2 q/(p+q)) / 2;
    a context of one side alone adds p log2 (p / (p / 2)) / 2 = p / 2, in sum 1 less what is shared.
    Without most, the result is as large as the pairs that share a context.
    """
    v = context_shares(seq, by, side)
    if most is not None:
        return similarity.divergence_join(v, by, most)
    x, y = (v.select(*by, F.col("sym").alias(k), "feature", F.col("w").alias(f"w{k}")) for k in ("x", "y"))
    both = F.col("wx") + F.col("wy")
    term = F.col("wx") * F.log2(F.col("wx") / both) + F.col("wy") * F.log2(F.col("wy") / both)
    return x.join(y, [*by, "feature"]).where("x < y").groupBy(*by, "x", "y").agg((1 + 0.5 * F.sum(term)).alias("js"))


def context_groups(seq: DataFrame, by: list[str], most: float, side: str = "right") -> DataFrame:
    """(by, sym, cluster): single linkage of symbols whose contexts diverge by at most so much; a symbol without such a partner is alone."""
    node = lambda c: F.struct(*by, F.col(c).alias("sym"))
    pairs = context_divergence(seq, by, side, most).select(node("x").alias("x"), node("y").alias("y"))
    found = assoc.components(pairs, m.symbol_counts(seq, by).select(node("sym").alias("sym")))
    return found.select(*[f"sym.{c}" for c in by], "sym.sym", F.col("cluster.sym").alias("cluster"))


def grid(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Symbols in each cell of two clusterings (sym, cluster)."""
    j = rows.select("sym", F.col("cluster").alias("row")).join(columns.select("sym", F.col("cluster").alias("col")), "sym")
    return j.groupBy("row", "col").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("sym")), ",").alias("symbols"))


def kmeans(features: DataFrame, columns: list[str], ks: list[int], seed: int = 7) -> DataFrame:
    """(k, sym, cluster, silhouette) of MLlib's k-means over standardised features."""
    from functools import reduce

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    # every round of the fits reads the features
    x = VectorAssembler(inputCols=columns, outputCol="raw").transform(written(features.select("sym", *columns), "features"))
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    out = []
    for k in ks:
        fitted = KMeans(k=k, seed=seed).fit(x).transform(x)
        one = fitted.select("prediction").distinct().limit(2).count() < 2
        score = 0.0 if one else ClusteringEvaluator().evaluate(fitted)
        out.append(fitted.select(F.lit(k).alias("k"), "sym", F.col("prediction").alias("cluster"), F.lit(score).alias("silhouette")))
    return reduce(DataFrame.unionByName, out)


def slots_by_corpus(seq: DataFrame, by: list[str]) -> DataFrame:
    """Shares of initial, medial and terminal tokens."""
    t = tokens(seq.select(*by, "symbols"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)) / F.count("*")
    return t.groupBy(*by).agg(n(F.col("pos") == 0).alias("i_share"), n((F.col("pos") > 0) & (F.col("pos") < F.col("len") - 1)).alias("m_share"), n((F.col("pos") == F.col("len") - 1) & (F.col("len") > 1)).alias("t_share"))


@null_strata
def corpus_table(seq: DataFrame, by: list[str], drop: str = "?") -> DataFrame:
    """Sequences, tokens, types and mean length, placeholders left out."""
    s = seq.withColumn("symbols", F.array_remove("symbols", drop)).where("size(symbols) > 0")
    c = m.symbol_counts(s, by).groupBy(*by).agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"), (F.count("*") / F.sum("cnt")).alias("ttr"), F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).alias("hapax"))
    return s.groupBy(*by).agg(F.count("*").alias("sequences"), F.avg(F.size("symbols")).alias("mean_len")).join(c, by)


def terminal_test(seq: DataFrame, group: Column) -> DataFrame:
    """Chi-squared of the 2 x 2 table (symbol in the group, at an end), with p = exp(-chi2 / 2)."""
    t = tokens(seq.select("symbols")).agg(*[F.sum(F.when(g & e, 1).otherwise(0)).cast("double").alias(n) for n, g, e in (("a", group, F.col("pos") == F.col("len") - 1), ("b", group, F.col("pos") < F.col("len") - 1), ("c", ~group, F.col("pos") == F.col("len") - 1), ("d", ~group, F.col("pos") < F.col("len") - 1))])
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    chi = ratio(n * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    return t.select(n.cast("long").alias("n"), chi.alias("chi2"), F.exp(-chi / 2).alias("p"))


def crosstab_entropy(seq: DataFrame, context: str, least: int = 5) -> DataFrame:
    """Initial symbols by context: counts, entropy over log2 of the number of contexts, whether it is restricted (under .5)."""
    x = seq.where("size(symbols) > 0").select(F.get("symbols", F.lit(0)).alias("sym"), F.col(context).alias("ctx")).groupBy("sym", "ctx").agg(F.count("*").alias("cnt"))
    k = seq.select(context).distinct().count()
    e = entropy(x, ["sym"]).where(F.col("n") >= least)
    h = F.col("h") / F.log2(F.lit(float(max(k, 2))))
    return e.select("sym", "n", F.col("types").alias("contexts"), h.alias("h_norm"), (h < 0.5).alias("restricted"))


def merged(results: dict[str, DataFrame]) -> DataFrame:
    """One-row results side by side, each one's columns under its name."""
    out = None
    for name, d in results.items():
        # an aggregate over all rows is one row; a second one is an error
        lone = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{name} has several rows"))).otherwise(F.first(F.struct(*d.columns)))
        one = d.agg(lone.alias("r")).select(*[F.col(f"r.{c}").alias(f"{name}_{c}") for c in d.columns])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def binomial_z(hits: Column, n: Column, p: Column) -> Column:
    """z of a share of hits against a null rate."""
    return F.when((n > 0) & (p > 0) & (p < 1), (hits / n - p) / F.sqrt(p * (1 - p) / n)).otherwise(0.0)


def one_to_one(scores: DataFrame) -> DataFrame:
    """Mutual-best pairs (x, y, score, round): each round pairs those that prefer each other and removes them, until none is left.

    The best pair of all that are left is always mutual, so every round ends with
    fewer. Bests are aggregations that combine before they shuffle, not windows.
    """
    out, left, r = None, written(scores.select("x", "y", "score")), 0
    while True:
        r += 1
        order = F.struct((-F.col("score")).alias("s"), "x", "y")
        best = lambda c: left.groupBy(c).agg(F.min(order).alias("m")).select("m.x", "m.y", (-F.col("m.s")).alias("score"))  # noqa: B023, E731
        got = written(best("x").join(best("y").select("x", "y"), ["x", "y"]).select("x", "y", "score", F.lit(r).alias("round")))
        out = got if out is None else out.unionByName(got)
        if got.isEmpty():
            return out
        left = written(left.join(got.select("x"), "x", "left_anti").join(got.select("y"), "y", "left_anti").select("x", "y", "score"))


def segment_search(names: DataFrame, key: str, text: str, patterns: list[tuple[str, int]], sep: str = "-", k: int = 10, lengths: tuple[int, int] | None = None) -> DataFrame:
    """Names by segments, of a number of segments within lengths if given: 2 for a pattern's segment at its place, 1 elsewhere; top k."""
    s = names.select(key, F.split(text, sep).alias("s"))
    s = s.where(F.size("s").between(*lengths)) if lengths else s
    at = lambda w, i: F.when(F.get("s", F.lit(i)) == w, 2).when(F.array_contains("s", w), 1).otherwise(0)
    score = sum((at(w, i) for w, i in patterns), F.lit(0))
    return s.withColumn("score", score).where("score > 0").select(key, "score").orderBy(F.desc("score"), key).limit(k)

