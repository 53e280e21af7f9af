"""Association, co-occurrence, clustering and graphs over symbols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, ngrams, null_strata, ratio, tokens, top_per, unrolled
from seqweave.functions.tables import written
from seqweave.operators import graphs, similarity
from seqweave.operators.measures import symbol_counts, with_totals


@null_strata
def pmi(seq: DataFrame, by: list[str], min_count: int = 2, over: str = "bigrams", log: Callable[[Column], Column] = F.log2) -> DataFrame:
    """log p(ab) / (p(a) p(b)); p(ab) over bigrams or tokens, p(a) over tokens. The shuffles are on counts, not on the corpus."""
    pairs = bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt"))
    uni = symbol_counts(seq, by)
    n = F.greatest(F.size("symbols"), F.lit(0))
    totals = seq.groupBy(*by).agg(F.sum(n).alias("tokens"), F.sum(F.greatest(n - 1, F.lit(0))).alias("bigrams"))  # from lengths alone
    j = pairs.where(F.col("cnt") >= min_count).join(uni.select(*by, F.col("sym").alias("a"), F.col("cnt").alias("ca")), [*by, "a"]).join(uni.select(*by, F.col("sym").alias("b"), F.col("cnt").alias("cb")), [*by, "b"])
    j = with_totals(j, totals, by)
    return j.withColumn("pmi", log(F.col("cnt") / F.col(over) / (F.col("ca") / F.col("tokens") * F.col("cb") / F.col("tokens"))))


@null_strata
def followers(seq: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Top followers of each symbol with P(b | a) = count / count(a)."""
    pairs = bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt"))
    uni = symbol_counts(seq, by).select(*by, F.col("sym").alias("a"), F.col("cnt").alias("ca"))
    return top_per(pairs.join(uni, [*by, "a"]).withColumn("p", F.col("cnt") / F.col("ca")), [*by, "a"], [F.desc("cnt"), "b"], k)


@null_strata
def trigram_surplus(seq: DataFrame, by: list[str], least3: int = 3) -> DataFrame:
    """ln p(abc) / (p(ab) p(c)) in nats.

    Each token is counted once, with the two that follow it (null beyond the end),
    and the counts are written; those of pairs and single symbols are sums of them.
    """
    after = lambda k: F.slice("symbols", k, F.greatest(F.size("symbols"), F.lit(0)))
    each = unrolled(seq, F.arrays_zip(F.col("symbols").alias("a"), after(2).alias("b"), after(3).alias("c")), "_at", "g", *by)
    counts = written(each.groupBy(*by, "g.a", "g.b", "g.c").agg(F.count("*").alias("cnt")), "trigrams")
    t1 = counts.groupBy(*by, F.col("a").alias("c")).agg(F.sum("cnt").alias("c1"))
    t2 = counts.where("b IS NOT NULL").groupBy(*by, "a", "b").agg(F.sum("cnt").alias("c2"))
    t3 = counts.where("c IS NOT NULL").select(*by, "a", "b", "c", F.col("cnt").alias("c3"))
    n = counts.groupBy(*by).agg(F.sum("cnt").alias("n1"), F.sum(F.when(F.col("b").isNotNull(), F.col("cnt"))).alias("n2"), F.sum(F.when(F.col("c").isNotNull(), F.col("cnt"))).alias("n3"))
    j = with_totals(t3.where(F.col("c3") >= least3).join(t2, [*by, "a", "b"]).join(t1, [*by, "c"]), n, by)
    return j.withColumn("surplus", F.ln(F.col("c3") / F.col("n3") / (F.col("c2") / F.col("n2") * F.col("c1") / F.col("n1"))))


def centrality(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sum of |pmi| * count over both ends, partners, and the signed sum."""
    end = lambda a, b: F.struct(F.col(a).alias("sym"), F.col(b).alias("nb"))
    x = pairs.select(*by, "cnt", "pmi", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e"))
    return x.groupBy(*by, "e.sym").agg(F.sum(F.abs("pmi") * F.col("cnt")).alias("centrality"), F.count_distinct("e.nb").alias("partners"), F.sum(F.col("pmi") * F.col("cnt")).alias("weighted"))


def windowed_edges(seq: DataFrame, by: list[str], window: int, own: bool) -> DataFrame:
    """Undirected co-occurrence within so many places of a sequence: (a <= b, weight)."""
    s = seq.select(*by, "symbols")
    out = None
    for lag in range(1, window + 1):
        d = bigrams(s, lag)
        out = d if out is None else out.unionByName(d)
    e = out.select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = e if own else e.where("a <> b")
    return e.groupBy(*by, "a", "b").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """degree and strength of each node; a loop counts once in its degree."""
    both = edges.select(*by, "a", "b", "weight").unionByName(edges.where("a <> b").select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy(*by, F.col("a").alias("sym")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def bidirectional(seq: DataFrame, by: list[str]) -> DataFrame:
    """Pairs met in both orders, from one aggregation."""
    e = bigrams(seq.select(*by, "symbols")).where("a <> b")
    low = F.col("a") < F.col("b")
    g = e.groupBy(*by, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum(F.when(low, 1).otherwise(0)).alias("forth"), F.sum(F.when(low, 0).otherwise(1)).alias("back"))
    return g.where("forth > 0 AND back > 0")


@null_strata
def directed_edges(seq: DataFrame, by: list[str], min_freq: int = 2) -> DataFrame:
    """Adjacency edges between symbols of at least min_freq tokens."""
    keep = symbol_counts(seq, by).where(F.col("cnt") >= min_freq)
    e = bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("weight"))
    for end in ("a", "b"):
        e = e.join(keep.select(*by, F.col("sym").alias(end)), [*by, end], "left_semi")
    return e


def neighbour_jaccard(edges: DataFrame, by: list[str], least: float = 0.25) -> DataFrame:
    """Pairs of nodes whose neighbour sets overlap: shared / (deg + deg - shared)."""
    both = edges.where("a <> b").select(*by, "a", "b").unionByName(edges.where("a <> b").select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return similarity.jaccard_join(both.select(*by, F.col("a").alias("sym"), F.col("b").alias("feature")), by, least)


def paradigms(seq: DataFrame, by: list[str], blank: str = "_") -> DataFrame:
    """Stems with one slot left open: those of two or more distinct variants, over distinct sequences' rows. One shuffle on the stem; no pairs."""
    s = seq.select(*by, "symbols").where("size(symbols) >= 2")
    x = s.select(*by, "symbols", F.explode(F.sequence(F.lit(1), F.size("symbols"))).alias("slot"))
    stem = F.array_join(F.transform("symbols", lambda v, i: F.when(i + 1 == F.col("slot"), F.lit(blank)).otherwise(v)), " ")
    x = x.select(*by, "slot", F.size("symbols").alias("len"), stem.alias("stem"), F.element_at("symbols", F.col("slot")).alias("variant"))
    g = x.groupBy(*by, "len", "slot", "stem", "variant").agg(F.count("*").alias("n")).groupBy(*by, "len", "slot", "stem").agg(F.sum("n").alias("rows"), F.count("*").alias("variants"))
    return g.where("variants >= 2")


def formulae(seq: DataFrame, site: str, least: int = 2, most: int = 4, min_count: int = 3, k: int = 5) -> DataFrame:
    """Recurrent n-grams with their counts by site, the top sites, and a tier."""
    g = ngrams(seq.select(site, "symbols"), least, most).groupBy("n", "gram", site).agg(F.count("*").alias("here"))
    w = Window.partitionBy("n", "gram")
    g = g.withColumn("cnt", F.sum("here").over(w)).withColumn("sites", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("here"), site))).where(F.col("cnt") >= min_count)
    x = g.groupBy("n", "gram", "cnt", "sites").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", F.concat_ws(":", F.col(site), F.col("here").cast("string")).alias("s"))))), lambda v: v["s"]), ",").alias("top_sites"))
    return x.withColumn("tier", F.when((F.col("cnt") >= 20) & (F.col("sites") >= 3), "HIGH").when(F.col("cnt") >= 8, "MEDIUM").otherwise("LOW"))


def concordance(seq: DataFrame, query: str, width: int = 5) -> DataFrame:
    """Keyword in context within sequences: (seq_id, pos, left, right)."""
    hits = F.filter(F.sequence(F.lit(1), F.size("symbols")), lambda i: F.element_at("symbols", i) == query)
    x = seq.where(F.array_contains("symbols", query)).select("seq_id", "symbols", F.explode(hits).alias("i"))
    start = F.greatest(F.col("i") - width, F.lit(1))
    return x.select("seq_id", (F.col("i") - 1).cast("long").alias("pos"), F.array_join(F.slice("symbols", start, F.col("i") - start), " ").alias("left"), F.array_join(F.slice("symbols", F.col("i") + 1, F.lit(width)), " ").alias("right"))


@null_strata
def context_vectors(seq: DataFrame, by: list[str], window: int = 1, min_freq: int = 1, places: bool = False) -> DataFrame:
    """Sparse vectors (sym, feature, w): left and right neighbours at each distance up to the window.

    With places, also how often a symbol stands first, last or between; the only one
    of a sequence is first and last. Symbols without neighbours have those alone.
    """
    s, out = seq.select(*by, "symbols"), None
    for lag in range(1, window + 1):
        p = bigrams(s, lag).select(*by, F.explode(F.array(F.struct(F.col("a").alias("sym"), F.concat(F.lit("R:"), "b").alias("feature")), F.struct(F.col("b").alias("sym"), F.concat(F.lit("L:"), "a").alias("feature")))).alias("p")).select(*by, "p.*")
        out = p if out is None else out.unionByName(p)
    if places:
        first, last = F.col("pos") == 0, F.col("pos") == F.col("len") - 1
        at = F.array_compact(F.array(F.when(first, F.lit("P:initial")), F.when(last, F.lit("P:terminal")), F.when(~first & ~last, F.lit("P:medial"))))
        out = out.unionByName(tokens(s).select(*by, "sym", F.explode(at).alias("feature")))
    v = out.groupBy(*by, "sym", "feature").agg(F.count("*").alias("w"))
    if min_freq > 1:
        v = v.join(symbol_counts(seq, by).where(F.col("cnt") >= min_freq).select(*by, "sym"), [*by, "sym"], "left_semi")
    return v


def cosine_pairs(vectors: DataFrame, by: list[str], least: float = 0.1) -> DataFrame:
    """Cosine of all pairs over the threshold, by a join on the features that can lead there."""
    return similarity.cosine_join(vectors, by, least)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sym, cluster): the least symbol reachable. Labels spread and jump each round, which is written."""
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    label = nodes.select("sym", F.col("sym").alias("cluster"))
    both = written(both)
    while True:
        near = both.join(label.withColumnRenamed("sym", "y"), "y").groupBy("x").agg(F.min("cluster").alias("low"))
        hooked = label.join(near, label.sym == near.x, "left").select("sym", F.least("cluster", F.coalesce("low", "cluster")).alias("cluster"), F.col("cluster").alias("old"))
        jump = hooked.select(F.col("sym").alias("cluster"), F.col("cluster").alias("up"))
        new = written(hooked.join(jump, "cluster", "left").select("sym", F.least("cluster", F.coalesce("up", "cluster")).alias("cluster"), "old"))
        if new.where("cluster <> old").isEmpty():
            return new.select("sym", "cluster")
        label = new.select("sym", "cluster")


def label_propagation(edges: DataFrame, by_weight: str = "weight", rounds: int = 20) -> DataFrame:
    """Communities by synchronous label propagation: each node takes the label of most weight around it, the least symbol on ties.

    Until no label changes, or so many rounds.
    """
    both = written(edges.where("a <> b").select("a", "b", by_weight).unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), by_weight)))
    label = both.select(F.col("a").alias("sym")).distinct().withColumn("label", F.col("sym"))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("sym", "b"), "b").groupBy("a", "label").agg(F.sum(by_weight).alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("nw"), "label")).alias("m"))
        new = written(best.select(F.col("a").alias("sym"), F.col("m.label").alias("label")))
        if new.join(label, ["sym", "label"], "left_anti").isEmpty():
            return new
        label = new
    return label


def dominant_slot(edges: DataFrame, by: list[str]) -> DataFrame:
    """out / (in + out) weight: over .65 INITIAL, under .35 TERMINAL, else MEDIAL."""
    x = edges.select(*by, F.explode(F.array(F.struct(F.col("a").alias("sym"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("b").alias("sym"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i")))).alias("e"))
    g = x.groupBy(*by, "e.sym").agg(F.sum("e.o").alias("out_w"), F.sum("e.i").alias("in_w"))
    share = ratio(F.col("out_w"), F.col("out_w") + F.col("in_w"))
    return g.withColumn("share", share).withColumn("slot", F.when(share > 0.65, "INITIAL").when(share < 0.35, "TERMINAL").otherwise("MEDIAL"))


@null_strata
def features(seq: DataFrame, by: list[str]) -> DataFrame:
    """A row of features per symbol: log frequency, rates, in and out degree, entropies of neighbours, strength."""
    from seqweave.operators.positions import position_entropy, start_end_counts

    base = position_entropy(start_end_counts(seq, by))
    e = written(bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("w")), "pairs")
    ent = lambda end, name: e.groupBy(*by, F.col(end).alias("sym")).agg(F.count("*").alias(f"{name}_degree"), (F.log2(F.sum(F.col("w").cast("double"))) - F.sum(F.col("w") * F.log2(F.col("w").cast("double"))) / F.sum("w")).alias(f"{name}_entropy"), F.sum("w").alias(f"{name}_strength"))
    j = base.join(ent("a", "out"), [*by, "sym"], "left").join(ent("b", "in"), [*by, "sym"], "left").fillna(0)
    return j.withColumn("log_freq", F.ln(F.col("n") + 1.0))


def betweenness(edges: DataFrame, batch: int = 512) -> DataFrame:
    """Betweenness of an unweighted, undirected graph of symbols: all lengths are 1, so a bucket of distances is a level."""
    return graphs.betweenness(edges.select("a", "b", F.lit(1).alias("length")), batch=batch, delta=1)


def top_states(seq: DataFrame, by: list[str], vocab: int) -> tuple[DataFrame, DataFrame]:
    """Counts of each stratum's symbols, and (by, sym, known) of its most frequent ones; the others' state is OTHER."""
    counts = symbol_counts(seq, by)
    return counts, top_per(counts, by, [F.desc("cnt"), "sym"], vocab).select(*by, "sym", F.lit(True).alias("known"))


@null_strata
def spectral_gap(seq: DataFrame, by: list[str], vocab: int = 200) -> DataFrame:
    """1 - |second eigenvalue| of each stratum's transition matrix over its top symbols and OTHER.

    Counts are made on Spark; a group holds at most (vocab + 1) squared counts.
    """
    _, top = top_states(seq, by, vocab)
    e = bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt"))
    for end in ("a", "b"):
        e = e.join(top.withColumnsRenamed({"sym": end, "known": f"k{end}"}), [*by, end], "left").withColumn(end, F.when(F.col(f"k{end}"), F.col(end)).otherwise("OTHER"))
    return transition_gaps(e.groupBy(*by, "a", "b").agg(F.sum("cnt").alias("cnt")), by)


def transition_gaps(e: DataFrame, by: list[str]) -> DataFrame:
    """(by, states, first, second, gap) of each stratum's counts (by, a, b, cnt) of transitions."""
    import numpy as np
    import pandas as pd

    def fn(key, pdf):  # noqa: ANN001, ANN202
        names = sorted(set(pdf.a) | set(pdf.b))
        at = {v: i for i, v in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf.a, pdf.b, pdf.cnt, strict=True):
            m[at[a], at[b]] = c
        sums = m.sum(1, keepdims=True)
        m = np.divide(m, sums, out=np.full_like(m, 1 / len(names)), where=sums > 0)
        size = np.sort(np.abs(np.linalg.eigvals(m)))[::-1]
        return pd.DataFrame([(*key, len(names), float(size[0]), float(size[1]) if len(size) > 1 else 0.0)], columns=[*by, "states", "first", "second"]).assign(gap=lambda d: 1 - d.second)

    kinds = dict(e.dtypes)
    return e.select(*by, "a", "b", "cnt").groupBy(*by).applyInPandas(fn, ", ".join(f"{b} {kinds[b]}" for b in by) + ", states long, first double, second double, gap double")
