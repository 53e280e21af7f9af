"""Counting and corpus-level measures over sequences; each takes grouping columns, so one job serves all strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, correlation, entropy, join_small, ngrams, null_strata, ranked, ratio, tokens, unrolled
from seqweave.functions.tables import written


def symbol_counts(seq: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return unrolled(seq, "symbols", "_at", "sym", *by).groupBy(*by, "sym").agg(F.count("*").alias("cnt"))


def with_totals(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """rows with the totals of their group; without groups the one row of totals is attached to all."""
    return join_small(rows, totals, by, "inner") if by else rows.crossJoin(F.broadcast(totals))


@null_strata
def frequency(seq: DataFrame, by: list[str], min_count: int = 1) -> DataFrame:
    """Counts of symbols of at least min_count; total_tokens is counted before that filter."""
    counts = symbol_counts(seq, by)
    return with_totals(counts, counts.groupBy(*by).agg(F.sum("cnt").alias("total_tokens")), by).where(F.col("cnt") >= min_count)


@null_strata
def rank_frequency(seq: DataFrame, by: list[str]) -> DataFrame:
    counts = symbol_counts(seq, by)
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("total"))
    return ranked(counts, by).join(totals, by).withColumn("freq", F.col("cnt") / F.col("total"))


def ngram_counts(seq: DataFrame, least: int, most: int | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    return ngrams(seq.select(*by, "symbols"), least, most).groupBy(*by, "n", "gram").agg(F.count("*").alias("cnt"))


def stream_ngram_counts(seq: DataFrame, least: int, most: int, by: list[str], order: str = "seq_id", cells: int = 1024) -> DataFrame:
    """n-grams of the flat stream of each group: those within sequences and those over their ends.

    A sequence's last most-1 symbols are set before the heads of the sequences that
    follow it. The whole-number order is cut into equal cells, and followers are
    looked up within the cell; the first heads of each cell, a small table, stand
    in for what follows its last sequences. So no group is in one task.
    """
    k = most - 1
    seq = written(seq.select(*by, order, "symbols"), "stream")
    low, high = seq.agg(F.min(order), F.max(order)).first()
    if k == 0 or low is None:
        return ngram_counts(seq, least, most, by)
    width = (high - low) // cells + 1
    joined = lambda arrays: F.slice(F.flatten(F.filter(F.array(*arrays), lambda x: x.isNotNull())), 1, k)
    x = seq.select(*by, order, "symbols", F.expr(f"(`{order}` - {low}L) DIV {width}L").alias("_cell"), F.slice("symbols", 1, k).alias("_head"))
    w = Window.partitionBy(*by, "_cell").orderBy(order)
    x = x.withColumn("_next", joined([F.lead("_head", i).over(w) for i in range(1, k + 1)])).withColumn("_r", F.row_number().over(w))
    heads = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_head"))), lambda h: h["_head"]))
    firsts = x.where(F.col("_r") <= k).groupBy(*by, "_cell").agg(F.slice(heads, 1, k).alias("_heads"))
    wc = Window.partitionBy(*by).orderBy("_cell")
    after = firsts.select(*by, "_cell", joined([F.lead("_heads", i).over(wc) for i in range(1, k + 1)]).alias("_after"))
    tail = F.slice("symbols", F.greatest(F.size("symbols") - k + 1, F.lit(1)), F.lit(k))
    edge = x.join(after, [*by, "_cell"]).select(*by, tail.alias("tail"), F.slice(F.concat("_next", "_after"), 1, k).alias("next"))
    edge = edge.select(*by, F.size("tail").alias("t"), F.concat("tail", "next").alias("symbols")).where("size(symbols) > t")
    over = ngrams(edge, least, most).where("at < t AND at + n > t").groupBy(*by, "n", "gram").agg(F.count("*").alias("cnt"))
    both = ngram_counts(seq, least, most, by).unionByName(over)
    return both.groupBy(*by, "n", "gram").agg(F.sum("cnt").alias("cnt"))


@null_strata
def unigram_entropy(seq: DataFrame, by: list[str]) -> DataFrame:
    e = entropy(symbol_counts(seq, by), by)
    return e.withColumn("h_norm", F.when(F.col("types") > 1, F.col("h") / F.log2(F.col("types").cast("double"))).otherwise(0.0))


def block_entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """H_n in nats of n-gram counts, and normalised by ln V."""
    e = _entropy_by_n(counts, by)
    v = e.where("n = 1").select(*by, F.col("types").alias("v"))
    return e.join(v, by).withColumn("h_norm", F.when(F.col("v") > 1, F.col("h") / F.ln(F.col("v").cast("double"))).otherwise(0.0))


def _entropy_by_n(counts: DataFrame, by: list[str]) -> DataFrame:
    c, n = F.col("cnt").cast("double"), F.sum(F.col("cnt").cast("double"))
    f1 = F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0))
    return counts.groupBy(*by, "n").agg((F.ln(n) - F.sum(c * F.ln(c)) / n).alias("h"), F.sum("cnt").alias("total"), F.count("*").alias("types"), f1.alias("f1"))


def estimators(counts: DataFrame, by: list[str]) -> DataFrame:
    """Plug-in, Miller-Madow and Chao-Shen entropies in nats for each n."""
    e = _entropy_by_n(counts, by)
    c = F.greatest(1 - F.col("f1") / F.col("total"), F.lit(1e-8))
    x = counts.join(e, [*by, "n"]).withColumn("cp", c * F.col("cnt") / F.col("total"))
    chao = F.sum(-F.col("cp") * F.ln("cp") / (1 - F.pow(1 - F.col("cp"), F.col("total").cast("double"))))
    shen = x.groupBy(*by, "n").agg(chao.alias("chao_shen"))
    return e.withColumn("miller_madow", F.col("h") + (F.col("types") - 1) / (2 * F.col("total"))).join(shen, [*by, "n"])


def conditional_by_difference(blocks: DataFrame, by: list[str]) -> DataFrame:
    """h(n) = H(n) - H(n-1), and whether the last two are within a tenth of each other."""
    w = Window.partitionBy(*by).orderBy("n")
    d = blocks.withColumn("h_cond", F.col("h") - F.coalesce(F.lag("h").over(w), F.lit(0.0)))
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n")))
    d = d.withColumn("_last", last).withColumn("_prev", F.lag("h_cond").over(w))
    flat = F.max(F.when(F.col("_last") == 1, F.abs(F.col("h_cond") - F.col("_prev")) <= 0.1 * F.abs(F.col("_prev")))).over(Window.partitionBy(*by))
    return d.withColumn("plateau", F.coalesce(flat, F.lit(False))).drop("_last", "_prev")


@null_strata
def conditional_by_rows(seq: DataFrame, by: list[str]) -> DataFrame:
    """H(B|A): entropies of the followers of a, weighed by a's share of all tokens."""
    rows = entropy(bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt")), [*by, "a"])
    uni = symbol_counts(seq, by)
    uni = with_totals(uni, uni.groupBy(*by).agg(F.sum("cnt").alias("total")), by)
    j = rows.select(*by, F.col("a").alias("sym"), "h").join(uni, [*by, "sym"])
    return j.groupBy(*by).agg(F.sum(F.col("cnt") / F.col("total") * F.col("h")).alias("h_cond"))


@null_strata
def conditional_by_joint(seq: DataFrame, by: list[str]) -> DataFrame:
    """H(XY) - H(X), X counted in first places of pairs only; both from one pair count."""
    pairs = bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt"))
    joint = entropy(pairs, by).select(*by, F.col("h").alias("h_joint"), "n")
    first = entropy(pairs.groupBy(*by, "a").agg(F.sum("cnt").alias("cnt")), by).select(*by, F.col("h").alias("h_first"))
    return joint.join(first, by).withColumn("h_cond", F.greatest(F.lit(0.0), F.col("h_joint") - F.col("h_first")))


@null_strata
def zipf(seq: DataFrame, by: list[str], least_ranks: int = 3) -> DataFrame:
    """Slope and fit of ln count over ln rank."""
    r = ranked(symbol_counts(seq, by), by)
    y, x = F.ln(F.col("cnt").cast("double")), F.ln(F.col("rank").cast("double"))
    return r.groupBy(*by).agg(F.count("*").alias("types"), (-F.regr_slope(y, x)).alias("alpha"), F.regr_r2(y, x).alias("r2")).where(F.col("types") >= least_ranks)


@null_strata
def zipf_mandelbrot(seq: DataFrame, by: list[str]) -> DataFrame:
    """Best (alpha, beta) of a fixed grid for ln f = c - alpha ln(rank + beta), by mean squared error."""
    r = ranked(symbol_counts(seq, by), by).select(*by, "rank", F.ln(F.col("cnt").cast("double")).alias("y"))
    grid = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.struct((a / 10).alias("alpha"), b.cast("double").alias("beta"))))))
    x = F.col("y") + F.col("g.alpha") * F.ln(F.col("rank") + F.col("g.beta"))
    fits = r.withColumn("g", grid).groupBy(*by, "g.alpha", "g.beta").agg(F.var_pop(x).alias("mse"), F.var_pop("y").alias("var_y"))
    best = fits.groupBy(*by).agg(F.min(F.struct(F.round("mse", 9).alias("mse"), "alpha", "beta", "var_y")).alias("m"))
    return best.select(*by, "m.alpha", "m.beta", "m.mse", F.when(F.col("m.var_y") > 0, 1 - F.col("m.mse") / F.col("m.var_y")).otherwise(0.0).alias("r2"))


@null_strata
def mutual_information(seq: DataFrame, by: list[str], lags: list[int], least_pairs: int = 10) -> DataFrame:
    """Information in nats between symbols k apart within sequences; lags with few pairs get 0."""
    pairs = reduce(DataFrame.unionByName, [bigrams(seq.select(*by, "symbols"), k).withColumn("k", F.lit(k)) for k in lags])
    joint = pairs.groupBy(*by, "k", "a", "b").agg(F.count("*").alias("cnt"))
    ent = lambda d, name: _entropy_of(d, [*by, "k"], name)
    a = ent(joint.groupBy(*by, "k", "a").agg(F.sum("cnt").alias("cnt")), "ha")
    b = ent(joint.groupBy(*by, "k", "b").agg(F.sum("cnt").alias("cnt")), "hb")
    both = joint.groupBy(*by, "k").agg(_h("cnt").alias("hab"), F.sum("cnt").alias("pairs"))
    mi = F.when(F.col("pairs") >= least_pairs, F.greatest(F.lit(0.0), F.col("ha") + F.col("hb") - F.col("hab"))).otherwise(0.0)
    return both.join(a, [*by, "k"]).join(b, [*by, "k"]).select(*by, "k", "pairs", mi.alias("mi"))


def _h(cnt: str) -> Column:
    c, n = F.col(cnt).cast("double"), F.sum(F.col(cnt).cast("double"))
    return F.ln(n) - F.sum(c * F.ln(c)) / n


def _entropy_of(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    return counts.groupBy(*by).agg(_h("cnt").alias(name))


def decay(mi: DataFrame, by: list[str]) -> DataFrame:
    """Power against exponential decay over lags with information, by R2."""
    x = mi.where("mi > 1e-9")
    y = F.ln("mi")
    d = x.groupBy(*by).agg(
        (-F.regr_slope(y, F.ln(F.col("k").cast("double")))).alias("gamma"), F.regr_r2(y, F.ln(F.col("k").cast("double"))).alias("power_r2"), F.regr_r2(y, F.col("k").cast("double")).alias("exp_r2"),
    )
    return d.withColumn("regime", F.when(F.col("power_r2") > F.col("exp_r2"), "power").otherwise("exponential"))


def order_profile(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Information per order: I_1 = ln V - H(1), then falls of the entropy per symbol, with their shares."""
    w = Window.partitionBy(*by).orderBy("n")
    per = blocks.withColumn("per", F.col("h") / F.col("n"))
    info = F.when(F.col("n") == 1, F.ln(F.col("v").cast("double")) - F.col("h")).otherwise(F.greatest(F.lit(0.0), F.lag("per").over(w) - F.col("per")))
    x = per.withColumn("info", info)
    total = F.sum("info").over(Window.partitionBy(*by))
    return x.withColumn("share", F.when(total > 0, F.col("info") / total).otherwise(0.0))


def higher_orders(blocks: DataFrame, by: list[str]) -> DataFrame:
    """e2 = (2 H1 - H2) / H1 and e3 = (3 H1 - 3 H2 + H3) / H1, within [0, 1]."""
    h = blocks.groupBy(*by).agg(*[F.max(F.when(F.col("n") == i, F.col("h"))).alias(f"h{i}") for i in (1, 2, 3)])
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return h.where("h1 > 0").select(*by, "h1", cut((2 * F.col("h1") - F.col("h2")) / F.col("h1")).alias("e2"), cut((3 * F.col("h1") - 3 * F.col("h2") + F.col("h3")) / F.col("h1")).alias("e3"))


def length_stats(seq: DataFrame, by: list[str]) -> DataFrame:
    """Lengths: mean, least, most and the upper median (place n // 2 of the sorted ones), from a histogram."""
    h = seq.groupBy(*by, F.size("symbols").alias("len")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    h = h.withColumn("upto", F.sum("n").over(w.orderBy("len"))).withColumn("all", F.sum("n").over(w))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("len")))
    return h.groupBy(*by).agg(F.sum("n").alias("sequences"), (F.sum(F.col("n") * F.col("len")) / F.sum("n")).alias("mean_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), median.alias("median_len"))


@null_strata
def template_coverage(seq: DataFrame, by: list[str], least: int = 2, most: int = 4, least_count: int = 3) -> DataFrame:
    """Recurrent n-grams and the share of sequences with at least one; n-grams are counted before they meet their sequences again, so no group of them is in one task."""
    seq = written(seq.select(*by, "seq_id", "symbols"), "sequences")
    g = ngrams(seq, least, most).select(*by, "seq_id", "n", "gram")
    often = written(g.groupBy(*by, "n", "gram").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least_count).drop("cnt"), "templates")
    covered = g.join(often, [*by, "n", "gram"], "left_semi").select(*by, "seq_id").distinct().groupBy(*by).agg(F.count("seq_id").alias("covered"))
    found = often.groupBy(*by).agg(F.count("*").alias("templates")).join(covered, by)
    return seq.groupBy(*by).agg(F.count("*").alias("sequences")).join(found, by, "left").select(*by, "sequences", F.coalesce("templates", F.lit(0)).alias("templates"), (F.coalesce("covered", F.lit(0)) / F.col("sequences")).alias("coverage"))


@null_strata
def corpus_summary(seq: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, types, H1, joint H2, H2 - H1, H2/H1, type-token ratio, hapax share and corr(rank, log2 count)."""
    # each token is counted once, with the one that follows it; counts of symbols and pairs are sums of these
    follow = F.arrays_zip(F.col("symbols").alias("a"), F.slice("symbols", F.lit(2), F.greatest(F.size("symbols"), F.lit(0))).alias("b"))
    each = unrolled(seq, follow, "_at", "_p", *by, F.size("symbols").alias("_len")).select(*by, "_p.*", (F.col("_at") + 1 < F.col("_len")).alias("more"))
    pairs = written(each.groupBy(*by, "a", "b", "more").agg(F.count("*").alias("cnt")), "pairs")
    counts = written(pairs.groupBy(*by, F.col("a").alias("sym")).agg(F.sum("cnt").alias("cnt")), "symbols")
    uni = entropy(counts, by).select(*by, F.col("h").alias("h1"), F.col("n").alias("tokens"), "types")
    two = entropy(pairs.where("more"), by).select(*by, F.col("h").alias("h2"))
    rest = ranked(counts, by).groupBy(*by).agg(F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).alias("hapax"), correlation(F.col("rank").cast("double"), F.log2(F.col("cnt").cast("double"))).alias("zipf_corr"))
    j = uni.join(two, by).join(rest, by)
    return j.select(*by, "tokens", "types", "h1", "h2", F.greatest(F.col("h2") - F.col("h1"), F.lit(0.0)).alias("h_cond"), ratio(F.col("h2"), F.col("h1")).alias("h_ratio"), ratio(F.col("types"), F.col("tokens")).alias("ttr"), ratio(F.col("hapax"), F.col("types")).alias("hapax_share"), "zipf_corr")


@null_strata
def repetition(seq: DataFrame, by: list[str]) -> DataFrame:
    """r, adjacent equal tokens; R, tokens whose symbol recurs in their sequence; sequences of 2 or more."""
    s = seq.where("size(symbols) >= 2")
    adjacent = F.size(F.filter(F.sequence(F.lit(1), F.size("symbols")), lambda i: (F.element_at("symbols", i) == F.get("symbols", i)) | ((i > 1) & (F.element_at("symbols", i) == F.get("symbols", i - 2)))))
    recurring = F.size("symbols") - F.size(F.filter("symbols", lambda x: F.size(F.filter("symbols", lambda y: y == x)) == 1))
    d = s.groupBy(*by).agg(F.sum(adjacent).alias("adjacent"), F.sum(recurring).alias("recurring"))
    return d.withColumn("r", ratio(F.col("adjacent"), F.col("recurring")))


def by_dimension(seq: DataFrame, dims: list[str], top: int) -> DataFrame:
    """Counts of symbols over all and for each value of each dimension, the top ones of each, in one pass."""
    t = seq.select(*dims, F.explode("symbols").alias("sym"))
    g = t.groupingSets([["sym"], *[[d, "sym"] for d in dims]], *dims, "sym").agg(F.count("*").alias("cnt"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    dim = reduce(lambda c, d: F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(c), dims, F.lit("(all)"))
    value = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.coalesce(F.col(d), F.lit("(unknown)"))) for d in dims], F.lit("(all)"))
    x = g.select(dim.alias("dim"), value.alias("value"), "sym", "cnt")
    w = Window.partitionBy("dim", "value").orderBy(F.desc("cnt"), "sym")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def signature_by_sequence(seq: DataFrame, least_len: int = 4) -> DataFrame:
    """Types, hapax and entropy of each sequence of enough symbols."""
    t = tokens(seq.where(F.size("symbols") >= least_len).select("seq_id", "symbols")).groupBy("seq_id", "sym").agg(F.count("*").alias("cnt"))
    return entropy(t, ["seq_id"], base2=False)
