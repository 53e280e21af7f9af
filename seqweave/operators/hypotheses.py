"""Typologies, permutation tests, and checks of mappings against vocabularies, roles and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, entropy, join_small, null_strata, tokens, top_per
from seqweave.operators import measures as m
from seqweave.operators import positions as p


@null_strata
def function_features(seq: DataFrame, by: list[str]) -> DataFrame:
    """Nine features of each symbol; rates are over the distinct sequences that hold it.

    isolation, initial, terminal, boundary (their sum), log_freq (over that of the
    most frequent symbol), diversity of neighbours, positional entropy over ten bins
    (.5 under two tokens), the share of its sequences that hold the group's most
    frequent symbol, and polyvalence (peaks of the bins, 0 under three tokens).
    """
    s = seq.select("seq_id", *by, "symbols")
    size = F.size("symbols")
    held = s.where(size > 0).select(*by, F.explode(F.array_distinct("symbols")).alias("sym"), (size == 1).alias("one"), F.get("symbols", F.lit(0)).alias("head"), F.element_at("symbols", -1).alias("tail"), "symbols")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = m.symbol_counts(s, by)
    order = F.struct((-F.col("cnt")).alias("c"), "sym")
    most = counts.groupBy(*by).agg(F.min(order)["sym"].alias("top"), F.max("cnt").alias("max_cnt"))
    rows = m.with_totals(held, most, by).groupBy(*by, "sym").agg(
        F.count("*").alias("seqs"), n(F.col("one")).alias("alone"), n(~F.col("one") & (F.col("head") == F.col("sym"))).alias("first"), n(~F.col("one") & (F.col("tail") == F.col("sym"))).alias("last"),
        n(F.array_contains("symbols", F.col("top"))).alias("same"), F.first("max_cnt").alias("max_cnt"),
    )
    pairs = bigrams(s.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("k"))
    near = pairs.select(*by, F.explode(F.array(F.col("a"), F.col("b"))).alias("sym")).groupBy(*by, "sym").agg(F.count("*").alias("near"))
    modes = p.multimodality(seq, by).select(*by, "sym", "n", "score", "entropy")
    j = rows.join(modes, [*by, "sym"]).join(near, [*by, "sym"], "left").fillna(0, ["near"])
    rate = lambda c: F.col(c) / F.col("seqs")
    top = F.ln(F.col("max_cnt").cast("double"))
    return j.select(
        *by, "sym", "n", rate("alone").alias("isolation"), rate("first").alias("initial"), rate("last").alias("terminal"), ((F.col("first") + F.col("last")) / F.col("seqs")).alias("boundary"),
        F.when(top > 0, F.ln(F.col("n").cast("double")) / top).otherwise(0.0).alias("log_freq"), F.least(F.lit(1.0), F.col("near") / F.greatest(2 * F.sqrt(F.col("n").cast("double")), F.lit(1.0))).alias("diversity"),
        F.when(F.col("n") < 2, 0.5).otherwise(F.col("entropy")).alias("entropy"), rate("same").alias("same_context"), F.when(F.col("n") < 3, 0.0).otherwise(F.least(F.lit(1.0), F.col("score"))).alias("polyvalence"),
    )


@null_strata
def estimator(seq: DataFrame, by: list[str]) -> DataFrame:
    """Shares of five functions for each symbol from its nine features, and the dominant one, the first of the largest.

    Each function adds up points for features within its bounds; the points are
    divided by their sum, or are equal shares where there are none.
    """
    f = function_features(seq, by)
    points = {
        "numeral": [(0.4, "log_freq > 0.8"), (0.3, "diversity < 0.2"), (0.2, "boundary > 0.2 AND boundary < 0.8"), (0.1, "isolation < 0.05")],
        "determinative": [(0.5, "initial > 0.7 OR terminal > 0.7"), (0.2, "isolation < 0.02"), (0.2, "log_freq > 0.2 AND log_freq < 0.85"), (0.1, "entropy < 0.35")],
        "logogram": [(0.4, "isolation > 0.15"), (0.2, "log_freq > 0.5"), (0.2, "entropy > 0.3 AND entropy < 0.75"), (0.2, "diversity > 0.15 AND diversity < 0.6")],
        "phonetic": [(0.3, "boundary < 0.35"), (0.3, "diversity > 0.4"), (0.2, "entropy > 0.55"), (0.2, "isolation < 0.05")],
        "boundary_marker": [(0.5, "boundary > 1.2"), (0.3, "log_freq > 0.7"), (0.2, "polyvalence > 0.15")],
    }
    six = f.select(*by, "sym", "n", *[F.round(c, 4).alias(c) for c in FEATURES])
    tenths = [sum((F.when(F.expr(c), int(10 * w)).otherwise(0) for w, c in rules), F.lit(0)).alias(f"k_{k}") for k, rules in points.items()]
    j = six.select("*", *tenths)
    total = sum((F.col(f"k_{k}") for k in points), F.lit(0))
    j = j.select(*by, "sym", "n", *FEATURES, *[F.when(total > 0, F.col(f"k_{k}") / total).otherwise(1 / len(points)).alias(f"p_{k}") for k in points])
    top = F.greatest(*[f"p_{k}" for k in points])
    return j.withColumn("dominant", F.coalesce(*[F.when(F.col(f"p_{k}") == top, F.lit(k)) for k in points]))


FEATURES = ["isolation", "initial", "terminal", "boundary", "log_freq", "diversity", "entropy", "same_context", "polyvalence"]


def global_then_local(seq: DataFrame, site: str, least: int = 5) -> DataFrame:
    """Global classes of symbols against their rates at each site: agree, disagree or too few; stable, partial or unstable."""
    g = p.rates(seq, [], 3).select("sym", "class").where("class <> 'MIXED'")
    loc = p.rates(seq, [site], 1)
    own = F.when(F.col("class_global") == "TERMINAL", F.col("t_rate")).when(F.col("class_global") == "INITIAL", F.col("i_rate")).otherwise(F.col("m_rate"))
    j = loc.drop("class").join(g.withColumnRenamed("class", "class_global"), "sym")
    j = j.withColumn("verdict", F.when(F.col("n") < least, "insufficient").when(own >= 0.5, "agree").otherwise("disagree"))
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    s = j.groupBy("sym", "class_global").agg(n("agree").alias("agree"), n("disagree").alias("disagree"), n("insufficient").alias("insufficient"))
    return s.withColumn("stability", F.when((F.col("agree") > 0) & (F.col("disagree") == 0), "stable").when(F.col("agree") > F.col("disagree"), "partial").otherwise("unstable"))


def typology(measured: DataFrame, key: str, benchmarks: DataFrame, k: int = 3) -> DataFrame:
    """A tier by h1 (bits), types and mean_len, and the nearest of benchmarks (name, tier, h1, types, mean_len): (key, tier, rank, name, distance).

    Distance: h1 over 5, ln(1 + types) over 2 and mean length over 2, Euclidean.
    Benchmarks are a reference table; each key's are ranked within one row.
    """
    tier = F.when((F.col("h1") < 4.7) & (F.col("types") < 50), "abjad").when((F.col("h1") < 6.5) & (F.col("types") < 120), "syllabary").when(F.col("types") > 200, "logographic").otherwise("mixed")
    b = benchmarks.select("name", *[F.col(c).alias(f"b_{c}") for c in ("h1", "types", "mean_len")], F.lit(1).alias("one"))
    j = join_small(measured.select(key, "h1", "types", "mean_len", tier.alias("tier"), F.lit(1).alias("one")), b, ["one"], "inner")
    square = lambda a, b_, s_: F.pow((a - b_) / s_, F.lit(2.0))
    d = F.sqrt(square(F.col("h1"), F.col("b_h1"), 5) + square(F.ln(1 + F.col("types").cast("double")), F.ln(1 + F.col("b_types").cast("double")), 2) + square(F.col("mean_len"), F.col("b_mean_len"), 2))
    best = j.groupBy(key, "tier").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round(d, 4).alias("distance"), "name"))), 1, k).alias("b"))
    return best.select(key, "tier", F.posexplode("b").alias("i", "b")).select(key, "tier", (F.col("i") + 1).alias("rank"), "b.name", "b.distance")


def length_kl(lengths: DataFrame, profiles: DataFrame, by: str) -> DataFrame:
    """(by, profile, kl): KL in nats of a group's length distribution (by, len, n) from each profile's (profile, len, q); lengths without a share get 1e-6."""
    n = m.with_totals(lengths, lengths.groupBy(by).agg(F.sum("n").alias("total")), [by]).withColumn("p", F.col("n") / F.col("total"))
    names = profiles.select("profile", F.lit(1).alias("one")).distinct()
    j = join_small(n.withColumn("one", F.lit(1)), names, ["one"], "inner").join(profiles, ["profile", "len"], "left").withColumn("q", F.coalesce("q", F.lit(1e-6)))
    return j.groupBy(by, "profile").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def profile_cost(lengths: DataFrame, profiles: DataFrame, by: str, stats: DataFrame | None = None, profile_stats: DataFrame | None = None, weights: dict[str, float] | None = None, length_weight: float = 3.0) -> DataFrame:
    """Weighed cost of each profile for each group, exp(-cost) as its likeness, its rank and the best one's margin over the next.

    The cost is the length KL times its weight plus weighed absolute differences of
    the columns of weights between stats (by, ...) and profile_stats (profile, ...).
    """
    c = length_kl(lengths, profiles, by).withColumn("cost", length_weight * F.col("kl"))
    if weights:
        c = c.join(stats, by).join(profile_stats.select("profile", *[F.col(k).alias(f"of_{k}") for k in weights]), "profile")
        c = c.withColumn("cost", F.col("cost") + sum((w * F.abs(F.col(k) - F.col(f"of_{k}")) for k, w in weights.items()), F.lit(0.0)))
    w = Window.partitionBy(by).orderBy(F.round("cost", 9), "profile")
    r = c.select(by, "profile", "kl", "cost", F.exp(-F.col("cost")).alias("likeness")).withColumn("rank", F.row_number().over(w))
    return r.withColumn("margin", F.when(F.col("rank") == 1, F.col("likeness") - F.lead("likeness").over(w)))


def word_stats(seq: DataFrame, by: str) -> DataFrame:
    """Mean length, entropies (bits) of last and first symbols, type-token ratio and share of distinct sequences of each group."""
    s = seq.where("size(symbols) > 0")
    ends = lambda c, name: entropy(s.select(by, c.alias("sym")).groupBy(by, "sym").agg(F.count("*").alias("cnt")), [by]).select(by, F.col("h").alias(name))
    n = s.groupBy(by).agg(F.avg(F.size("symbols")).alias("mean_len"), (F.count_distinct(F.xxhash64("symbols")) / F.count("*")).alias("distinct_share"))
    t = m.symbol_counts(s, [by]).groupBy(by).agg((F.count("*") / F.sum("cnt")).alias("ttr"))
    return n.join(t, by).join(ends(F.element_at("symbols", -1), "suffix_entropy"), by).join(ends(F.get("symbols", F.lit(0)), "prefix_entropy"), by)


def rank_hypotheses(df: DataFrame, key: str, columns: list[str], band: float = 0.05) -> DataFrame:
    """Hypotheses by their largest violation; those within the band of the best are tied with it."""
    v = df.withColumn("violation", F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))
    best = v.agg(F.min("violation").alias("best"))
    w = Window.orderBy(F.round("violation", 9), key)  # hypotheses are few
    return v.join(F.broadcast(best)).select(key, "violation", F.row_number().over(w).alias("rank"), (F.col("violation") <= F.col("best") + band).alias("within_band"))


def cluster_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best Jaccard of each cluster of a among those of b; both are (sym, cluster)."""
    both = a.select("sym", F.col("cluster").alias("ca")).join(b.select("sym", F.col("cluster").alias("cb")), "sym").groupBy("ca", "cb").agg(F.count("*").alias("shared"))
    size = lambda d, c: d.groupBy(F.col("cluster").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    j = both.join(size(a, "ca"), "ca").join(size(b, "cb"), "cb").withColumn("jaccard", F.col("shared") / (F.col("n_ca") + F.col("n_cb") - F.col("shared")))
    return top_per(j.select("ca", "cb", "shared", "jaccard"), ["ca"], [F.desc(F.round("jaccard", 9)), "cb"], 1)


def derived_anchors(associations: DataFrame, least_z: float, cap: int) -> DataFrame:
    """The strongest association of each symbol, by z, of at least least_z; the first cap of them."""
    best = top_per(associations.where(F.col("z") >= least_z), ["sym"], [F.desc(F.round("z", 6)), "ctx"], 1)
    return best.orderBy(F.desc(F.round("z", 6)), "sym").limit(cap)


def permutation_p(observed: DataFrame, null: DataFrame, metric: str) -> DataFrame:
    """p = (1 + null values of at least the observed) / (1 + n), null mean and z; observed is one row, null a row per replicate."""
    j = null.select(F.col(metric).alias("v")).join(F.broadcast(observed.select(F.col(metric).alias("o")).limit(1)))
    g = j.groupBy("o").agg(F.count("*").alias("n"), F.sum(F.when(F.round("v", 12) >= F.round("o", 12), 1).otherwise(0)).alias("over"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return g.select(F.col("o").alias("observed"), ((F.col("over") + 1) / (F.col("n") + 1)).alias("p"), F.col("mean").alias("null_mean"), F.when(F.col("sd") > 1e-12, (F.col("o") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def readout(names: DataFrame, objects: DataFrame, reach: int = 5) -> DataFrame:
    """For each name the best length score over all objects, 1 - |d| / reach, summed; (len) tables, through distinct lengths."""
    x = names.groupBy("len").agg(F.count("*").alias("n"))
    y = objects.select(F.col("len").alias("len_o")).distinct()
    near = x.withColumn("len_o", F.explode(F.sequence(F.col("len") - reach + 1, F.col("len") + reach - 1))).join(y, "len_o")
    best = near.groupBy("len", "n").agg(F.max(1 - F.abs(F.col("len") - F.col("len_o")) / reach).alias("score"))
    return best.agg(F.sum(F.col("n") * F.col("score")).alias("total"), F.sum("n").alias("matched"))


def admissible(mapping: DataFrame, value_roles: DataFrame, symbol_roles: DataFrame, strict: bool = False) -> DataFrame:
    """Whether the role of a symbol's value is among the symbol's roles; unknown ones violate only if strict."""
    j = mapping.join(value_roles.select("value", F.col("role").alias("value_role")), "value", "left").join(symbol_roles.groupBy("sym").agg(F.collect_set("role").alias("roles")), "sym", "left")
    known = F.col("value_role").isNotNull() & F.col("roles").isNotNull()
    return j.select("sym", "value", F.when(known, F.array_contains("roles", F.col("value_role"))).otherwise(F.lit(not strict)).alias("admissible"))


def compound_score(seq: DataFrame, mapping: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Decoded bigrams in the vocabulary count 1, others -0.5, weighed by their counts."""
    c = bigrams(seq.select("symbols")).groupBy("a", "b").agg(F.count("*").alias("cnt"))
    x = c.join(mapping.select(F.col("sym").alias("a"), F.col("value").alias("va")), "a").join(mapping.select(F.col("sym").alias("b"), F.col("value").alias("vb")), "b")
    j = x.withColumn("word", F.concat("va", "vb")).join(vocabulary.select("word", F.lit(1).alias("known")).distinct(), "word", "left")
    return j.agg(F.sum(F.when(F.col("known") == 1, F.col("cnt")).otherwise(-0.5 * F.col("cnt"))).alias("score"), F.sum("cnt").alias("bigrams"))


def transliterate(seq: DataFrame, anchors: DataFrame) -> DataFrame:
    """Readings joined by '-', unknown symbols in brackets, and the share that is known."""
    t = tokens(seq.select("seq_id", "symbols")).join(anchors.select("sym", "reading"), "sym", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("reading", F.concat(F.lit("["), "sym", F.lit("]"))).alias("r"))))
    return t.groupBy("seq_id").agg(F.array_join(F.transform(parts, lambda x: x["r"]), "-").alias("reading"), (F.count("reading") / F.count("*")).alias("coverage"))


def target_bigrams(vocabulary: DataFrame, word: str, width: int = 2) -> DataFrame:
    """Adjacent pairs of equal-length windows of words: counts."""
    n = F.length(word)
    starts = F.sequence(F.lit(1), F.greatest(n - 2 * width + 1, F.lit(1)))
    x = vocabulary.where(n >= 2 * width).select(F.explode(F.transform(starts, lambda i: F.struct(F.substring(F.col(word), i, F.lit(width)).alias("a"), F.substring(F.col(word), i + width, F.lit(width)).alias("b")))).alias("p"))
    return x.groupBy("p.a", "p.b").agg(F.count("*").alias("cnt"))


def anchor_score(mapping: DataFrame, anchors: DataFrame) -> DataFrame:
    """Weighed share of anchors (sym, value, confidence) that a mapping agrees with: HIGH 1, MEDIUM .5, else .2."""
    w = F.when(F.col("confidence") == "HIGH", 1.0).when(F.col("confidence") == "MEDIUM", 0.5).otherwise(0.2)
    j = anchors.withColumn("w", w).join(mapping.select("sym", F.col("value").alias("mapped")), "sym", "left")
    return j.agg(F.sum("w").alias("total"), (F.sum(F.when(F.col("mapped") == F.col("value"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"))


def readable(seq: DataFrame, mapping: DataFrame) -> DataFrame:
    """Share of sequences with one or more symbols of high confidence."""
    high = mapping.where("confidence = 'HIGH'").select("sym").distinct()
    hit = tokens(seq.select("seq_id", "symbols")).join(high, "sym", "left_semi").select("seq_id").distinct()
    return seq.agg(F.count("*").alias("sequences")).join(hit.agg(F.count("*").alias("readable"))).withColumn("share", F.col("readable") / F.col("sequences"))


def cross_validate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Roles of symbols in two tables (sym, role): confirmed, conflict or unmapped."""
    j = a.select("sym", F.col("role").alias("ra")).join(b.select("sym", F.col("role").alias("rb")), "sym", "left")
    return j.select("sym", F.when(F.col("rb").isNull(), "unmapped").when(F.col("ra") == F.col("rb"), "confirmed").otherwise("conflict").alias("status"))


def contains_either_way(a: DataFrame, b: DataFrame, least: int = 4) -> DataFrame:
    """Pairs of terms of which one holds the other: met on a substring of `least` letters, then checked.

    Both are (term); the shorter one's first letters are the key, the longer one's all substrings.
    """
    x, y = a.select(F.lower("term").alias("x")).distinct().where(F.length("x") >= least), b.select(F.lower("term").alias("y")).distinct().where(F.length("y") >= least)
    subs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substring(F.col(c), i, F.lit(least)))))
    one = x.withColumn("k", F.substring("x", 1, least)).join(y.withColumn("k", subs("y")), "k").where(F.contains("y", F.col("x")))
    two = x.withColumn("k", subs("x")).join(y.withColumn("k", F.substring("y", 1, least)), "k").where(F.contains("x", F.col("y")))
    return one.select("x", "y").unionByName(two.select("x", "y")).distinct()


def top_of_cohorts(df: DataFrame, key: str, length: Column, cuts: list[tuple[str, int, int]], score: Column, k: int = 3) -> DataFrame:
    """The k rows of the highest score in each length cohort: (cohort, rank, key, score)."""
    c = F.coalesce(*[F.when(length.between(lo, hi), F.lit(name)) for name, lo, hi in cuts])
    x = df.select(c.alias("cohort"), key, score.alias("score")).where("cohort IS NOT NULL AND score IS NOT NULL")
    # parts of a cohort are ranked first, so that none is sorted in one task
    best = top_per(top_per(x.withColumn("part", F.pmod(F.xxhash64(key), F.lit(64))), ["cohort", "part"], [F.desc("score"), key], k), ["cohort"], [F.desc("score"), key], k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("score"), key))).select("cohort", "rank", key, "score")


def cohorts(df: DataFrame, length: Column, cuts: list[tuple[str, int, int]], hit: Column) -> DataFrame:
    """Hit rates by length cohort (name, from, to)."""
    c = F.coalesce(*[F.when(length.between(lo, hi), F.lit(name)) for name, lo, hi in cuts])
    return df.withColumn("cohort", c).where("cohort IS NOT NULL").groupBy("cohort").agg(F.count("*").alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("hit_rate"))


def flattened(df: DataFrame, key: str, column: str, depth: int = 3) -> DataFrame:
    """(key, path, value) of the leaves of JSON objects, nested ones to a depth, by Spark's JSON functions."""
    level = df.where(F.col(column).isNotNull()).select(key, F.lit("").alias("path"), F.col(column).alias("v"))
    leaves = None
    for _ in range(depth):
        each = level.select(key, "path", F.explode(F.from_json("v", "map<string,string>")).alias("k", "v")).select(key, F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "k").alias("path"), "v")
        flat = each.where(F.col("v").isNull() | ~F.col("v").startswith("{")).select(key, "path", F.col("v").alias("value"))
        leaves = flat if leaves is None else leaves.unionByName(flat)
        level = each.where(F.col("v").startswith("{"))
    return leaves.unionByName(level.select(key, "path", F.col("v").alias("value")))

