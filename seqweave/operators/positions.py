"""Where symbols stand in their sequences: rates, classes, histograms and function scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, null_strata, ratio, tokens, top_per
from seqweave.operators.measures import with_totals


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def _first() -> Column:
    return F.col("pos") == 0


def _last() -> Column:
    return F.col("pos") == F.col("len") - 1


def start_end_counts(seq: DataFrame, by: list[str]) -> DataFrame:
    """start, end, internal of each symbol; the only symbol of a sequence counts as a start."""
    t = tokens(seq.select(*by, "symbols")).groupBy(*by, "sym").agg(F.count("*").alias("n"), _n(_first()).alias("n_start"), _n(_last() & ~_first()).alias("n_end"))
    t = t.withColumn("n_internal", F.col("n") - F.col("n_start") - F.col("n_end"))
    return t.select("*", *[(F.col(f"n_{k}") / F.col("n")).alias(f"{k}_rate") for k in ("start", "end", "internal")])


def four_way_counts(seq: DataFrame, by: list[str]) -> DataFrame:
    """initial, medial, terminal and singleton counts; the dominant one (in this order on ties) and its share."""
    one = F.col("len") == 1
    t = tokens(seq.select(*by, "symbols")).groupBy(*by, "sym").agg(
        F.count("*").alias("n"), _n(_first() & ~one).alias("initial"), _n(~_first() & ~_last()).alias("medial"), _n(_last() & ~one).alias("terminal"), _n(one).alias("singleton")
    )
    top = F.greatest("initial", "medial", "terminal")
    name = F.when(F.col("initial") == top, "initial").when(F.col("medial") == top, "medial").otherwise("terminal")
    t = t.withColumn("dominant", name).withColumn("dominant_share", top / F.col("n"))
    return t.withColumn("exclusive", (F.col("n") >= 3) & ((F.col("initial") == F.col("n")) | (F.col("medial") == F.col("n")) | (F.col("terminal") == F.col("n"))))


def rates(seq: DataFrame, by: list[str], min_count: int = 3) -> DataFrame:
    """t, i and m rates over all tokens (ends count only in sequences of two or more), and a class by cut-offs."""
    more = F.col("len") > 1
    return classed(tokens(seq.select(*by, "symbols")).groupBy(*by, "sym").agg(F.count("*").alias("n"), _n(_first() & more).alias("fi"), _n(_last() & more).alias("la")), by, min_count)


def classed(counts: DataFrame, by: list[str], min_count: int = 3) -> DataFrame:
    """rates of counts (by, sym, n, fi, la): tokens, and those that start and end a sequence of two or more."""
    t = counts.where(F.col("n") >= min_count)
    t = t.select(*by, "sym", "n", (F.col("la") / F.col("n")).alias("t_rate"), (F.col("fi") / F.col("n")).alias("i_rate"), ((F.col("n") - F.col("fi") - F.col("la")) / F.col("n")).alias("m_rate"))
    kind = F.when(F.col("t_rate") >= 0.6, "TERMINAL").when(F.col("i_rate") >= 0.5, "INITIAL").when(F.col("m_rate") >= 0.65, "MEDIAL").otherwise("MIXED")
    return t.withColumn("class", kind)


@null_strata
def candidates(seq: DataFrame, by: list[str]) -> DataFrame:
    """Terminal (rate and count of ends at least .5 and 5) and initial (.5 and 3) candidates, with the share of sequences that end or start with one."""
    c = start_end_counts(seq, by)
    c = c.withColumn("terminal_candidate", (F.col("end_rate") >= 0.5) & (F.col("n_end") >= 5)).withColumn("initial_candidate", (F.col("start_rate") >= 0.5) & (F.col("n_start") >= 3))
    n = seq.groupBy(*by).agg(F.count("*").alias("sequences"))
    s = c.groupBy(*by).agg(_n(F.col("terminal_candidate")).alias("terminals"), _n(F.col("initial_candidate")).alias("initials"), F.sum(F.when(F.col("terminal_candidate"), F.col("n_end")).otherwise(0)).alias("ended"), F.sum(F.when(F.col("initial_candidate"), F.col("n_start")).otherwise(0)).alias("begun"))
    return s.join(n, by).select(*by, "terminals", "initials", ratio(F.col("ended"), F.col("sequences")).alias("end_share"), ratio(F.col("begun"), F.col("sequences")).alias("start_share"))


def structural_class(counts: DataFrame) -> DataFrame:
    """Adds a structural class to start_end_counts."""
    c = (
        F.when(F.col("n") == 1, "HAPAX").when(F.col("n") < 5, "LOW_FREQUENCY").when(F.col("end_rate") >= 0.6, "TERMINAL_STRONG").when(F.col("start_rate") >= 0.6, "INITIAL_STRONG")
        .when(F.col("internal_rate") >= 0.7, "MEDIAL_STRONG").when((F.col("start_rate") >= 0.25) & (F.col("end_rate") >= 0.25), "BIMODAL").otherwise("MIXED")
    )
    return counts.withColumn("class", c)


def position_entropy(counts: DataFrame) -> DataFrame:
    """Adds the entropy in bits of start, end and internal."""
    part = lambda k: F.when(F.col(k) > 0, -F.col(k) * F.log2(k)).otherwise(0.0)
    return counts.withColumn("pos_entropy", part("start_rate") + part("end_rate") + part("internal_rate"))


def weighted_histogram(seq: DataFrame, by: list[str]) -> DataFrame:
    """Ten bins of 1 + 9 (p - 1) / (L - 1), weighed by L; mean, variance and a class from their masses."""
    nwp = F.when(F.col("len") == 1, 5.5).otherwise(1 + 9 * F.col("pos") / (F.col("len") - 1))
    t = tokens(seq.select(*by, "symbols")).withColumn("w", F.col("len").cast("double")).withColumn("x", nwp)
    t = t.withColumn("bin", F.least(F.lit(10), F.floor("x")).cast("int"))
    total = F.sum("w")
    g = t.groupBy(*by, "sym").agg(F.count("*").alias("n"), total.alias("w"), *[(F.sum(F.when(F.col("bin") == i, F.col("w")).otherwise(0.0)) / total).alias(f"b{i}") for i in range(1, 11)], (F.sum(F.col("w") * F.col("x")) / total).alias("mean"), (F.sum(F.col("w") * F.col("x") * F.col("x")) / total).alias("sq"))
    return g.withColumn("variance", F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("sq")


def multimodality(seq: DataFrame, by: list[str]) -> DataFrame:
    """Ten bins of the fractional position, local peaks of prominence .05 with the ends included, their score, entropy over log2 10."""
    frac = F.when(F.col("len") == 1, 0.5).otherwise(F.col("pos") / (F.col("len") - 1))
    t = tokens(seq.select(*by, "symbols")).withColumn("bin", F.least(F.lit(9), F.floor(frac * 10)).cast("int"))
    h = t.groupBy(*by, "sym").agg(F.count("*").alias("n"), *[_n(F.col("bin") == i).alias(f"b{i}") for i in range(10)])
    h = h.withColumn("h", F.array(*[F.col(f"b{i}") / F.col("n") for i in range(10)]))
    side = lambda i, d: F.coalesce(F.when((i + d >= 0) & (i + d <= 9), F.get("h", i + d)), F.lit(0.0))
    peak = lambda i: (F.get("h", i) - F.greatest(side(i, -1), side(i, 1)) >= 0.05)
    h = h.withColumn("peaks", F.filter(F.sequence(F.lit(0), F.lit(9)), peak))
    ent = F.aggregate("h", F.lit(0.0), lambda acc, p: acc + F.when(p > 0, -p * F.log2(p)).otherwise(0.0)) / F.log2(F.lit(10.0))
    spread = F.when(F.size("peaks") > 1, (F.array_max("peaks") - F.array_min("peaks")) / 9.0).otherwise(0.0)
    score = F.aggregate("peaks", F.lit(0.0), lambda acc, i: acc + F.get("h", i)) * spread
    return h.select(*by, "sym", "n", F.size("peaks").cast("long").alias("n_peaks"), score.alias("score"), ent.alias("entropy"))


@null_strata
def numerals(seq: DataFrame, by: list[str], min_freq: int = 3) -> DataFrame:
    """Evidence that a symbol counts things: narrow position, self-adjacency, few neighbours."""
    s = seq.select(*by, "symbols")
    frac = F.when(F.col("len") > 1, F.col("pos") / (F.col("len") - 1)).otherwise(0.0)
    pos = tokens(s).groupBy(*by, "sym").agg(F.count("*").alias("n"), F.stddev_pop(frac).alias("spread")).where(F.col("n") >= min_freq)
    pairs = bigrams(s).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt"))
    own = pairs.where("a = b").select(*by, F.col("a").alias("sym"), F.col("cnt").alias("self"))
    near = pairs.select(*by, F.explode(F.array(F.struct(F.col("a").alias("sym"), F.col("b").alias("nb")), F.struct(F.col("b").alias("sym"), F.col("a").alias("nb")))).alias("p")).groupBy(*by, "p.sym").agg(F.count_distinct("p.nb").alias("neighbours"))
    j = pos.join(own, [*by, "sym"], "left").join(near, [*by, "sym"], "left").fillna(0, ["self", "neighbours"])
    n = F.col("n")
    score = F.when(F.col("spread") < 0.25, 0.3).otherwise(0.0) + F.when(F.col("self") > 0.1 * n, 0.3).otherwise(0.0) + F.when((F.col("neighbours") < 10) & (n > 10), 0.2).otherwise(0.0) + F.when(F.col("neighbours") < 0.3 * n, 0.2).otherwise(0.0)
    return j.withColumn("score", score)


def five_way(seq: DataFrame, by: list[str]) -> DataFrame:
    """NUMERICAL by repetition >= .2, INITIAL, TERMINAL, MEDIAL by rates; a single symbol counts at both ends."""
    t = tokens(seq.select("seq_id", *by, "symbols")).withColumn("next", F.lead("sym").over(Window.partitionBy("seq_id").orderBy("pos")))
    g = t.groupBy(*by, "sym").agg(F.count("*").alias("n"), _n(_first()).alias("fi"), _n(_last()).alias("la"), _n(~_first() & ~_last()).alias("me"), _n(F.col("next") == F.col("sym")).alias("rep"))
    i, t_, m, r = (F.col(k) / F.col("n") for k in ("fi", "la", "me", "rep"))
    kind = F.when(r >= 0.2, "NUMERICAL").when((i >= 0.55) & (t_ < 0.3) & (m < 0.3), "INITIAL").when((t_ >= 0.55) & (i < 0.3) & (m < 0.3), "TERMINAL").when((m >= 0.55) & (i < 0.3) & (t_ < 0.3), "MEDIAL").otherwise("MIXED")
    return g.select(*by, "sym", "n", i.alias("i_rate"), t_.alias("t_rate"), m.alias("m_rate"), r.alias("rep_rate"), kind.alias("class"))


def logo_syllabic(seq: DataFrame, by: list[str]) -> DataFrame:
    """logogram by standing alone >= .4, determinative by initial or terminal >= .8, else syllabogram; over tokens."""
    g = tokens(seq.select(*by, "symbols")).groupBy(*by, "sym").agg(F.count("*").alias("n"), (_n(F.col("len") == 1) / F.count("*")).alias("alone"), (_n(_first()) / F.count("*")).alias("initial"), (_n(_last()) / F.count("*")).alias("terminal"))
    return g.withColumn("class", F.when(F.col("alone") >= 0.4, "logogram").when((F.col("initial") >= 0.8) | (F.col("terminal") >= 0.8), "determinative").otherwise("syllabogram"))


def run_lengths(seq: DataFrame, by: list[str]) -> DataFrame:
    """Runs of one symbol within sequences: (seq_id, by, run, sym, length)."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    t = tokens(seq.select("seq_id", *by, "symbols"))
    t = t.withColumn("new", F.when(F.lag("sym").over(w) == F.col("sym"), 0).otherwise(1))
    t = t.withColumn("run", F.sum("new").over(w))
    return t.groupBy("seq_id", *by, "run", "sym").agg(F.count("*").alias("length"))


def run_stats(seq: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Runs of two or more by symbol: how many, mean, population deviation, longest, and their regime."""
    r = run_lengths(seq, by).where(F.col("length") >= least)
    g = r.groupBy(*by, "sym").agg(F.count("*").alias("runs"), F.avg("length").alias("mean"), F.stddev_pop("length").alias("sd"), F.max("length").alias("longest"))
    cv = F.col("sd") / F.col("mean")
    return g.withColumn("cv", cv).withColumn("regime", F.when(cv < 0.2, "fixed").when(cv < 0.5, "variable").otherwise("free"))


def slot_templates(seq: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Patterns of sequences in class space: symbols recoded by (sym, class), '?' where there is none."""
    t = tokens(seq.select("seq_id", *by, "symbols")).join(classes, "sym", "left").withColumn("class", F.coalesce("class", F.lit("?")))
    p = t.groupBy("seq_id", *by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "class"))), lambda x: x["class"]), "-").alias("pattern"))
    return p.groupBy(*by, "pattern").agg(F.count("*").alias("cnt"))


@null_strata
def slot_neighbours(seq: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Top right neighbours of a symbol as initial against top left ones as terminal; 1 - overlap / union."""
    s = seq.where("size(symbols) > 1").select(*by, "symbols")
    right = s.select(*by, F.get("symbols", F.lit(0)).alias("sym"), F.get("symbols", F.lit(1)).alias("nb"))
    left = s.select(*by, F.element_at("symbols", -1).alias("sym"), F.element_at("symbols", -2).alias("nb"))
    top = lambda d, name: top_per(d.groupBy(*by, "sym", "nb").agg(F.count("*").alias("cnt")), [*by, "sym"], [F.desc("cnt"), "nb"], k).groupBy(*by, "sym").agg(F.array_sort(F.collect_set("nb")).alias(name))
    j = top(right, "r").join(top(left, "l"), [*by, "sym"])
    return j.select(*by, "sym", F.array_join("r", ",").alias("right_top"), F.array_join("l", ",").alias("left_top"), (1 - F.size(F.array_intersect("r", "l")) / F.size(F.array_union("r", "l"))).alias("divergence"))


def grammar_r2(classed: DataFrame, by: list[str]) -> DataFrame:
    """Share of the variance of (i_rate, t_rate) that class means explain: 1 - within / total."""
    within = classed.groupBy(*by, "class").agg(F.count("*").alias("n"), *[F.var_pop(c).alias(c) for c in ("i_rate", "t_rate")])
    w = within.groupBy(*by).agg(F.sum(F.col("n") * (F.col("i_rate") + F.col("t_rate"))).alias("within"))
    t = classed.groupBy(*by).agg((F.count("*") * (F.var_pop("i_rate") + F.var_pop("t_rate"))).alias("total"))
    return with_totals(w, t, by).select(*by, F.when(F.col("total") > 0, 1 - F.col("within") / F.col("total")).otherwise(0.0).alias("r2"))
