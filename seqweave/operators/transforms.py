"""Filters and transforms of sequences. All randomness is md5 of a seed and keys, so it is repeatable anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import hash_rank, kth_smallest, ranked, tokens
from seqweave.functions.tables import written
from seqweave.operators.measures import symbol_counts


def by_length(seq: DataFrame, least: int = 1, most: int = 999) -> DataFrame:
    return seq.where(F.size("symbols").between(least, most))


def length_report(seq: DataFrame, by: list[str], least: int = 7, most: int = 0) -> DataFrame:
    """What a length filter keeps and drops, in one pass (most 0: no upper bound)."""
    n = F.size("symbols")
    short, long = n < least, (n > most) if most else F.lit(False)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = seq.groupBy(*by).agg(F.count("*").alias("sequences"), count(short).alias("dropped_short"), count(long).alias("dropped_long"), F.sum(F.when(~short & ~long, n).otherwise(0)).alias("tokens_kept"))
    return g.withColumn("share_kept", (F.col("sequences") - F.col("dropped_short") - F.col("dropped_long")) / F.col("sequences"))


def filter_tokens(seq: DataFrame, block: list[str] = [], ranges: list[tuple[int, int]] = [], min_freq: int = 1, keep_empty: bool = False) -> DataFrame:  # noqa: B006
    """Blocklist, then first code points within ranges, then corpus frequency (counted before the others); emptied sequences go."""
    def ok(x: Column) -> Column:
        c = ~x.isin(block) if block else F.lit(True)
        if ranges:
            inside = F.lit(False)
            for lo, hi in ranges:
                inside = inside | F.ascii(x).between(lo, hi)
            c = c & inside
        return c

    if min_freq <= 1:
        out = seq.withColumn("symbols", F.filter("symbols", ok)) if block or ranges else seq
        return out if keep_empty else out.where(F.size("symbols") > 0)
    seq = written(seq, "sequences")
    rare = symbol_counts(seq).where((F.col("cnt") < min_freq) & ok(F.col("sym"))).select("sym")
    t = tokens(seq.select("seq_id", "symbols")).where(ok(F.col("sym"))).select("seq_id", "pos", "sym").join(rare, "sym", "left_anti")
    kept = t.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sym"))).alias("x")).select("seq_id", F.col("x.sym").alias("symbols"))
    if set(seq.columns) == {"seq_id", "symbols"} and not keep_empty:
        return kept.select(*seq.columns)
    out = seq.join(kept.withColumnRenamed("symbols", "_kept"), "seq_id", "left" if keep_empty else "inner")
    return out.withColumn("symbols", F.coalesce("_kept", F.array().cast("array<string>"))).select(*seq.columns)


def oriented(seq: DataFrame, direction: str) -> DataFrame:
    """Right-to-left sequences reversed."""
    return seq.withColumn("symbols", F.when(F.col(direction) == "rtl", F.reverse("symbols")).otherwise(F.col("symbols")))


def direction(seq: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Which way a corpus runs: the end with the lower entropy (bits) is the end of the word."""
    ends = seq.where("size(symbols) > 0").select(*by, F.explode(F.array(F.struct(F.lit("first").alias("end"), F.get("symbols", F.lit(0)).alias("sym")), F.struct(F.lit("last").alias("end"), F.element_at("symbols", -1).alias("sym")))).alias("e")).select(*by, "e.*")
    counts = ends.groupBy(*by, "end", "sym").agg(F.count("*").alias("cnt"))
    n = F.sum("cnt")
    h = counts.groupBy(*by, "end").agg((F.log2(n) - F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))) / n).alias("h"), n.alias("n"))
    g = h.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("end") == "first", F.col("h"))).alias("h_first"), F.max(F.when(F.col("end") == "last", F.col("h"))).alias("h_last"))
    d = F.abs(F.col("h_first") - F.col("h_last"))
    known = (F.col("n") >= least) & (d >= 0.05)
    g = g.withColumn("direction", F.when(~known, "unknown").when(F.col("h_last") < F.col("h_first"), "ltr").otherwise("rtl"))
    return g.withColumn("confidence", F.when(~known, "low").when(d < 0.3, "medium").otherwise("high"))


def gini(counts: DataFrame, by: list[str]) -> DataFrame:
    """Gini coefficient of counts from their histogram: no task sorts a vocabulary."""
    h = counts.groupBy(*by, "cnt").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy("cnt")
    before = F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("b", before)
    # ranks b + 1 .. b + k share one count, so their sum is k b + k (k + 1) / 2
    top = F.sum(F.col("cnt") * (F.col("k") * F.col("b") + F.col("k") * (F.col("k") + 1) / 2))
    return h.groupBy(*by).agg((2 * top / (F.sum("k") * F.sum(F.col("cnt") * F.col("k"))) - (F.sum("k") + 1) / F.sum("k")).alias("gini"))


def hashed(*parts: object) -> Column:
    """md5 of the parts joined by '|': the key by which things are shuffled."""
    return F.md5(F.concat_ws("|", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]).cast("binary"))


def split_contiguous(seq: DataFrame, ratio: float = 0.75, order: str = "seq_id") -> DataFrame:
    """part 'train' for the first max(1, int(n ratio)) sequences by a whole-number order, else 'test'; ratio within .1 and .95.

    The bound is found by counting cells of the order's range, so no task holds or sorts all rows.
    """
    ratio = min(0.95, max(0.1, ratio))
    bound = kth_smallest(seq, order, max(1, int(seq.count() * ratio)))
    return seq.withColumn("part", F.when(F.col(order) <= F.lit(bound), "train").otherwise("test"))


def folds(seq: DataFrame, k: int = 10, seed: str = "7", key: str = "seq_id") -> DataFrame:
    """fold by the hash's first 32 bits in k equal ranges: disjoint, nearly equal, and without ranking all rows."""
    return seq.withColumn("fold", F.floor(F.conv(F.substring(hashed(seed, F.col(key)), 1, 8), 16, 10).cast("double") * k / float(1 << 32)).cast("int"))


def length_bin(seq: DataFrame, bins: list[tuple[int, int | None]]) -> DataFrame:
    """stratum: the first bin that holds the length; L{lo}-{hi} or L{lo}+."""
    n, c = F.size("symbols"), None
    for lo, hi in bins:
        ok, name = (n >= lo) if hi is None else n.between(lo, hi), f"L{lo}+" if hi is None else f"L{lo}-{hi}"
        c = F.when(ok, name) if c is None else c.when(ok, name)
    return seq.withColumn("stratum", c)


def site_strata(seq: DataFrame, site: str, least: int = 30, top: int | None = None) -> DataFrame:
    """Sites under so many sequences, or outside of the largest, become Other."""
    n = seq.groupBy(site).agg(F.count("*").alias("_n"))
    n = n.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_n"), site))) if top else n.withColumn("_r", F.lit(1))
    big = n.where((F.col("_n") >= least) & (F.col("_r") <= (top or 1))).select(site, F.col(site).alias("stratum"))
    return seq.join(big, site, "left").withColumn("stratum", F.coalesce("stratum", F.lit("Other")))


def text_bucket(df: DataFrame, field: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """bucket: the first one with a keyword in the lower-cased field; Unknown if empty, else Other."""
    low = F.lower(F.col(field))
    c = F.when(F.col(field).isNull() | (F.trim(field) == ""), "Unknown")
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        c = c.when(hit, name)
    return df.withColumn("bucket", c.otherwise("Other"))


def collapse_runs(seq: DataFrame) -> DataFrame:
    """collapsed and run_lengths of each sequence, within the row."""
    start = F.array().cast("array<struct<sym:string,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(x.alias("sym"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["sym"] == x), grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("sym"), F.lit(1).alias("n")))))

    runs = F.aggregate("symbols", start, step)
    return seq.withColumn("_r", runs).withColumn("collapsed", F.col("_r.sym")).withColumn("run_lengths", F.col("_r.n")).drop("_r")


def recode(seq: DataFrame, mapping: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Symbols replaced by mapping (sym, to); others by the fallback, or kept. The order is restored by position."""
    t = tokens(seq.select("seq_id", "symbols")).join(mapping.select("sym", "to"), "sym", "left")
    t = t.withColumn("sym", F.coalesce("to", fallback if fallback is not None else F.col("sym")))
    x = t.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sym"))).alias("x")).select("seq_id", F.col("x.sym").alias("symbols"))
    return seq.drop("symbols").join(x, "seq_id")


def bijection(seq: DataFrame, seed: str) -> DataFrame:
    """A random one-to-one recoding of the symbols onto C0001, C0002, ...: rank by symbol against rank by hash."""
    v = hash_rank(symbol_counts(seq).select("sym", hashed(seed, F.col("sym")).alias("_h")), "_h", [])
    return v.select("sym", F.format_string("C%04d", F.col("rank")).alias("to"))  # longer numbers stay whole


def shuffle_within(seq: DataFrame, seed: str, reps: int = 1) -> DataFrame:
    """Symbols of each sequence in a hashed order, once per replicate, within the row."""
    x = seq.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    x = x.withColumn("_head", F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("seq_id").cast("string")))
    keyed = F.transform("symbols", lambda s, i: F.struct(F.md5(F.concat_ws("|", F.col("_head"), i.cast("string")).cast("binary")).alias("h"), s.alias("s")))
    return x.withColumn("symbols", F.sort_array(keyed)["s"]).drop("_head")


def _numbered(seq: DataFrame) -> DataFrame:
    """(sym, rank, n): each symbol's place in the alphabet, from 0, and the size of the vocabulary. The one-row total is attached, no task holds all symbols."""
    v = ranked(symbol_counts(seq).select("sym", F.lit(1).alias("cnt")), []).select("sym", (F.col("rank") - 1).alias("rank"))
    return v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n"))))


def _drawn(at: int, n: Column, seed: str) -> Column:
    """A number under n from 8 digits of the md5 of seed, sequence and place."""
    return F.pmod(F.conv(F.substring(hashed(seed, F.col("seq_id"), F.col("pos")), at, 8), 16, 10).cast("long"), n)


def _collected(seq: DataFrame, t: DataFrame) -> DataFrame:
    x = t.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sym"))).alias("x")).select("seq_id", F.col("x.sym").alias("symbols"))
    return seq.drop("symbols").join(x, "seq_id")


def relabel(seq: DataFrame, seed: str) -> DataFrame:
    """Every token drawn evenly from the vocabulary: a number is drawn, its symbol is looked up by a join."""
    v = _numbered(seq)
    n = v.select("n").limit(1)
    t = tokens(seq.select("seq_id", "symbols")).select("seq_id", "pos").crossJoin(F.broadcast(n)).withColumn("rank", _drawn(1, F.col("n"), seed)).drop("n")
    return _collected(seq, t.join(v.select("rank", "sym"), "rank"))


def noise(seq: DataFrame, seed: str, share: float) -> DataFrame:
    """A share of tokens, by hash, replaced by another symbol of the vocabulary; only those are looked up."""
    v = _numbered(seq)
    t = tokens(seq.select("seq_id", "symbols")).select("seq_id", "pos", "sym")
    hit = F.conv(F.substring(hashed(seed, F.col("seq_id"), F.col("pos")), 1, 8), 16, 10).cast("double") / float(1 << 32) < share
    moved = t.where(hit).join(v, "sym").select("seq_id", "pos", F.when(F.col("n") > 1, F.pmod(F.col("rank") + 1 + _drawn(9, F.greatest(F.col("n") - 1, F.lit(1)), seed), F.col("n"))).otherwise(F.col("rank")).alias("rank"))
    return _collected(seq, t.where(~hit).unionByName(moved.join(v.select("rank", "sym"), "rank").select("seq_id", "pos", "sym")))
