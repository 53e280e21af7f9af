"""Comparison of strata and corpora by their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import join_small


def stratum_pairs(counts: DataFrame, by: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """All pairs of strata (x < y) over the symbols of either: (keys, x, y, sym, cx, cy), 0 where one lacks it.

    A symbol's counts are gathered in one row, a map over its strata; it meets the
    pairs of strata that hold it on either side. Strata are few, the values of a
    metadata column; pairs of more of them than a broadcast takes are joined.
    """
    known = counts.where(F.col(by).isNotNull())
    names = known.select(F.col(by).alias("y")).distinct()
    per_symbol = known.groupBy(*keys, "sym").agg(F.map_from_entries(F.collect_list(F.struct(by, "cnt"))).alias("m"))
    # a stratum that holds the symbol against every other: each pair once, by the smaller of those that hold it
    met = join_small(per_symbol.select(*keys, "sym", "m", F.explode(F.map_keys("m")).alias("x"), F.lit(1).alias("k")), names.withColumn("k", F.lit(1)), ["k"], "inner")
    once = met.where((F.col("x") < F.col("y")) | ((F.col("y") < F.col("x")) & ~F.map_contains_key("m", F.col("y"))))
    count = lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)).cast("double")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return once.select(*keys, low.alias("x"), high.alias("y"), "sym", count(low).alias("cx"), count(high).alias("cy"))


def divergences(pairs: DataFrame, smoothing: float = 0.0, epsilon: float = 0.0) -> DataFrame:
    """KL both ways and JS in bits; without smoothing KL sums only symbols that both have.

    smoothing is added to counts; epsilon to shares, which are then scaled to 1.
    Totals are aggregated and joined back, a row for each pair of strata.
    """
    keys = [c for c in pairs.columns if c not in ("sym", "cx", "cy")]
    totals = pairs.groupBy(*keys).agg(F.count("*").alias("v"), F.sum("cx").alias("nx"), F.sum("cy").alias("ny"))
    share = lambda c, n: ((F.col(c) + smoothing) / (F.col(n) + smoothing * F.col("v")) + epsilon) / (1 + epsilon * F.col("v"))
    p = join_small(pairs, totals, keys, "inner").withColumn("p", share("cx", "nx")).withColumn("q", share("cy", "ny"))
    term = lambda a, b: F.when((a > 0) & (b > 0), a * F.log2(a / F.nullif(b, F.lit(0.0)))).otherwise(0.0)
    mid = (F.col("p") + F.col("q")) / 2
    return p.groupBy(*keys).agg(F.sum(term(F.col("p"), F.col("q"))).alias("kl"), F.sum(term(F.col("q"), F.col("p"))).alias("kl_back"), F.sum(0.5 * term(F.col("p"), mid) + 0.5 * term(F.col("q"), mid)).alias("js"))


def overlaps(pairs: DataFrame) -> DataFrame:
    """Shared symbols, those in one only, Jaccard."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = pairs.groupBy("x", "y").agg(n((F.col("cx") > 0) & (F.col("cy") > 0)).alias("shared"), n(F.col("cy") == 0).alias("only_x"), n(F.col("cx") == 0).alias("only_y"))
    return g.withColumn("jaccard", F.col("shared") / (F.col("shared") + F.col("only_x") + F.col("only_y")))


def class_stability(classed: DataFrame, by: str) -> DataFrame:
    """Symbols in two or more strata, and whether they have one class in all."""
    g = classed.groupBy("sym").agg(F.count_distinct(by).alias("sites"), F.count_distinct("class").alias("classes"), F.array_join(F.array_sort(F.collect_set("class")), ",").alias("found"))
    return g.where("sites >= 2").withColumn("stable", F.col("classes") == 1)


def nearest(measures: DataFrame, key: str, columns: list[str], reference: DataFrame, k: int = 3, weights: list[float] | None = None, metric: str = "euclidean") -> DataFrame:
    """Nearest reference rows by weighted Euclidean distance over min-max scaled columns, or by 1 - cosine of the columns as they are.

    Each row meets each reference row; the k best of a key are kept by aggregation.
    """
    both = reference.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    r = reference.select(F.col(key).alias("ref"), *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("one"))
    if metric == "euclidean":
        scaled = lambda c, v: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (v - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
        d = F.sqrt(sum((w * F.pow(scaled(c, F.col(c)) - scaled(c, F.col(f"r_{c}")), F.lit(2.0)) for c, w in zip(columns, weights or [1.0] * len(columns), strict=True)), F.lit(0.0)))
    else:
        dot = lambda a, b: sum((F.col(a.format(c)) * F.col(b.format(c)) for c in columns), F.lit(0.0))
        d = 1 - dot("{0}", "r_{0}") / F.sqrt(dot("{0}", "{0}") * dot("r_{0}", "r_{0}"))
    j = join_small(measures.select(key, *columns, F.lit(1).alias("one")).crossJoin(F.broadcast(both)), r, ["one"], "inner").where(F.col(key) != F.col("ref"))
    best = j.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.round(d, 9).alias("distance"), "ref"))), 1, k).alias("b"))  # a key's references, 10,000 or so
    return best.select(key, F.posexplode("b").alias("i", "b")).select(key, "b.ref", "b.distance", (F.col("i") + 1).alias("rank"))


def slot_divergence(seq: DataFrame, by: list[str]) -> DataFrame:
    """KL in bits (Laplace) between right neighbours of a symbol as initial and elsewhere."""
    from seqweave.functions.exprs import tokens

    keep = [*by, "seq_id"]
    w = Window.partitionBy("seq_id").orderBy("pos")
    t = tokens(seq.select(*keep, "symbols")).withColumn("nb", F.lead("sym").over(w)).where("nb IS NOT NULL")
    c = t.groupBy(*by, "sym", "nb").agg(F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("pos") > 0, 1).otherwise(0)).alias("b"))
    g = c.groupBy(*by, "sym").agg(F.count("*").alias("v"), F.sum("a").alias("na"), F.sum("b").alias("nb_")).where("na > 0 AND nb_ > 0")
    c = c.join(g, [*by, "sym"])
    p, q = (F.col("a") + 1) / (F.col("na") + F.col("v")), (F.col("b") + 1) / (F.col("nb_") + F.col("v"))
    return c.groupBy(*by, "sym").agg(F.sum(p * F.log2(p / q)).alias("kl"))


def catalogue(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone and by all together; nulls count as '(unknown)'."""
    from seqweave.operators.evidence import tally

    return tally(df, dims)


def chi_square(table: DataFrame, row: str, col: str, cnt: str = "cnt") -> DataFrame:
    """Chi-squared statistic and degrees of freedom of a contingency table, and Cramer's V; cells of 0 count by their margins."""
    rows, cols = table.groupBy(row).agg(F.sum(cnt).alias("r")), table.groupBy(col).agg(F.sum(cnt).alias("c"))
    x = table.join(rows, row).join(cols, col).crossJoin(F.broadcast(table.agg(F.sum(cnt).alias("n"))))
    # sum of (o - e)^2 / e over all cells = n (sum of o^2 / (r c) - 1)
    s = x.agg((F.first("n") * (F.sum(F.col(cnt) * F.col(cnt) / (F.col("r") * F.col("c"))) - 1)).alias("chi2"), F.first("n").alias("n"))
    dims = rows.agg(F.count("*").alias("nr")).join(cols.agg(F.count("*").alias("nc")))
    out = s.join(dims).withColumn("dof", (F.col("nr") - 1) * (F.col("nc") - 1))
    return out.withColumn("cramers_v", F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("nr") - 1, F.col("nc") - 1))))


def enrichment(table: DataFrame, stratum: str, hit: str, cnt: str = "cnt") -> DataFrame:
    """Share of hits in each stratum over that of all: (stratum, n, hits, enrichment)."""
    g = table.groupBy(stratum).agg(F.sum(cnt).alias("n"), F.sum(F.when(F.col(hit), F.col(cnt)).otherwise(0)).alias("hits"))
    t = g.agg((F.sum("hits") / F.sum("n")).alias("share"))
    return g.crossJoin(F.broadcast(t)).select(stratum, "n", "hits", F.when(F.col("share") > 0, F.col("hits") / F.col("n") / F.col("share")).otherwise(0.0).alias("enrichment"))


def interval(mean: Column, sd: Column, n: Column) -> tuple[Column, Column]:
    """The normal 95 % interval of a mean."""
    half = 1.96 * sd / F.sqrt(n)
    return mean - half, mean + half
