"""Similarity joins of sparse vectors (by, sym, feature, w) that don't form all pairs sharing a feature.

A symbol's features are ordered by falling rarity; the norm of what is left from
a feature on bounds what all later ones can add to a cosine. Of a pair over the
threshold, the first common feature and the product of both bounds after it reach
the threshold too, so only such entries meet. Common features stand last in the
order, where the bounds are small. Pairs found are then
compared exactly, through the vector of the one with fewer features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.tables import written

#: Entries of one feature that meet in one task at most; more are split by salts.
HOT = 4096
#: Bounds are sums of doubles: they may be off by this much.
SLACK = 1e-9


def prefixes(vectors: DataFrame, by: list[str], least: float) -> DataFrame:
    """The entries (by, sym, feature, share, after) whose norm from there on, over the whole norm, is at least the threshold.

    share is the entry's weight and after the norm of later entries, both over the
    whole norm. Entries with a weight of 0 go.
    """
    v = vectors.where("w <> 0")
    df = v.groupBy(*by, "feature").agg(F.count("*").alias("df"))
    norm = v.groupBy(*by, "sym").agg(F.sum(F.col("w").cast("double") * F.col("w")).alias("n2"))
    w = Window.partitionBy(*by, "sym").orderBy(F.desc("df"), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
    x = v.join(df, [*by, "feature"]).withColumn("sum2", F.sum(F.col("w").cast("double") * F.col("w")).over(w))
    x = x.join(norm, [*by, "sym"]).where(F.sqrt(F.col("sum2") / F.col("n2")) >= least - SLACK)
    after = F.sqrt(F.greatest(F.col("sum2") - F.col("w").cast("double") * F.col("w"), F.lit(0.0)) / F.col("n2"))
    return x.select(*by, "sym", "feature", (F.col("w") / F.sqrt("n2")).alias("share"), after.alias("after"))


def candidates(vectors: DataFrame, by: list[str], least: float) -> DataFrame:
    """Distinct pairs (by, x < y), among them all with a cosine of at least the threshold, which is over 0."""
    p = written(prefixes(vectors, by, least), "prefixes")
    parts = p.groupBy(*by, "feature").agg(F.count("*").alias("n")).where("n > 1").select(*by, "feature", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    p = p.join(parts, [*by, "feature"])
    x = p.select(*by, "feature", F.col("sym").alias("x"), F.col("share").alias("fx"), F.col("after").alias("rx"), F.pmod(F.xxhash64("sym"), "parts").cast("int").alias("salt"))
    y = p.select(*by, "feature", F.col("sym").alias("y"), F.col("share").alias("fy"), F.col("after").alias("ry"), F.explode(F.expr("sequence(0, parts - 1)")).alias("salt"))
    met = x.join(y, [*by, "feature", "salt"]).where((F.col("x") < F.col("y")) & (F.col("fx") * F.col("fy") + F.col("rx") * F.col("ry") >= least - SLACK))
    return met.select(*by, "x", "y").distinct()


def compared(pairs: DataFrame, vectors: DataFrame, by: list[str], **terms: Column) -> DataFrame:
    """pairs with the sums of terms over common features, each symmetric in ws and wb; a pair without one isn't in the result."""
    size = vectors.groupBy(*by, "sym").agg(F.count("*").alias("size"))
    j = pairs.join(size.withColumnsRenamed({"sym": "x", "size": "sx"}), [*by, "x"]).join(size.withColumnsRenamed({"sym": "y", "size": "sy"}), [*by, "y"])
    low = F.col("sx") <= F.col("sy")
    j = j.select(*by, "x", "y", F.when(low, F.col("x")).otherwise(F.col("y")).alias("s"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("b"))
    few = j.join(vectors.select(*by, F.col("sym").alias("s"), "feature", F.col("w").alias("ws")), [*by, "s"])
    both = few.join(vectors.select(*by, F.col("sym").alias("b"), "feature", F.col("w").alias("wb")), [*by, "b", "feature"])
    return both.groupBy(*by, "x", "y").agg(*[F.sum(c).alias(name) for name, c in terms.items()])


def cosine_join(vectors: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, x, y, dot, cosine) of all pairs over the threshold.

    Symbols of null and zero vectors pair with none; equal vectors pair; entries
    of one symbol and feature must be summed up before.
    """
    v = written(vectors.select(*by, "sym", "feature", "w"), "vectors")
    norm = v.groupBy(*by, "sym").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    j = compared(candidates(v, by, least), v, by, dot=F.col("ws") * F.col("wb"))
    j = j.join(norm.withColumnsRenamed({"sym": "x", "norm": "nx"}), [*by, "x"]).join(norm.withColumnsRenamed({"sym": "y", "norm": "ny"}), [*by, "y"])
    return j.select(*by, "x", "y", "dot", (F.col("dot") / (F.col("nx") * F.col("ny"))).alias("cosine")).where(F.col("cosine") > least)


def jaccard_join(sets: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, x, y, shared, dx, dy, jaccard) of all pairs of sets (by, sym, feature, each once) of at least the threshold.

    A Jaccard similarity of t is a cosine of 2 t / (1 + t) at least, since the mean
    of two sizes is not under their geometric mean.
    """
    v = written(sets.select(*by, "sym", "feature", F.lit(1).alias("w")), "vectors")
    size = v.groupBy(*by, "sym").agg(F.count("*").alias("size"))
    j = compared(candidates(v, by, 2 * least / (1 + least)), v, by, shared=F.col("ws") * F.col("wb"))
    j = j.join(size.withColumnsRenamed({"sym": "x", "size": "dx"}), [*by, "x"]).join(size.withColumnsRenamed({"sym": "y", "size": "dy"}), [*by, "y"])
    return j.select(*by, "x", "y", "shared", "dx", "dy", (F.col("shared") / (F.col("dx") + F.col("dy") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= least)


def divergence_join(shares: DataFrame, by: list[str], most: float) -> DataFrame:
    """(by, x, y, js) of all pairs of distributions (by, sym, feature, w; w sums to 1) whose Jensen-Shannon divergence in bits is at most so much, under 1.

    1 - JS is at most the cosine of the shares' square roots (the binary entropy
    of x is not over 2 sqrt(x (1 - x))), so those are joined at 1 - most.
    """
    v = written(shares.select(*by, "sym", "feature", "w"), "vectors")
    both = F.col("ws") + F.col("wb")
    term = F.col("ws") * F.log2(F.col("ws") / both) + F.col("wb") * F.log2(F.col("wb") / both)
    found = candidates(v.withColumn("w", F.sqrt("w")), by, 1 - most)
    return compared(found, v, by, terms=term).select(*by, "x", "y", (1 + 0.5 * F.col("terms")).alias("js")).where(F.col("js") <= most)
