"""Choice of a number of clusters: silhouettes from moments, entropy reduction, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import join_small, ratio
from seqweave.functions.tables import written


def clusterings(points: DataFrame, columns: list[str], ks: list[int], seed: int = 7) -> DataFrame:
    """(k, sym, cluster) of bisecting k-means over standardised columns, for each k below the number of symbols.

    Nulls count as 0, a column without variance as 0 throughout; a k that the points can't be cut into gives fewer
    clusters. A symbol is listed once in points.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    x = written(standardised(points, columns), "points")
    # bisecting starts from a centre moved by a share of its norm, so the centre must not be 0: distances don't change
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(x.select("sym", *[(F.col(c) + 1).alias(c) for c in columns]))
    n = x.count()
    empty = x.select(F.lit(0).alias("k"), "sym", F.lit(0).alias("cluster")).where("false")
    each = [BisectingKMeans(k=k, seed=seed).fit(x).transform(x).select(F.lit(k).alias("k"), "sym", F.col("prediction").alias("cluster")) for k in ks if 2 <= k < n]
    return reduce(DataFrame.unionByName, each, empty)


def standardised(points: DataFrame, columns: list[str]) -> DataFrame:
    """sym and the columns with mean 0 and standard deviation 1 over all rows (0 where a column doesn't vary); nulls count as 0 before."""
    x = points.select("sym", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    s = x.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    x = x.crossJoin(F.broadcast(s))  # one row
    return x.select("sym", *[ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in columns])


def silhouettes(points: DataFrame, columns: list[str], assigned: DataFrame) -> DataFrame:
    """(k, silhouette): mean silhouette of each clustering under squared distances, all clusterings in one job.

    The mean distance of a point to a cluster follows from the cluster's size, mean
    and mean squared norm, so points meet clusters instead of each other. A point
    alone in its cluster, or in the only one, counts as 0.
    """
    sq = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    x = written(assigned.select("k", "sym", "cluster").join(points.select("sym", *columns).withColumn("_q", sq), "sym"), "assigned")
    moments = x.groupBy("k", F.col("cluster").alias("_other")).agg(F.count("*").alias("_n"), F.avg("_q").alias("_s"), *[F.avg(c).alias(f"_m_{c}") for c in columns])
    dot = sum((F.col(c) * F.col(f"_m_{c}") for c in columns), F.lit(0.0))
    d = join_small(x, moments, ["k"], "inner").withColumn("_d", F.greatest(F.col("_q") - 2 * dot + F.col("_s"), F.lit(0.0)))
    own = F.col("_other") == F.col("cluster")
    p = d.groupBy("k", "sym").agg(F.max(F.when(own, F.col("_n"))).alias("n"), F.max(F.when(own, F.col("_d"))).alias("d"), F.min(F.when(~own, F.col("_d"))).alias("b"))
    a = F.col("d") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))
    return p.groupBy("k").agg(F.avg(F.coalesce((F.col("b") - a) / F.nullif(F.greatest(a, F.col("b")), F.lit(0.0)), F.lit(0.0))).alias("silhouette"))


def choice(points: DataFrame, columns: list[str], assigned: DataFrame, most_share: float = 0.5, most_reduction: float = 0.9, least_clusters: int = 20) -> DataFrame:
    """(k, symbols, clusters, largest, silhouette, reduction, score, best, fault) of each clustering.

    score = silhouette * (1 + reduction), where reduction is 1 - entropy of the
    clusters' shares / log2 of the symbols; best is the highest score, ties go to
    the smaller k. fault names the first gate that a clustering fails: `crowded`
    (a cluster holds over most_share), `flat` (reduction over most_reduction),
    `few` (clusters under least_clusters); null if it passes all.
    """
    c = assigned.groupBy("k", "cluster").agg(F.count("*").alias("n"))
    n, v = F.sum("n"), F.col("n").cast("double")
    h = F.log2(n) - F.sum(v * F.log2(v)) / n
    g = c.groupBy("k").agg(n.cast("long").alias("symbols"), F.count("*").alias("clusters"), (F.max("n") / n).alias("largest"), F.when(n > 1, 1 - h / F.log2(n)).otherwise(0.0).alias("reduction"))
    g = g.join(silhouettes(points, columns, assigned), "k").withColumn("score", F.col("silhouette") * (1 + F.col("reduction")))
    fault = F.when(F.col("largest") > most_share, "crowded").when(F.col("reduction") > most_reduction, "flat").when(F.col("clusters") < least_clusters, "few")
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 4)), "k"))  # a row for each k
    return g.select("k", "symbols", "clusters", "largest", "silhouette", "reduction", "score", (first == 1).alias("best"), fault.alias("fault"))


def chosen(points: DataFrame, columns: list[str], ks: list[int], seed: int = 7, **gates: float) -> DataFrame:
    """(sym, cluster, k, score, fault): the clustering that choice finds best, with the gate it fails if any."""
    a = written(clusterings(points, columns, ks, seed), "clusterings")
    best = choice(written(standardised(points, columns), "points"), columns, a, **gates).where("best").select("k", "score", "fault")
    return a.join(F.broadcast(best), "k").select("sym", "cluster", "k", "score", "fault")  # one row
