"""Clustering of integer vectors around centroids, in DataFrame functions.

A vector's components are scaled and rounded down to integers, so that sums and
distances are exact and don't depend on the order of rows. Distances to all
centroids, which are literals of the plan, come from zip_with and aggregate; the
nearest is the smallest struct (distance, cluster); new centroids come from one
aggregation whose columns are the sums of the components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm.common import materialise

#: Scaled components beyond this are set to it: 64 squares of differences then fit into 64 bits.
LARGEST = 1 << 27


def integral(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """(key, v): floor(scale * component) of the vectors with exactly dims components, none null or non-finite.

    Other vectors are left out. Scaled components are cut off at +-2**27. Repeated
    rows stay, a null key too; other columns are dropped.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * float(scale)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    return df.where((F.size(vector) == dims) & finite).select(F.col(key), whole.alias("v"))


def literal(numbers: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{x}L' for x in numbers)})")


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid by squared Euclidean distance; of equal ones the smaller number."""
    far = lambda c: F.aggregate(F.zip_with(v, literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda total, d: total + d)
    return F.array_min(F.array(*[F.struct(far(c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))


def seeds(vectors: DataFrame, key: str, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:key`, in that order; equal hashes (repeated keys) go by the vector."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.v) for r in vectors.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()]


def fit(vectors: DataFrame, key: str = "vec_id", k: int = 16, rounds: int = 3, seed: int = 1) -> list[list[int]]:
    """Centroids after so many rounds over vectors (key, v): k lists, fewer if there are fewer vectors.

    A round replaces every non-empty centroid by its vectors' componentwise
    floor(sum / count). The driver holds k rows of sums; each round is one scan
    with partial sums before the shuffle, so a centroid may hold most rows.
    """
    centroids = seeds(vectors, key, k, seed)
    for _ in range(rounds if centroids else 0):
        dims = len(centroids[0])
        near = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
        sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
        centroids = [list(c) for c in centroids]
        for r in sums.collect():
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], key: str = "vec_id") -> DataFrame:
    """key, cluster, distance, cluster_inertia and inertia of every vector (key, v).

    Inertia is the sum of squared distances, null where it is over 64 bits. No
    vectors, no rows.
    """
    if not centroids:
        return vectors.limit(0).select(key, *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))])
    found = vectors.select(key, nearest(F.col("v"), centroids).alias("m")).select(key, F.col("m.cluster").alias("cluster"), F.col("m.distance").alias("distance"))
    found = materialise(found, "clusters")
    sums = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    sums = sums.crossJoin(F.broadcast(found.agg(F.try_sum("distance").alias("inertia"))))  # one row
    return found.join(F.broadcast(sums), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia")  # a row per centroid


def centroid_table(spark: SparkSession, centroids: list[list[int]]) -> DataFrame:
    """(cluster, centroid) as rows."""
    return spark.createDataFrame(list(enumerate(centroids)), "cluster int, centroid array<long>")
