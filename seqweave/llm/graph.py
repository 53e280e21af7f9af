"""Connected components as a chain of DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node.

    Each round every node hooks onto its neighbour of lowest hash and the graph is
    contracted along the hooks; hashes keep chains short whatever the order of the
    ids, so rounds grow with the logarithm of the graph. All steps are joins and
    aggregations that combine before they shuffle; nothing reaches the driver but
    the answer to "are there edges left?". Loops and rows with nulls are ignored;
    repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    home = None
    while not both.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        hook = materialise(both.groupBy("u").agg(F.min(rank("v")).alias("low")).select("u", F.least("low", rank("u"))["n"].alias("p")), "hooks")
        at_u = hook.select("u", F.col("p").alias("pu"))
        at_v = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = both.join(at_u, "u").join(at_v, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        if home is None:
            home = hook.select(F.col("u").alias("node"), F.col("p").alias("at"))
        else:
            home = materialise(home.join(hook.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("p", "at").alias("at")), "homes")
        both = materialise(left, "edges")
    if home is None:
        return pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    least = home.groupBy("at").agg(F.min("node").alias("component"))
    return home.join(least, "at").select("node", "component")
