"""Shortest paths and betweenness of weighted graphs, by joins on (source, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.tables import written


def shortest_distances(edges: DataFrame, sources: DataFrame, delta: int) -> DataFrame:
    """(s, v, d): distances from every source (s) over directed edges (a, b, length), whole lengths over 0.

    Delta-stepping: distances lie in buckets of width delta. The lowest bucket with
    open nodes is relaxed over short edges until none of its nodes changes, then
    its nodes reach over the long edges, once each. All sources are in one join.
    """
    light, heavy = edges.where(F.col("length") <= delta), edges.where(F.col("length") > delta)
    bucket = F.expr(f"d DIV {int(delta)}L")
    state = written(sources.select("s", F.col("s").alias("v"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("open")), "distances")

    def relax(state: DataFrame, from_: DataFrame, over: DataFrame, closed: Column) -> DataFrame:
        step = from_.join(over, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.min(F.col("d") + F.col("length")).alias("d"))
        old = state.select("s", "v", F.struct("d", F.lit(0).alias("new"), (F.col("open") & ~closed).alias("open")).alias("x"))
        new = step.select("s", "v", F.struct("d", F.lit(1).alias("new"), F.lit(True).alias("open")).alias("x"))
        return written(old.unionByName(new).groupBy("s", "v").agg(F.min("x").alias("x")).select("s", "v", "x.d", "x.open"), "distances")

    while (low := state.where("open").agg(F.min(bucket)).first()[0]) is not None:
        here = bucket == low
        while not (front := state.where(F.col("open") & here)).isEmpty():
            state = relax(state, front, light, here)
        state = relax(state, state.where(here), heavy, F.lit(False))
    return state.select("s", "v", "d")


def betweenness(edges: DataFrame, directed: bool = False, batch: int = 512, delta: int | None = None, normalized: bool = False) -> DataFrame:
    """(sym, betweenness): how often symbols stand on shortest paths between others, split where several are shortest (Brandes).

    edges (a, b, length): whole lengths over 0, of repeated edges the least; loops
    and edges with a null go. Undirected: each pair of ends counts once. Sources
    are taken in about so many at a time, so the state is batch times vocabulary.
    Path counts go by numbers of hops from the source, dependencies by hops back.
    No edges, no rows.
    """
    e = edges.where("a <> b AND length IS NOT NULL").select("a", "b", F.col("length").cast("long").alias("length"))
    e = e if directed else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    e = written(e.groupBy("a", "b").agg(F.min("length").alias("length")), "edges")
    nodes = written(e.select(F.col("a").alias("sym")).union(e.select("b")).distinct(), "nodes")
    least, mean, n = *e.agg(F.min("length"), F.avg("length")).first(), nodes.count()
    if n and least <= 0:
        raise ValueError("lengths have to be over 0")
    width = int(delta or max(1, mean or 1))
    batches = -(-n // batch)
    out = nodes.select("sym", F.lit(0.0).alias("part"))
    for k in range(batches):
        sources = nodes.where(F.pmod(F.xxhash64("sym"), F.lit(batches)) == k).select(F.col("sym").alias("s"))
        out = out.unionByName(written(_dependencies(e, shortest_distances(e, sources, width)), "dependencies"))
    scale = (1.0 if directed else 0.5) if not normalized else 1.0 / max(1, (n - 1) * (n - 2))
    return out.groupBy("sym").agg((F.sum("part") * scale).alias("betweenness"))


def _dependencies(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(sym, part): each node's dependencies summed over the sources of dist (s, v, d)."""
    up = dist.select("s", F.col("v").alias("a"), F.col("d").alias("da")).join(edges, "a").withColumn("d", F.col("da") + F.col("length"))
    on = written(up.select("s", "a", F.col("b").alias("v"), "d").join(dist, ["s", "v", "d"]).select("s", "a", F.col("v").alias("b")), "paths")  # edges on shortest paths
    at = dist.where("d = 0").select("s", F.col("v").alias("b"), F.lit(1.0).alias("paths"))
    counts = at
    while True:  # by hops
        at = written(on.join(at.withColumnRenamed("b", "a"), ["s", "a"]).groupBy("s", "b").agg(F.sum("paths").alias("paths")), "hops")
        if at.isEmpty():
            break
        counts = counts.unionByName(at)
    counts = counts.groupBy("s", "b").agg(F.sum("paths").alias("paths"))
    share = on.join(counts, ["s", "b"]).join(counts.select("s", F.col("b").alias("a"), F.col("paths").alias("above")), ["s", "a"])
    share = written(share.select("s", "a", "b", (F.col("above") / F.col("paths")).alias("share")), "shares")
    x, parts = share.groupBy("s", "a").agg(F.sum("share").alias("x")), None
    while not (x := written(x, "hops")).isEmpty():
        part = x.where("a <> s").groupBy(F.col("a").alias("sym")).agg(F.sum("x").alias("part"))
        parts = part if parts is None else parts.unionByName(part)
        x = share.join(x.withColumnsRenamed({"a": "b"}), ["s", "b"]).groupBy("s", "a").agg(F.sum(F.col("share") * F.col("x")).alias("x"))
    if parts is None:
        return x.select(F.col("a").alias("sym"), F.col("x").alias("part"))
    return parts.groupBy("sym").agg(F.sum("part").alias("part"))
