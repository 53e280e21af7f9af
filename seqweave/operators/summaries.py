"""Networks over the flat stream, grids, sounds, readings and anchors with variants: summaries of several parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.functions.exprs import ranked
from seqweave.functions.tables import written
from seqweave.operators.measures import stream_ngram_counts, symbol_counts


def flat_nodes(seq: DataFrame, least: int = 1, top: int | None = None) -> DataFrame:
    """(sym, cnt): symbols with a count of at least `least`; with top, the most frequent of them, ties by symbol."""
    c = symbol_counts(seq).where((F.col("cnt") >= least) & F.col("sym").isNotNull())
    return c.select("sym", "cnt") if top is None else ranked(c, []).where(F.col("rank") <= top).select("sym", "cnt")


def flat_edges(seq: DataFrame, window: int = 2, least: int = 1, top: int | None = None, weight: int = 1, order: str = "seq_id") -> DataFrame:
    """(a, b, weight), a <= b: how often two nodes stand within a window of the flat stream of all sequences, pairs of a symbol with itself included.

    Sequences follow one another by a whole-number order. Pairs come from the counts
    of the stream's n-grams, so the stream itself is never in one place. Symbols
    hold no spaces; sequences without symbols are passed over.
    """
    g = stream_ngram_counts(seq.where("size(symbols) > 0").select(order, "symbols"), 2, window + 1, [], order)
    parts = F.split("gram", " ")
    x, y = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    pairs = g.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "cnt").groupBy("a", "b").agg(F.sum("cnt").cast("long").alias("weight")).where(F.col("weight") >= weight)
    nodes = written(flat_nodes(seq, least, top).select("sym"), "nodes")
    return reduce(lambda e, end: e.join(nodes.withColumnRenamed("sym", end), end), ("a", "b"), pairs).select("a", "b", "weight")


def flat_degrees(seq: DataFrame, window: int = 2, least: int = 1, top: int | None = None, weight: int = 1, order: str = "seq_id") -> DataFrame:
    """(sym, cnt, degree, strength) of the nodes of flat_edges; those without an edge have 0."""
    e = flat_edges(seq, window, least, top, weight, order)
    d = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("sym"), "weight").groupBy("sym").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return flat_nodes(seq, least, top).join(d, "sym", "left").fillna(0, ["degree", "strength"])


def grid_density(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: clusters of rows and of columns, cells that hold a symbol, density = cells / (rows * columns), and symbols in one of the two only."""
    r, c = (x.where("sym IS NOT NULL AND cluster IS NOT NULL").select("sym", F.col("cluster").alias(n)).distinct() for x, n in ((rows, "row"), (columns, "col")))
    j = r.join(c, "sym", "full")
    g = j.groupBy("row", "col").agg(F.count("*").alias("n"))  # a row for each cell
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    both = F.col("row").isNotNull() & F.col("col").isNotNull()
    out = g.agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("columns"), F.count(F.when(both, 1)).alias("cells"), n(F.col("col").isNull()).alias("row_only"), n(F.col("row").isNull()).alias("col_only"))
    return out.withColumn("density", F.col("cells") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1)))


def sound_similarity(words: DataFrame, word: str, by: str, digraphs: dict[str, int], letters: dict[str, int]) -> DataFrame:
    """(x, y, similarity): cosine of the shares of initial-sound groups of all pairs of strata x < y.

    A word's group is that of its first two letters, else of its first; words without
    a group and strata of null are left out, a stratum without any group has 0
    with all others. Strata and groups are few: words are counted first.
    """
    up = F.upper(word)
    group = F.coalesce(*[F.when(F.substring(up, 1, n) == k, F.lit(v)) for n, t in ((2, digraphs), (1, letters)) for k, v in t.items()])
    c = written(words.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("s"), group.alias("g")).agg(F.count("*").alias("n")), "sounds")
    strata = c.select("s").distinct()
    v = c.where("g IS NOT NULL")
    norm = v.groupBy("s").agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    side = lambda x: v.join(norm, "s").select(F.col("s").alias(x), "g", (F.col("n") / F.col("norm")).alias(f"w{x}"))
    met = side("x").join(side("y"), "g").where("x < y").groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("similarity"))
    pairs = strata.select(F.col("s").alias("x")).join(strata.select(F.col("s").alias("y")), F.col("x") < F.col("y"))
    return pairs.join(met, ["x", "y"], "left").fillna(0.0, ["similarity"])


def readings_summary(readings: DataFrame, dims: list[str], top: int = 50) -> DataFrame:
    """(dim, value, n, share) over readings (reading, coverage, dims...): all, those read in full, the most frequent readings, and counts by dimension.

    Dims `(all)` and `(full)` have one row each, `reading` and each dimension the top
    most frequent values, ties by value. share is of all readings; nulls and empty
    texts of a dimension aren't counted. One aggregation, and ranks by cells.
    """
    row = lambda d, v: F.struct(F.lit(d).alias("dim"), v.cast("string").alias("value"))
    each = [row("(all)", F.lit("")), F.when(F.col("coverage") >= 1, row("(full)", F.lit(""))), *[F.when(F.col(d) != "", row(d, F.col(d))) for d in ("reading", *dims)]]
    c = written(readings.select(F.explode(F.array_compact(F.array(*each))).alias("r")).groupBy("r.dim", "r.value").agg(F.count("*").alias("n")), "tally")
    total = c.where("dim = '(all)'").select(F.col("n").alias("total"))  # one row
    return ranked(c, ["dim"], "n", "value").where(F.col("rank") <= top).crossJoin(F.broadcast(total)).select("dim", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def anchors_with_variants(mapping: DataFrame, anchors: DataFrame, families: DataFrame, bonus: float = 0.25) -> DataFrame:
    """(sym, value, confidence, mapped, matches, variants, score) of each anchor.

    An anchor (sym, value, confidence) matches if the value its symbol is mapped to
    holds its own, letter case aside; it scores 2, 1 or 0.5 by its confidence (high,
    medium, other), half as much again where the mapping's confidence is high, and
    bonus for each other member of the symbol's families (sym, family) whose
    mapped value holds it too. Symbols are mapped once; unmapped ones match nothing.
    """
    m = mapping.where("value IS NOT NULL").groupBy("sym").agg(F.min_by(F.struct(F.lower("value").alias("v"), F.lower("confidence").alias("c")), "value").alias("m"))
    m = m.select("sym", F.col("m.v").alias("mapped"), F.col("m.c").alias("sure"))
    holds: Column = F.contains("mapped", F.lower("value"))
    a = anchors.select("sym", "value", "confidence").distinct()
    hit = a.join(m, "sym", "left").withColumn("matches", F.coalesce(holds, F.lit(False)))
    f = families.where("sym IS NOT NULL AND family IS NOT NULL").select("sym", "family").distinct()
    others = f.select(F.col("sym").alias("other"), "family").join(m.select(F.col("sym").alias("other"), "mapped"), "other")
    more = hit.where("matches").select("sym", "value", "confidence").join(f, "sym").join(others, "family").where((F.col("sym") != F.col("other")) & holds)
    more = more.groupBy("sym", "value", "confidence").agg(F.count_distinct("other").alias("variants"))
    x = hit.join(more.withColumnsRenamed({"sym": "_s", "value": "_v", "confidence": "_c"}), F.col("sym").eqNullSafe(F.col("_s")) & F.col("value").eqNullSafe(F.col("_v")) & F.col("confidence").eqNullSafe(F.col("_c")), "left").fillna(0, ["variants"])
    base = F.when(F.lower("confidence") == "high", 2.0).when(F.lower("confidence") == "medium", 1.0).otherwise(0.5) * F.when(F.col("sure") == "high", 1.5).otherwise(1.0)
    return x.select("sym", "value", "confidence", "mapped", "matches", "variants", F.when(F.col("matches"), base + bonus * F.col("variants")).otherwise(0.0).alias("score"))
