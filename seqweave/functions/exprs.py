"""Column expressions that several operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.tables import written

#: What a null stratum is called while groups are joined; it becomes null again in the result.
UNNAMED = "\0unnamed"
_named: ContextVar[bool] = ContextVar("named", default=False)


def null_strata(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets rows with a null in a text column of `by` be a group of their own: joins on grouping columns would lose them.

    For operators (seq, by, ...): nulls get a name before and lose it after.
    """

    @functools.wraps(operator)
    def run(seq: DataFrame, by: list[str], *args: object, **kwargs: object) -> DataFrame:
        texts = [c for c in by if dict(seq.dtypes).get(c) == "string"] if not _named.get() else []
        if not texts:
            return operator(seq, by, *args, **kwargs)
        token = _named.set(True)  # operators that this one calls leave the names alone
        try:
            out = operator(seq.withColumns({c: F.coalesce(c, F.lit(UNNAMED)) for c in texts}), by, *args, **kwargs)
        finally:
            _named.reset(token)
        return out.withColumns({c: F.nullif(F.col(c), F.lit(UNNAMED)) for c in texts if c in out.columns})

    return run


def r6(c: Column | str) -> Column:
    """Six decimals; a negative zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate, null where either doesn't vary (the built-in one divides by zero there)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def unrolled(df: DataFrame, array: Column | str, pos: str, item: str, *keep: Column | str) -> DataFrame:
    """keep, pos (from 0) and item of each element of an array.

    An outer generator, whose one row of an empty array goes: before an inner one the planner
    tests the array's size, in a filter that makes the whole array once more.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def tokens(seq: DataFrame) -> DataFrame:
    """One row per token: the sequence's columns, pos from 0, sym and len."""
    keep = [c for c in seq.columns if c != "symbols"]
    return unrolled(seq, "symbols", "pos", "sym", *keep, F.size("symbols").alias("len"))


def ngrams(seq: DataFrame, least: int, most: int | None = None, joined: bool = True) -> DataFrame:
    """n-grams within sequences: the sequence's columns, n, at (from 0) and gram."""
    keep = [c for c in seq.columns if c != "symbols"]
    most = most or least
    size = F.greatest(F.size("symbols"), F.lit(0))
    ahead = F.arrays_zip(*[F.slice("symbols", F.lit(k + 1), size).alias(f"s{k}") for k in range(most)])  # null beyond the end
    rows = unrolled(seq, ahead, "at", "_g", *keep, size.alias("_len")).where(F.col("at") + least <= F.col("_len"))
    n = F.lit(least) if least == most else F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.col("_len") - F.col("at"))))
    rows = rows.select(*keep, n.alias("n"), "at", F.array(*[F.col(f"_g.s{k}") for k in range(most)]).alias("gram"))
    gram = F.col("gram") if least == most else F.slice("gram", F.lit(1), F.col("n"))
    return rows.select(*keep, "n", "at", (F.array_join(gram, " ") if joined else gram).alias("gram"))


def bigrams(seq: DataFrame, lag: int = 1) -> DataFrame:
    """Pairs (a, b) at a distance within sequences, cheaper than general n-grams."""
    keep = [c for c in seq.columns if c != "symbols"]
    size = F.size("symbols")
    pairs = F.arrays_zip(F.slice("symbols", F.lit(1), F.greatest(size - lag, F.lit(0))).alias("a"), F.slice("symbols", F.lit(lag + 1), F.greatest(size - lag, F.lit(0))).alias("b"))
    return unrolled(seq, pairs, "_at", "p", *keep).select(*keep, F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def entropy(counts: DataFrame, by: list[str], base2: bool = True, cnt: str = "cnt") -> DataFrame:
    """by, h, n and types from a table of counts, in one aggregation: H = log N - sum(c log c) / N."""
    log = F.log2 if base2 else F.ln
    c, n = F.col(cnt).cast("double"), F.sum(F.col(cnt).cast("double"))
    return counts.groupBy(*by).agg((log(n) - F.sum(c * log(c)) / n).alias("h"), F.sum(cnt).cast("long").alias("n"), F.count("*").alias("types"))


def ranked(counts: DataFrame, by: list[str], cnt: str = "cnt", sym: str = "sym") -> DataFrame:
    """Adds rank: the place by falling count, then symbol, within by.

    No task ever sorts a whole vocabulary: rows are ranked within (count, the
    symbol's first two letters), and those cells' sizes are summed up.
    """
    cell = [*by, cnt, "_p"]
    rows = counts.withColumn("_p", F.substring(sym, 1, 2))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(F.desc(cnt), "_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, before.alias("_before"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(sym)))
    return rows.join(cells, cell).withColumn("rank", (F.col("_before") + F.col("_r")).cast("long")).drop("_p", "_before", "_r")


def top_per(df: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group, in a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Joins a table of groups, which is written once: the planner broadcasts it if its size is under the session's threshold."""
    return df.join(written(small, "groups"), on, how)


def hash_rank(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Adds rank: the place by a hexadecimal hash within by, from the sizes of the 256 cells of its first byte.

    Rows travel with the hash's bytes, half as long as its digits; key isn't in the result.
    """
    d = df.withColumn(key, F.unhex(key)).withColumn("_c", F.substring(key, 1, 1))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = d.groupBy(*by, "_c").agg(F.count("*").alias("_n")).select(*by, "_c", before.alias("_b"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_c").orderBy(key)))
    return d.join(cells, [*by, "_c"]).withColumn("rank", F.col("_b") + F.col("_r")).drop("_c", "_b", "_r", key)


def join_ranks(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The rows of equal rank within by.

    The join is named: the sizes of replicated rows are guessed from the compressed files they
    come from, and the planner would send all of them through the driver to broadcast them.
    """
    return left.join(right.hint("merge"), [*by, "rank"])


def kth_smallest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest value (from 1) of a whole-number column, null values left out.

    The range is cut into 4096 equal cells, which are counted; the cell that
    holds the place is cut again. No task sorts the rows, 4096 counts a round
    reach the driver, and a 64-bit range takes six rounds at most.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        width = (high - low) // 4096 + 1
        inside = df.where(F.col(column).between(low, high))
        cells = sorted((r.c, r.n) for r in inside.groupBy(F.expr(f"(`{column}` - {low}L) DIV {width}L").alias("c")).agg(F.count("*").alias("n")).collect())
        for c, n in cells:
            if k <= n:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            k -= n
        else:
            return None
    return low
