"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated K times, K ~ Poisson(rate of s); K comes from
inverting the distribution at a number hashed from the seed and the document's
id, so a re-run or a retried task gives the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import materialise, shuffle_partitions

#: Terms of the distribution beyond the rate: the rest weighs less than 2**-53.
TAIL = 40
#: Terms of all sources' distributions together, 8 bytes each, that are broadcast at most; beyond, an ordinary join.
MOST_TERMS = 2_000_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, 48 bits of it."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rates(df: DataFrame, source: str, size: Column, alpha: float, budget: float, weights: DataFrame | None = None, most_repeats: float | None = None) -> DataFrame:
    """Mean repetitions of each source's documents: (source, rate).

    weights (source, weight) are the targets; a source without one, or all if
    there are none, weighs its bytes to the power alpha. The expected bytes of a
    source are then its share of the weights times budget times all bytes.
    Empty sources get the rate 0, and so do sources whose weight is 0.
    most_repeats bounds the rates: what sources at the bound leave of their share
    goes to the others in proportion to their weights. Where all of them are at the
    bound, the expected bytes are fewer than the budget's.
    """
    sums = df.groupBy(F.col(source).alias("source")).agg(F.sum(size.cast("double")).alias("bytes"))
    own = F.pow("bytes", F.lit(float(alpha)))
    if weights is not None:
        sums = sums.join(weights.select("source", "weight"), "source", "left")
        own = F.coalesce(F.col("weight"), own)
    sums = sums.select("source", "bytes", own.alias("weight"))
    if most_repeats is not None:
        return _bounded(materialise(sums, "sources"), budget, float(most_repeats))
    whole = sums.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("bytes") > 0) & (F.col("all_weight") > 0), F.lit(float(budget)) * F.col("all_bytes") * (F.col("weight") / F.col("all_weight")) / F.col("bytes")).otherwise(0.0)
    return sums.crossJoin(F.broadcast(whole)).select("source", rate.alias("rate"))  # whole is one row


def _bounded(sums: DataFrame, budget: float, most: float) -> DataFrame:
    """Rates of min(most, level * weight / bytes), where the level spends the budget.

    The level rises as sources reach the bound, each round from two sums; it
    stops at the latest when all have.
    """
    has = (F.col("bytes") > 0) & (F.col("weight") > 0)
    goal, weight = sums.agg(F.sum("bytes") * float(budget), F.sum(F.when(has, F.col("weight")))).first()
    level = goal / weight if weight else 0.0
    while weight:
        full = has & (F.col("weight") * level > F.col("bytes") * most)
        used, rest = sums.agg(F.sum(F.when(full, F.col("bytes"))), F.sum(F.when(has & ~full, F.col("weight")))).first()
        if not rest or (goal - most * (used or 0.0)) / rest <= level * (1 + 1e-12):
            break
        level = (goal - most * used) / rest
    return sums.select("source", F.when(has, F.least(F.lit(most), F.lit(level) * F.col("weight") / F.col("bytes"))).otherwise(0.0).alias("rate"))


def with_cdf(rate_table: DataFrame) -> DataFrame:
    """Adds cdf: P(K <= k) for k = 0, 1, ... until the rest is negligible."""
    terms = F.sequence(F.lit(0), (F.ceil(F.col("rate") + 10 * F.sqrt("rate")) + TAIL).cast("int"))

    def step(state: Column, k: Column) -> Column:
        log_p = F.when(k == 0, -F.col("rate")).otherwise(state["log_p"] + F.ln("rate") - F.ln(F.greatest(k, F.lit(1)).cast("double")))
        total = state["total"] + F.when(F.col("rate") > 0, F.exp(log_p)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    start = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))
    return rate_table.withColumn("cdf", F.aggregate(terms, start, step, lambda s: s["cdf"]))


def mix(df: DataFrame, seed: str = "mix-1", alpha: float = 0.5, budget: float = 1.0, weights: DataFrame | None = None, source: str = "source", key: str = "doc_id", text: str = "text", detail: bool = True, most_repeats: float | None = None) -> DataFrame:
    """Every document as often as its Poisson count says, in a global random order.

    detail adds copy (from 0), n_copies and shuffle_key, by which the partitions
    are in order, one after the other, and each within itself; columns of these
    names in df are replaced. A source of null is a source of its own; a text of
    null or the empty text has size 0 and follows its source's rate; repeated
    rows have one id, hence the same count each. No rows give no rows. A rate over
    100,000 repetitions stops the job: weights that far off are a mistake, unless
    most_repeats bounds the rates (see rates). Names that begin with seqweave_ are
    kept for the operator.
    """
    extra = ["copy", "n_copies", "shuffle_key"]
    columns = [c for c in df.columns if c.lower() not in extra]
    size = F.coalesce(F.octet_length(text), F.lit(0))
    table = with_cdf(rates(df, source, size, alpha, budget, weights, most_repeats))
    table = table.select(F.coalesce("source", F.lit("\0null")).alias("_source"), F.when(F.col("rate") <= 100_000, F.col("cdf")).otherwise(F.raise_error(F.lit("rate over 100,000"))).alias("_cdf"))
    table = materialise(table.withColumnRenamed("_source", "seqweave_source").withColumnRenamed("_cdf", "seqweave_cdf"), "rates")
    if (table.agg(F.sum(F.size("seqweave_cdf"))).first()[0] or 0) <= MOST_TERMS:
        table = F.broadcast(table)
    drawn = df.select(*columns, F.coalesce(F.col(source), F.lit("\0null")).alias("seqweave_source"), uniform(F.lit(seed), F.col(key)).alias("seqweave_u")).join(table, "seqweave_source")
    copies = drawn.withColumn("n_copies", F.size(F.filter("seqweave_cdf", lambda c: c <= F.col("seqweave_u")))).where("n_copies > 0")
    each = copies.withColumn("copy", F.explode(F.expr("sequence(0, n_copies - 1)")))
    mixed = each.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("\\N")), F.col("copy").cast("string")).cast("binary")))
    n = shuffle_partitions(df.sparkSession)
    # keys are uniform, so equal parts of their range are even: no sampling pass is needed
    part = (F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(n) / F.lit(1 << 32)).cast("int")
    dealt = mixed.repartitionById(n, part).sortWithinPartitions("shuffle_key", key)
    return dealt.select(*columns, *(extra if detail else []))
