"""Shards by jump consistent hashing, with DataFrame functions only.

The jump hash (Lamping and Veach, 2014) of a 64-bit key walks through the shard
counts at which the key would move; it needs no ring table, and one more shard
takes about 1/(n+1) of the rows, all of them into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import materialise, shuffle_partitions

#: Steps that every key takes; about ln(shards) are needed.
STEPS = 64
#: Fixed value: the multiplier of the published generator, in 32-bit and 16-bit limbs.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW_1, _LOW_0 = _LOW >> 16, _LOW & 0xFFFF
_MASK = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2**64, on two unsigned 32-bit halves.

    Products are kept under 2**63 so that ANSI arithmetic never overflows.
    """
    p0, p1 = low * F.lit(_LOW_0) + F.lit(1), low * F.lit(_LOW_1)
    total = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(total, 32) + F.shiftright(p1, 16)
    cross = high * F.lit(_LOW_0) + F.shiftleft((high * F.lit(_LOW_1)).bitwiseAND(F.lit(0xFFFF)), 16) + low * F.lit(_HIGH)
    return (cross + carry).bitwiseAND(F.lit(_MASK)), total.bitwiseAND(F.lit(_MASK))


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the key's shard of `shards` and of `shards + 1`.

    Of the `shards` steps that a key could take, STEPS are written out for all; a key
    that isn't through by then, hardly ever one, goes on alone.
    """
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_MASK)).alias("low"),
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        # (at + 1) * 2**31 / ((state >> 33) + 1), rounded down
        to = F.floor((state["next"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("at"), to.cast("long").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    def done(state: Column) -> Column:
        grown = F.when(state["next"] == shards, F.lit(shards)).otherwise(state["at"])
        return F.struct(state["at"].cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))

    if shards <= STEPS:
        return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, done)
    rest = lambda s: F.when(s["next"] < shards, F.sequence(F.lit(STEPS + 1), F.lit(shards))).otherwise(F.array().cast("array<int>"))
    begun = F.array(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step))  # in an array, so that it is made once
    return F.get(F.transform(begun, lambda s: F.aggregate(rest(s), s, step, done)), F.lit(0))


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, overhead: int = 16) -> DataFrame:
    """Shard and slot of every row.

    Adds to the key: size (UTF-8 bytes of the text plus overhead), text_crc32,
    law ("key"), shard, slot and grown_shard (its shard if there were one more).
    Whole-number keys are hashed as they are, others by 64 bits of xxhash. A text of
    null counts as empty; a key of null counts as 0; repeated rows get
    slots of their own in the same shard; no rows give no rows. The input's other
    columns are not looked at. Slots run from 0 without gaps within a shard: each
    shard is cut into cells by key, cells are counted, and a row's slot is its
    cell's offset plus its rank in the cell, so no shard is ever in one task.
    """
    number = F.col(key).cast("long") if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    cells = max(64, -(-4 * shuffle_partitions(df.sparkSession) // shards))
    placed = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.coalesce(number, F.lit(0)), shards).alias("_at"),
    ).select("*", F.col("_at.shard"), F.col("_at.grown_shard"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt")).drop("_at")
    placed = materialise(placed, "placed").withColumn("_cell", F.pmod("_salt", F.lit(cells)))
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = F.expr("coalesce(sum(_n) OVER (PARTITION BY shard ORDER BY _cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    offsets = counts.select("shard", "_cell", before.alias("_before"))  # shards * cells rows at most
    rank = F.expr(f"row_number() OVER (PARTITION BY shard, _cell ORDER BY _salt, `{key}`)")
    return placed.withColumn("_rank", rank).join(F.broadcast(offsets), ["shard", "_cell"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard",
    )
