"""Alignment of parallel corpora, registries and joins on data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, top_per
from seqweave.operators.positions import start_end_counts


def crosswalk(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best match of each symbol from sequences of one id and equal length: confidence = best / all; confirmed, pending or ambiguous."""
    j = left.select("seq_id", F.col("symbols").alias("l")).join(right.select("seq_id", F.col("symbols").alias("r")), "seq_id").where("size(l) = size(r)")
    c = j.select(F.explode(F.arrays_zip("l", "r")).alias("p")).groupBy(F.col("p.l").alias("sym"), F.col("p.r").alias("match")).agg(F.count("*").alias("cnt"))
    c = c.withColumn("total", F.sum("cnt").over(Window.partitionBy("sym")))
    best = top_per(c, ["sym"], [F.desc("cnt"), "match"], 1).withColumn("confidence", F.col("cnt") / F.col("total"))
    return best.withColumn("status", F.when(F.col("confidence") >= 0.8, "confirmed").when(F.col("confidence") >= 0.5, "pending").otherwise("ambiguous"))


def common_subsequence(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places (i, t) of a longest common subsequence; of several the one that takes a match as soon as it is met and else moves on in x if that loses nothing.

    Row i holds, as the bits of one number, where the length for the suffixes x[i:]
    and y[t:] grows with y's suffix (bit-parallel recurrence): len(x) * len(y) / 64
    steps at worst. Every k-th row is kept, k = sqrt(len(x)), and those between are
    made again while the path is read, so memory is sqrt(len(x)) * len(y) / 4 bytes.
    """
    n, w = len(x), len(y)
    full = (1 << w) - 1
    at: dict[str, int] = {}
    for t, v in enumerate(y):
        at[v] = at.get(v, 0) | 1 << (w - 1 - t)

    def above(row: int, v: str) -> int:
        u = row & at.get(v, 0)
        return ((row + u) | (row - u)) & full

    step = max(int(n**0.5), 1)
    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, x[i])
        if i % step == 0:
            kept[i] = row
    out, i, t, rows, top = [], 0, 0, {}, -1
    while i < n and t < w:
        if x[i] == y[t]:
            out.append((i, t))
            i, t = i + 1, t + 1
            continue
        if i // step != top:
            top = i // step
            low = min((top + 1) * step, n)
            rows = {low: kept[low]}
            for k in range(low - 1, top * step - 1, -1):
                rows[k] = above(rows[k + 1], x[k])
        left = w - t
        grows = not rows[i] >> (left - 1) & 1  # the length falls if y[t] is left out
        if grows:
            i += 1
            continue
        part = (1 << left) - 1
        if (rows[i + 1] & part).bit_count() <= (rows[i] & part).bit_count():
            i += 1
        else:
            t += 1
    return out


def gap_fill(left: DataFrame, right: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """New pairs from gaps between known pairs, for sequences of any length: pairs of equal gaps, counted; (sym, match, cnt).

    The anchors of a pair of sequences are its longest common subsequence under
    the known mapping, found for one pair at a time in bits: see common_subsequence.
    """
    import pyarrow as pa

    j = left.select("seq_id", F.col("symbols").alias("l")).join(right.select("seq_id", F.col("symbols").alias("r")), "seq_id")
    k = known.select("sym", "match")
    pairs = j.withColumn("l2", F.col("l"))
    coded = j.select("seq_id", F.posexplode("l").alias("pos", "sym")).join(k, "sym", "left").groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("match", F.lit("")).alias("m")))), lambda x: x["m"]).alias("m"))
    x = pairs.drop("l2").join(coded, "seq_id")

    def gaps(l: list[str], m: list[str], r: list[str]) -> list[tuple[str, str]]:  # noqa: E741
        anchors = [(-1, -1), *common_subsequence(m, r), (len(l), len(r))]
        out = []
        for (a, b), (c, d) in zip(anchors, anchors[1:], strict=False):
            if c - a == d - b > 1:
                out += zip(l[a + 1 : c], r[b + 1 : d], strict=True)
        return out

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            got = [p for l, m, r in zip(*[batch.column(c).to_pylist() for c in ("l", "m", "r")], strict=True) for p in gaps(l, m, r)]  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.string()), pa.array([p[1] for p in got], pa.string())], ["sym", "match"])

    found = x.select("l", "m", "r").mapInArrow(run, "sym string, match string")
    return found.join(k.select("sym"), "sym", "left_anti").groupBy("sym", "match").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def registry(reference: DataFrame, seq: DataFrame) -> DataFrame:
    """Reference symbols and those of the corpus, with rates and where they come from."""
    r = start_end_counts(seq, []).select("sym", "n", "start_rate", "end_rate", "internal_rate").withColumn("in_corpus", F.lit(1))
    j = reference.select("sym").distinct().withColumn("in_reference", F.lit(1)).join(r, "sym", "full")
    return j.fillna(0).withColumn("origin", F.when((F.col("in_reference") == 1) & (F.col("in_corpus") == 1), "both").when(F.col("in_corpus") == 1, "corpus").otherwise("reference")).withColumn("id", F.substring(F.sha2("sym", 256), 1, 16))


def top_neighbours(seq: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Top left and right neighbours of each symbol, as sym:count lists."""
    p = bigrams(seq.select(*by, "symbols"))
    x = p.select(*by, F.explode(F.array(F.struct(F.col("a").alias("sym"), F.lit("right").alias("side"), F.col("b").alias("nb")), F.struct(F.col("b").alias("sym"), F.lit("left").alias("side"), F.col("a").alias("nb")))).alias("e")).select(*by, "e.*")
    c = x.groupBy(*by, "sym", "side", "nb").agg(F.count("*").alias("cnt"))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy(*by, "sym", "side").orderBy(F.desc("cnt"), "nb"))).where(F.col("k") <= k)
    s = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", "nb", F.col("cnt").cast("string")).alias("s")))), lambda v: v["s"]), ",")
    return c.groupBy(*by, "sym", "side").agg(s.alias("neighbours"))


def length_pairs(a: DataFrame, b: DataFrame, reach: int = 5) -> DataFrame:
    """Pairs (x, y) of keys whose lengths differ by less than reach, score 1 - |d| / reach.

    A range join as an equi-join on the length: a's rows are met at each length in
    reach; equal lengths are grouped first, so only counts are multiplied.
    """
    x = a.groupBy("len").agg(F.count("*").alias("na"))
    y = b.groupBy("len").agg(F.count("*").alias("nb")).select(F.col("len").alias("len_b"), "nb")
    near = x.withColumn("len_b", F.explode(F.sequence(F.col("len") - reach + 1, F.col("len") + reach - 1)))
    return near.join(y, "len_b").select("len", "len_b", "na", "nb", (1 - F.abs(F.col("len") - F.col("len_b")) / reach).alias("score"))


def entities(df: DataFrame, key: str, place: str, order: str) -> DataFrame:
    """Occurrences, distinct places and the first example of each entity."""
    return df.groupBy(key).agg(F.count("*").alias("occurrences"), F.count_distinct(place).alias("places"), F.min_by(place, order).alias("first_place"))
