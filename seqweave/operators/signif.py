"""Significance by resampling: the replicate is one more grouping key, so all replicates are one job."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, hash_rank, join_ranks, join_small
from seqweave.functions.tables import written
from seqweave.operators.transforms import shuffle_within


def position_null(seq: DataFrame, seed: str, reps: int = 20) -> DataFrame:
    """For every symbol: how often sequences start and end with it, against shuffles within sequences; z and p."""
    # a filter on shuffled symbols would shuffle them twice
    ends = lambda d, by: d.select(*by, F.explode(F.array(F.struct(F.get("symbols", F.lit(0)).alias("sym"), F.lit("start").alias("end")), F.struct(F.element_at("symbols", -1).alias("sym"), F.lit("end").alias("end")))).alias("e")).groupBy(*by, "e.sym", "e.end").agg(F.count("*").alias("cnt"))
    seq = seq.where("size(symbols) > 1")
    seen = ends(seq.select("symbols"), [])
    null = ends(shuffle_within(seq.select("seq_id", "symbols"), seed, reps).select("rep", "symbols"), ["rep"])
    j = seen.join(null.withColumnRenamed("cnt", "null_cnt"), ["sym", "end"], "left")
    g = j.groupBy("sym", "end", "cnt").agg(F.coalesce(F.sum("null_cnt"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("null_cnt") * F.col("null_cnt")), F.lit(0)).alias("ss"), F.sum(F.when(F.col("null_cnt") >= F.col("cnt"), 1).otherwise(0)).alias("over"))
    mean = F.col("s") / reps
    var = F.greatest((F.col("ss") - reps * mean * mean) / (reps - 1), F.lit(0.0))
    z = F.when(var > 0, (F.col("cnt") - mean) / F.sqrt(var)).otherwise(0.0)
    return g.select("sym", "end", "cnt", mean.alias("null_mean"), z.alias("z"), F.greatest(F.col("over") / reps, F.lit(1.0 / reps)).alias("p"))


def context_association(seq: DataFrame, context: str, seed: str, reps: int = 20, least: int = 5) -> DataFrame:
    """PMI in nats of (symbol, context) over sequences, against contexts permuted over sequences within their hash order.

    A permutation maps the i-th sequence in one hash order to the context of the
    i-th in another; ranks come from cells of the hash, never from one sorted list.
    The corpus is read once, and the replicates' counts are written once.
    """
    s = written(seq.where(F.col(context).isNotNull()).select("seq_id", F.col(context).alias("ctx"), F.array_distinct("symbols").alias("symbols")), "contexts")
    base = s.select(F.lit(0).alias("rep"), "ctx", F.explode("symbols").alias("sym")).groupBy("rep", "sym", "ctx").agg(F.count("*").alias("cnt"))
    c = written(base.unionByName(permuted_counts(s, seed, reps)), "replicates")
    # totals combine before they shuffle; no task holds a replicate
    counts = c
    for name, keys in (("n", ["rep"]), ("cs", ["rep", "sym"]), ("cc", ["rep", "ctx"])):
        c = c.join(counts.groupBy(*keys).agg(F.sum("cnt").alias(name)), keys)
    c = c.withColumn("pmi", F.ln(F.col("cnt") * F.col("n") / (F.col("cs") * F.col("cc"))))
    seen = c.where((F.col("rep") == 0) & (F.col("cnt") >= least)).select("sym", "ctx", "cnt", "pmi")
    null = c.where("rep > 0").groupBy("sym", "ctx").agg(F.sum("pmi").alias("s"), F.sum(F.col("pmi") * F.col("pmi")).alias("ss"))
    j = seen.join(null, ["sym", "ctx"], "left").fillna(0.0, ["s", "ss"])
    mean = F.col("s") / reps  # a missing cell counts as a PMI of 0
    sd = F.sqrt(F.greatest((F.col("ss") - reps * mean * mean) / (reps - 1), F.lit(0.0)))
    return j.select("sym", "ctx", "cnt", "pmi", mean.alias("null_mean"), F.when(sd > 1e-9, (F.col("pmi") - mean) / sd).otherwise(0.0).alias("z"))


def _key(seed: str, kind: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(kind), F.col("rep").cast("string"), F.col("seq_id").cast("string")).cast("binary"))


def permuted(s: DataFrame, seed: str, reps: int) -> DataFrame:
    """(rep, seq_id, ctx, symbols) with contexts dealt anew in every replicate; their counts stay."""
    x = s.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    left = hash_rank(x.select("rep", "seq_id", "symbols", _key(seed, "a").alias("k")), "k", ["rep"]).select("rep", "seq_id", "symbols", "rank")
    right = hash_rank(x.select("rep", "seq_id", "ctx", _key(seed, "b").alias("k")), "k", ["rep"]).select("rep", "ctx", "rank")
    return join_ranks(left, right, ["rep"]).select("rep", "seq_id", "ctx", "symbols")


#: Rows that are hashed at a time, ranks that are met at a time, and rows of all replicates that are under way together.
CHUNK, RANKS, UNDER_WAY = 1 << 18, 1 << 16, 1 << 26


def permuted_counts(s: DataFrame, seed: str, reps: int) -> DataFrame:
    """(rep, sym, ctx, cnt): the rows of permuted, counted by symbol and context; s (seq_id, ctx, symbols).

    A few replicates at a time, so that disk doesn't grow with their number. 72 bits of hashes are compared; should two be equal, all 128.
    """
    kinds = {"sym": s.schema["symbols"].dataType.elementType, "ctx": s.schema["ctx"].dataType}
    x = s.select(F.coalesce(F.concat(F.lit("|"), F.col("seq_id").cast("string")), F.lit("")).alias("tail"), F.col("symbols").cast("array<string>").alias("a"), F.array(F.col("ctx").cast("string")).alias("b"))
    at_once = max(1, UNDER_WAY // max(1, s.count()))
    out = None
    for first in range(1, reps + 1, at_once):
        some = range(first, min(first + at_once, reps + 1))
        cells = _packed_cells(x, seed, some, 8)
        if not cells.where("ties").isEmpty():
            cells = _packed_cells(x, seed, some, 15)
        found = written(_met(cells), "met")
        out = found if out is None else out.unionByName(found)
    for c, own in (("sym", F.explode("symbols")), ("ctx", F.col("ctx"))):
        if kinds[c].simpleString() != "string":
            names = written(s.select(own.alias("own")).distinct().select("own", F.col("own").cast("string").alias("name")), "names")
            out = out.join(names, F.col(c).eqNullSafe(F.col("name"))).withColumn(c, F.col("own")).select("rep", "sym", "ctx", "cnt")
    return out


def _packed_cells(x: DataFrame, seed: str, reps: range, width: int) -> DataFrame:
    """(rep, side, cell, n, ties, sizes, codes, names): lists a and b of x (tail, a, b) in the order of the md5 of seed, side, replicate and tail.

    A cell holds hashes of one first byte. Rows travel packed by chunk and cell, with so many more
    bytes of their hash; items are codes, their names go along once. ties: these bytes left an order open.
    """
    numbers = list(reps)

    def keyed(batches: Iterator) -> Iterator:  # of Arrow batches
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        def least(v: np.ndarray) -> bytes:
            return v.astype(np.min_scalar_type(v.max(initial=0))).tobytes()

        def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            tails = [t.encode() for t in rows["tail"].to_pylist()]
            for side in "ab":
                lists = rows[side].combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy())
                held = lists.flatten().dictionary_encode(null_encoding="encode")
                names, codes = held.dictionary, held.indices.to_numpy().astype(np.int64)
                begins = np.concatenate(([0], np.cumsum(sizes)))
                for rep in numbers:
                    start = f"{seed}|{side}|{rep}".encode()
                    d = np.frombuffer(b"".join([md5(start + t).digest() for t in tails]), np.uint8).reshape(-1, 16)
                    order = np.argsort(d[:, 0], kind="stable")
                    d, n = d[order], sizes[order]
                    ends = np.cumsum(n)
                    own = codes[np.repeat(begins[order] - ends + n, n) + np.arange(n.sum())]
                    cells, at = np.unique(d[:, 0], return_index=True)
                    out = []
                    for cell, i, j in zip(cells.tolist(), at.tolist(), [*at[1:].tolist(), len(d)], strict=True):
                        used, part = np.unique(own[ends[i] - n[i] : ends[j - 1]], return_inverse=True)
                        out.append((rep, side, cell, d[i:j, 1 : 1 + width].tobytes(), least(n[i:j]), least(part), names.take(pa.array(used)).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())), strict=True)], ["rep", "side", "cell", "keys", "sizes", "codes", "names"])

        waiting, k = [], 0
        for batch in batches:
            waiting.append(batch)
            k += batch.num_rows
            if k >= CHUNK:
                yield from packed(pa.Table.from_batches(waiting))
                waiting, k = [], 0
        if k:
            yield from packed(pa.Table.from_batches(waiting))

    def merged(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        least = lambda v: v.astype(np.min_scalar_type(v.max(initial=0))).tobytes()
        whole = lambda b, n: np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) if n else np.empty(0, np.int64)
        keys = rows["keys"].to_pylist()
        sizes = [whole(b, len(k) // width) for b, k in zip(rows["sizes"].to_pylist(), keys, strict=True)]
        held = rows["names"].combine_chunks().flatten().dictionary_encode(null_encoding="encode")
        to, at, codes = held.indices.to_numpy(), 0, []
        for b, n, names in zip(rows["codes"].to_pylist(), sizes, rows["names"].to_pylist(), strict=True):
            codes.append(to[at : at + len(names)][whole(b, int(n.sum()))])
            at += len(names)
        d = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, width)
        both = np.ascontiguousarray(np.pad(d, ((0, 0), (0, 16 - width)))).view(">u8")
        order = np.lexsort((both[:, 1], both[:, 0])) if width > 8 else np.argsort(both[:, 0])
        both = both[order]
        ties = bool((both[1:] == both[:-1]).all(axis=1).any())
        sizes, codes = np.concatenate(sizes), np.concatenate(codes)
        begins, n = np.concatenate(([0], np.cumsum(sizes))), sizes[order]
        codes = codes[np.repeat(begins[order] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return pa.table({**{c: rows[c][:1] for c in ("rep", "side", "cell")}, "n": pa.array([len(n)], pa.int64()), "ties": [ties], "sizes": pa.array([least(n)], pa.binary()), "codes": pa.array([least(codes)], pa.binary()), "names": pa.array([held.dictionary.to_pylist()], pa.list_(pa.string()))})

    rows = x.mapInArrow(keyed, "rep int, side string, cell int, keys binary, sizes binary, codes binary, names array<string>")
    return written(rows.groupBy("rep", "side", "cell").applyInArrow(merged, "rep int, side string, cell int, n long, ties boolean, sizes binary, codes binary, names array<string>"), "cells")


def _met(cells: DataFrame) -> DataFrame:
    """(rep, sym, ctx, cnt): items of the i-th lists of both sides, a and b, counted together; cells from _packed_cells."""
    keys = ["rep", "side"]
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("n")
    x = join_small(cells.drop("ties"), cells.select(*keys, "cell", before.alias("first")), [*keys, "cell"], "inner")

    def cut(batches: Iterator) -> Iterator:  # into blocks of ranks
        import numpy as np
        import pyarrow as pa

        least = lambda v: v.astype(np.min_scalar_type(v.max(initial=0))).tobytes()
        whole = lambda b, n: np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) if n else np.empty(0, np.int64)
        for batch in batches:
            for r in batch.select(["rep", "side", "n", "first", "sizes", "codes", "names"]).to_pylist():
                sizes = whole(r["sizes"], r["n"])
                codes, begins, names = whole(r["codes"], int(sizes.sum())), np.concatenate(([0], np.cumsum(sizes))), pa.array(r["names"], pa.string())
                for block in range(r["first"] // RANKS, (r["first"] + r["n"] - 1) // RANKS + 1):
                    i, j = (min(max(at - r["first"], 0), r["n"]) for at in (block * RANKS, (block + 1) * RANKS))
                    used, part = np.unique(codes[begins[i] : begins[j]], return_inverse=True)
                    row = {"rep": pa.array([r["rep"]], pa.int32()), "block": pa.array([block], pa.int64()), "side": [r["side"]], "low": pa.array([r["first"] + i], pa.int64()), "n": pa.array([j - i], pa.int64()), "sizes": pa.array([least(sizes[i:j])], pa.binary()), "codes": pa.array([least(part)], pa.binary()), "names": pa.array([names.take(pa.array(used)).to_pylist()], pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_pydict(row)

    def counted(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        whole = lambda b, n: np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) if n else np.empty(0, np.int64)

        def side(name: str) -> tuple:
            mine = sorted((r for r in rows.to_pylist() if r["side"] == name), key=lambda r: r["low"])
            held = pa.array([x for r in mine for x in r["names"]], pa.string()).dictionary_encode(null_encoding="encode")
            to, at, sizes, codes = held.indices.to_numpy(), 0, [], []
            for r in mine:
                sizes.append(whole(r["sizes"], r["n"]))
                codes.append(to[at : at + len(r["names"])][whole(r["codes"], int(sizes[-1].sum()))])
                at += len(r["names"])
            return np.concatenate(sizes), np.concatenate(codes), held.dictionary

        (sizes, syms, sym_names), (_, ctx, ctx_names) = side("a"), side("b")
        pairs, n = np.unique(syms.astype(np.int64) * len(ctx_names) + np.repeat(ctx, sizes), return_counts=True)
        return pa.table({"rep": pa.array([rows["rep"][0].as_py()] * len(n), pa.int32()), "sym": sym_names.take(pa.array(pairs // len(ctx_names))), "ctx": ctx_names.take(pa.array(pairs % len(ctx_names))), "cnt": pa.array(n.astype(np.int64))})

    blocks = x.mapInArrow(cut, "rep int, block long, side string, low long, n long, sizes binary, codes binary, names array<string>")
    return blocks.groupBy("rep", "block").applyInArrow(counted, "rep int, sym string, ctx string, cnt long").groupBy("rep", "sym", "ctx").agg(F.sum("cnt").alias("cnt"))


def bootstrap_mean(values: DataFrame, value: str, key: str, by: list[str], seed: str, reps: int = 100) -> DataFrame:
    """Mean and percentile interval by Poisson(1) weights from hashes: replicates need no shuffle of rows, only sums by replicate."""
    u = lambda r: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), r.cast("string"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = lambda r: sum((F.when(u(r) >= c, 1.0).otherwise(0.0) for c in cuts), F.lit(0.0))
    x = values.select(*by, F.col(value).cast("double").alias("v"), key, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    m = x.withColumn("w", weight(F.col("rep"))).groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return m.groupBy(*by).agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def cohens_d(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Cohen's d with the pooled deviation."""
    s = lambda f, g, n: f(F.when(F.col(group) == g, F.col(value))).alias(n)
    x = df.agg(*[s(f, g, f"{n}{k}") for k, g in (("a", a), ("b", b)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return x.select(F.col("na").alias("n_a"), F.col("nb").alias("n_b"), ((F.col("ma") - F.col("mb")) / pooled).alias("d"))


def mann_whitney(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """U, rank-biserial r and z with the tie correction, from a histogram of values: ties share their mean rank and no pair is formed."""
    h = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(F.when(F.col(group) == a, 1).otherwise(0)).alias("ka"), F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.withColumn("mid", before + (F.col("k") + 1) / 2)
    g = h.agg(F.sum(F.col("mid") * F.col("ka")).alias("r"), F.sum("ka").alias("na"), F.sum("k").alias("n"), F.sum(F.pow(F.col("k").cast("double"), F.lit(3.0)) - F.col("k")).alias("t"))
    g = g.withColumn("nb", F.col("n") - F.col("na")).withColumn("u", F.col("r") - F.col("na") * (F.col("na") + 1) / 2)
    both, n = F.col("na").cast("double") * F.col("nb"), F.col("n").cast("double")
    sd = F.sqrt(both / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    return g.select(F.col("na").alias("n_a"), F.col("nb").alias("n_b"), "u", (2 * F.col("u") / both - 1).alias("r"), ((F.col("u") - both / 2) / sd).alias("z"))


def independence(seq: DataFrame, by: list[str]) -> DataFrame:
    """Chi-squared of bigrams against independence of their two places, per group."""
    c = bigrams(seq.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt"))
    x = c.join(c.groupBy(*by, "a").agg(F.sum("cnt").alias("ra")), [*by, "a"]).join(c.groupBy(*by, "b").agg(F.sum("cnt").alias("cb")), [*by, "b"])
    return x.groupBy(*by).agg((F.sum("cnt") * (F.sum(F.col("cnt") * F.col("cnt") / (F.col("ra") * F.col("cb"))) - 1)).alias("chi2"), F.sum("cnt").alias("n"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("dof"))
