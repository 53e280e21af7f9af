"""Bootstraps and permutation nulls of whole measures; the replicate is one more grouping key."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import join_small, null_strata
from seqweave.functions.tables import written
from seqweave.operators import assoc, compare
from seqweave.operators.transforms import hashed

#: The Poisson distribution of mean 1, up to which its number is 0, 1, 2, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


#: Replicates whose weights one row holds as columns.
WIDTH = 8


def _steps(h: Column) -> Column:
    """Poisson(1) inverted at 8 hexadecimal digits, which are compared with those of the least number that reaches each step."""
    return sum((F.when(h >= f"{math.ceil(c * (1 << 32)):08x}", 1).otherwise(0) for c in POISSON), F.lit(0))


def weighted_counts(seq: DataFrame, by: list[str], seed: str, reps: int) -> DataFrame:
    """(rep, by, sym, cnt): counts of symbols, 0 as observed and from 1 on in resampled sequences.

    A token isn't repeated for each replicate: a row holds WIDTH weights, which are summed up beside each other.
    Hashes come out of a generator, so that the steps compare them without making them anew.
    """
    base = F.explode(F.sequence(F.lit(0), F.lit(reps), F.lit(WIDTH))).alias("base")
    rep = lambda j: F.col("base") + j
    digits = F.inline(F.array(F.struct(*[F.substring(hashed(seed, rep(j), F.col("seq_id")), 1, 8).alias(f"h{j}") for j in range(WIDTH)])))
    x = seq.select("seq_id", *by, "symbols", base).select("base", *by, "symbols", digits)
    weight = lambda j: F.when(rep(j) == 0, 1).when(rep(j) > reps, 0).otherwise(_steps(F.col(f"h{j}"))).alias(f"w{j}")
    w = x.select("base", *by, "symbols", *[weight(j) for j in range(WIDTH)]).select("base", *by, *[f"w{j}" for j in range(WIDTH)], F.explode("symbols").alias("sym"))
    g = w.groupBy("base", *by, "sym").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(WIDTH)])
    each = F.explode(F.array(*[F.struct(rep(j).alias("rep"), F.col(f"w{j}").alias("cnt")) for j in range(WIDTH)]))
    return g.select(*by, "sym", each.alias("e")).select("e.rep", *by, "sym", "e.cnt").where("cnt > 0")


def replicated(df: DataFrame, reps: int, least: int = 0) -> DataFrame:
    """A copy of each row for each replicate; 0 stands for what was observed."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(least), F.lit(reps))))


def divergence_bootstrap(seq: DataFrame, site: str, seed: str, reps: int = 200, smoothing: float = 1.0, robust: float = 0.3, supported: float = 0.1) -> DataFrame:
    """Symmetric KL (bits) of each pair of sites with the 95 % interval of resampled sequences, and a verdict by its lower bound."""
    counts = written(weighted_counts(seq, [site], seed, reps), "counts")
    d = compare.divergences(compare.stratum_pairs(counts, site, ["rep"]), smoothing).select("rep", "x", "y", ((F.col("kl") + F.col("kl_back")) / 2).alias("kl"))
    null = F.when(F.col("rep") > 0, F.col("kl"))
    g = d.groupBy("x", "y").agg(F.max(F.when(F.col("rep") == 0, F.col("kl"))).alias("kl"), F.avg(null).alias("mean"), F.percentile(null, 0.025).alias("low"), F.percentile(null, 0.975).alias("high"))
    return g.withColumn("verdict", F.when(F.col("low") > robust, "ROBUST").when(F.col("low") > supported, "SUPPORTED").otherwise("FRAGILE"))


#: Tokens that are dealt at a time, on average.
DEALT = 1 << 20


def dealt_bigrams(states: DataFrame, lengths: DataFrame, by: list[str], seed: str, reps: int) -> DataFrame:
    """(by, rep, a, b, cnt): neighbours once a stratum's tokens are dealt anew to its sequences, whose lengths stay.

    states (by, sym, cnt) and lengths (by, len, n) are all that a deal depends on, so no token is
    shuffled; a and b are places in the order of the stratum's symbols. Every token would draw a cell:
    each symbol's counts by cell are multinomial. Within its cell, tokens are shuffled; the cells in a row
    are an even permutation of all. They fill the sequences, shorter ones first, and a cell knows the
    first token of the next, for sequences that go on there.
    """
    from hashlib import md5

    import numpy as np

    def drawn(*parts: object) -> np.random.Generator:
        return np.random.default_rng(int(md5("|".join(map(str, parts)).encode()).hexdigest(), 16))

    kinds = dict(states.dtypes)
    bags = states.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sym", "cnt")))["cnt"].alias("bag"))
    sizes = lengths.where("len > 0").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("len", "n"))).alias("x")).select(*by, F.col("x.len").cast("array<long>").alias("lens"), F.col("x.n").alias("ns"))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
    strata = bags.join(sizes, by).select(*by, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), name.alias("name"), "bag", "lens", "ns")

    def celled(batches: Iterator) -> Iterator:  # of Arrow batches
        import pyarrow as pa

        for batch in batches:
            for i, (rep, stratum, bag, lens, ns) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("rep", "name", "bag", "lens", "ns")], strict=True)):
                k = -(-sum(bag) // DEALT)
                rng = drawn(seed, rep, stratum)
                split = rng.multinomial(np.array(bag), np.full(k, 1 / k))
                n = split.sum(0)
                ends, runs = np.cumsum(n), np.concatenate(([0], np.cumsum(np.array(lens) * np.array(ns))))
                held = np.flatnonzero(n)
                heads = [int(np.searchsorted(np.cumsum(split[:, j]), rng.integers(n[j]), "right")) for j in held]
                for at, j in enumerate(held):
                    low, high = np.searchsorted(runs, ends[j] - n[j], "right") - 1, np.searchsorted(runs[:-1], ends[j], "right")
                    row = {"cell": int(j), "start": int(ends[j] - n[j]), "head": heads[at], "after": heads[at + 1] if at + 1 < len(held) else -1, "bag": split[:, j], "lens": lens[low:high], "runs": runs[low:high]}
                    yield pa.RecordBatch.from_arrays([batch.column(c)[i : i + 1] for c in (*by, "rep", "name")] + [pa.array([v]) for v in row.values()], [*by, "rep", "name", *row])

    def dealt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, x in enumerate(batch.select(["rep", "name", "cell", "start", "head", "after", "bag", "lens", "runs"]).to_pylist()):
                bag, lens, runs = (np.array(x[c]) for c in ("bag", "lens", "runs"))
                bag[x["head"]] -= 1
                rest = np.repeat(np.arange(len(bag)), bag)
                drawn(seed, x["rep"], x["name"], x["cell"]).shuffle(rest)
                t = np.concatenate(([x["head"]], rest, [x["after"]] if x["after"] >= 0 else np.empty(0, int)))
                place = x["start"] + np.arange(1, len(t))
                run = np.searchsorted(runs, place, "right") - 1
                goes_on = (place - runs[run]) % lens[run] > 0
                cnt = np.bincount(t[:-1][goes_on] * len(bag) + t[1:][goes_on], minlength=1)
                met = np.flatnonzero(cnt)
                own = [pa.chunked_array([batch.column(c)]).take(pa.array(np.full(len(met), i))).combine_chunks() for c in (*by, "rep")]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (met // len(bag), met % len(bag), cnt[met]))], [*by, "rep", "a", "b", "cnt"])

    keys = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rep int"])
    cells = strata.mapInArrow(celled, f"{keys}, name string, cell long, start long, head long, after long, bag array<long>, lens array<long>, runs array<long>")
    spread = cells.repartition(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "rep", "cell")  # few bytes, much to do: not to be coalesced
    return spread.mapInArrow(dealt, f"{keys}, a long, b long, cnt long").groupBy(*by, "rep", "a", "b").agg(F.sum("cnt").alias("cnt"))


@null_strata
def gap_null(seq: DataFrame, by: list[str], seed: str, reps: int = 20, vocab: int = 200) -> DataFrame:
    """Spectral gap of each stratum against its tokens dealt anew to its sequences: p = (k + 1) / (n + 1), mean and quantiles of the null.

    Counts of symbols don't change, so the states of a deal are those observed: the top symbols and OTHER.
    """
    x = written(seq.select(*by, "symbols"), "sequences")  # read for symbols, lengths and neighbours
    counts, top = assoc.top_states(x, by, vocab)
    state = F.when(F.col("known"), F.col("sym")).otherwise("OTHER").alias("sym")
    states = counts.join(top, [*by, "sym"], "left").groupBy(*by, state).agg(F.sum("cnt").alias("cnt"))
    lengths = x.groupBy(*by, F.size("symbols").alias("len")).agg(F.count("*").alias("n"))
    null = assoc.transition_gaps(dealt_bigrams(states, lengths, by, seed, reps), [*by, "rep"]).select(*by, F.col("gap").alias("null_gap"))
    j = null.join(assoc.spectral_gap(x, by, vocab).select(*by, "gap"), by)
    g = j.groupBy(*by, "gap").agg(F.count("*").alias("n"), F.sum(F.when(F.col("null_gap") >= F.col("gap"), 1).otherwise(0)).alias("over"), F.avg("null_gap").alias("null_mean"), F.percentile("null_gap", 0.05).alias("null_p05"), F.percentile("null_gap", 0.95).alias("null_p95"))
    return g.select(*by, "gap", ((F.col("over") + 1) / (F.col("n") + 1)).alias("p"), "null_mean", "null_p05", "null_p95")


#: Rows that are hashed at a time, and ranks that are compared at a time.
CHUNK, RANKS = 1 << 18, 1 << 16
#: How kinds and lengths are stored, and what stands for a length of null.
KINDS, STORED, NO_LEN = ("n", "o"), {"a": "u1", "b": "<i4"}, -(1 << 31)


def _in_hash_order(pool: DataFrame, seed: str, reps: int, width: int) -> DataFrame:
    """(rep, stratum, side, cell, n, ties, items): kinds (side a) and lengths (side b) of pool (stratum, tail, kind, len) in the order of the md5 of seed, side, replicate and tail.

    A cell holds hashes of one first byte. Rows travel packed by chunk and cell, with so many
    more bytes of their hash; ties tells whether these left an order open.
    """

    def keyed(batches: Iterator) -> Iterator:  # of Arrow batches
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            names, of = np.unique(np.array(rows["stratum"].to_pylist(), object), return_inverse=True)
            tails = np.array([x.encode() for x in rows["tail"].to_pylist()], object)
            items = {side: rows[c].to_numpy().astype(STORED[side]) for side, c in (("a", "kind"), ("b", "len"))}
            for s, name in enumerate(names):
                mine = np.flatnonzero(of == s)
                own = tails[mine].tolist()
                for rep in range(1, reps + 1):
                    for side, values in items.items():
                        start = f"{seed}|{side}|{rep}|".encode()
                        d = np.frombuffer(b"".join([md5(start + x).digest() for x in own]), np.uint8).reshape(-1, 16)
                        order = np.argsort(d[:, 0], kind="stable")
                        d, v = d[order], values[mine[order]]
                        cells, at = np.unique(d[:, 0], return_index=True)
                        ends = [*at[1:].tolist(), len(d)]
                        keys = [d[i:j, 1 : 1 + width].tobytes() for i, j in zip(at.tolist(), ends, strict=True)]
                        vals = [v[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)]
                        k = len(cells)
                        yield pa.RecordBatch.from_arrays([pa.array([rep] * k, pa.int32()), pa.array([name] * k, pa.string()), pa.array([side] * k, pa.string()), pa.array(cells.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(vals, pa.binary())], ["rep", "stratum", "side", "cell", "keys", "items"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held))

    def merged(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        side = rows["side"][0].as_py()
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint8).reshape(-1, width)
        both = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, 16 - width)))).view(">u8")
        order = np.lexsort((both[:, 1], both[:, 0])) if width > 8 else np.argsort(both[:, 0])
        both = both[order]
        ties = bool((both[1:] == both[:-1]).all(axis=1).any())
        items = np.frombuffer(b"".join(rows["items"].to_pylist()), STORED[side])[order].tobytes()
        return pa.table({**{c: rows[c][:1] for c in ("rep", "stratum", "side", "cell")}, "n": pa.array([len(order)], pa.int64()), "ties": [ties], "items": pa.array([items], pa.binary())})

    rows = pool.mapInArrow(keyed, "rep int, stratum string, side string, cell int, keys binary, items binary")
    return written(rows.groupBy("rep", "stratum", "side", "cell").applyInArrow(merged, "rep int, stratum string, side string, cell int, n long, ties boolean, items binary"), "cells")


def dealt_lengths(pool: DataFrame, seed: str, reps: int) -> DataFrame:
    """(rep, stratum, kind, len, n): in each replicate, the i-th kind of a stratum in one hash order has the i-th length in another; counted.

    pool (stratum, tail, kind, len); tail is what the hash is of. 72 bits of hashes are compared; should two be equal, all 128.
    """
    coded = pool.select("stratum", "tail", F.when(F.col("kind") == KINDS[0], 0).otherwise(1).alias("kind"), F.coalesce("len", F.lit(NO_LEN)).alias("len"))
    cells = _in_hash_order(coded, seed, reps, 8)
    if not cells.where("ties").isEmpty():
        cells = _in_hash_order(coded, seed, reps, 15)
    keys = ["rep", "stratum", "side"]
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("n")
    x = join_small(cells.drop("ties"), cells.select(*keys, "cell", before.alias("first")), [*keys, "cell"], "inner")
    x = x.withColumn("block", F.explode(F.sequence(F.expr(f"first DIV {RANKS}"), F.expr(f"(first + n - 1) DIV {RANKS}"))))
    low, high = F.greatest("first", F.col("block") * RANKS), F.least(F.col("first") + F.col("n"), (F.col("block") + 1) * RANKS)
    size = F.when(F.col("side") == "a", 1).otherwise(4)
    piece = F.substring("items", ((low - F.col("first")) * size + 1).cast("int"), ((high - low) * size).cast("int"))

    def counted(rows):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        parts = sorted(zip(rows["low"].to_pylist(), rows["side"].to_pylist(), rows["piece"].to_pylist(), strict=True))
        a, b = (np.frombuffer(b"".join(p for _, s, p in parts if s == side), STORED[side]).astype(np.int64) for side in "ab")
        met, n = np.unique(np.stack((a, b)), axis=1, return_counts=True)
        k = len(n)
        return pa.table({"rep": pa.array([rows["rep"][0].as_py()] * k, pa.int32()), "stratum": pa.array([rows["stratum"][0].as_py()] * k, pa.string()), "kind": pa.array([KINDS[i] for i in met[0]], pa.string()), "len": pa.array([None if v == NO_LEN else v for v in met[1].tolist()], pa.int32()), "n": pa.array(n.astype(np.int64))})

    pieces = x.select("rep", "stratum", "block", "side", low.alias("low"), piece.alias("piece"))
    return pieces.groupBy("rep", "stratum", "block").applyInArrow(counted, "rep int, stratum string, kind string, len int, n long")


def readout_test(names: DataFrame, objects: DataFrame, stratum: str, seed: str, reps: int = 20, reach: int = 5) -> DataFrame:
    """For each name the best length score over a stratum's objects, summed, against lengths dealt anew between both: (stratum, total, matched, null_mean, p).

    names (id, len) meet every stratum of objects (id, len, stratum); p is the share
    of replicates whose total is at least the observed one. Lengths are grouped
    before they meet, so no pair of a name and an object is formed.
    """
    own = objects.where(F.col(stratum).isNotNull()).select(F.col(stratum).alias("stratum"), F.lit("o").alias("kind"), F.col("id").cast("string").alias("id"), "len")
    places = own.select("stratum", F.lit(1).alias("one")).distinct()
    each = join_small(names.select(F.lit(1).alias("one"), F.lit("n").alias("kind"), F.col("id").cast("string").alias("id"), "len"), places, ["one"], "inner")
    pool = own.unionByName(each.drop("one"))
    by = ["rep", "stratum"]
    pool = written(pool.select("stratum", "kind", F.concat_ws("|", "stratum", "kind", "id").alias("tail"), "len"), "pool")
    both = pool.groupBy(F.lit(0).alias("rep"), "stratum", "kind", "len").agg(F.count("*").alias("n")).unionByName(dealt_lengths(pool, seed, reps))
    c = written(both.groupBy(*by, "kind", "len").agg(F.sum("n").alias("n")), "lengths")
    met = c.where("kind = 'n'").withColumn("other", F.explode(F.sequence(F.col("len") - reach + 1, F.col("len") + reach - 1)))
    best = met.join(c.where("kind = 'o'").select(*by, F.col("len").alias("other")), [*by, "other"]).groupBy(*by, "len", "n").agg(F.max(1 - F.abs(F.col("len") - F.col("other")) / reach).alias("score"))
    t = best.groupBy(*by).agg(F.sum(F.col("n") * F.col("score")).alias("total"), F.sum("n").alias("matched"))
    seen, null = t.where("rep = 0").select("stratum", "total", "matched"), t.where("rep > 0").select("stratum", F.col("total").alias("v"))
    g = seen.join(null, "stratum", "left").groupBy("stratum", "total", "matched").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.sum(F.when(F.round("v", 9) >= F.round("total", 9), 1).otherwise(0)).alias("over"))
    return g.select("stratum", "total", "matched", (F.col("s") / reps).alias("null_mean"), (F.col("over") / reps).alias("p"))


def significant_strata(tested: DataFrame, level: float = 0.05) -> DataFrame:
    """How many strata of a test there are, and how many are under the level."""
    return tested.agg(F.count("*").alias("strata"), F.sum(F.when(F.col("p") < level, 1).otherwise(0)).alias("significant"))
