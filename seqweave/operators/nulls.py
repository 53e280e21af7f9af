"""Permutation tests of any measure: the replicate is a key of the measure, 0 for what was observed, so a test is one job."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import hash_rank, join_ranks, tokens, unrolled
from seqweave.functions.tables import written
from seqweave.operators import positions
from seqweave.operators.resampling import replicated
from seqweave.operators.transforms import hashed

#: Measures are compared to so many decimals, so that the order of a sum doesn't decide a tie.
PLACES = 12


#: Tokens that are shuffled at a time.
CHUNK = 1 << 18


def shuffled_neighbours(seq: DataFrame, seed: str, reps: int) -> DataFrame:
    """(rep, sym, nb, first, last, cnt): tokens with the symbol after them and whether they start or end their sequence, counted and written once for all measures.

    Replicate 0 has the sequences as they are, the others as shuffle_within makes them. Shuffled sequences aren't
    written: a task counts those of so many tokens. 47 bits of hashes are compared; should two of a sequence be equal, all 128.
    """
    kind = seq.schema["symbols"].dataType.elementType

    def run(batches: Iterator) -> Iterator:  # of Arrow batches
        from hashlib import md5

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def counted(rep: int, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: pa.Array) -> pa.RecordBatch:
            first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
            first[starts], last[ends - 1] = True, True
            v = len(names)
            nb = np.where(last, 0, np.append(codes[1:], 0))
            key, n = np.unique(((codes * v + nb) * 2 + first) * 2 + last, return_counts=True)
            last, pair = pa.array(key % 2 > 0), key // 4
            after = pc.if_else(last, pa.scalar(None, pa.int64()), pa.array(pair % v))
            return pa.RecordBatch.from_arrays([pa.array([rep] * len(n), pa.int32()), names.take(pa.array(pair // v)), names.take(after), pa.array(key // 2 % 2 > 0), last, pa.array(n)], ["rep", "sym", "nb", "first", "last", "cnt"])

        def shuffled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            lists = rows["symbols"].combine_chunks()
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            starts = np.append(0, ends[:-1])
            held = lists.flatten().dictionary_encode(null_encoding="encode")
            names, codes = held.dictionary, held.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(ends), dtype=np.uint64), ends - starts)
            room = np.uint64(max(17, len(ends).bit_length()))
            place = [f"|{i}".encode() for i in range(int((ends - starts).max()))]
            tails = [t + p for t, n in zip((x.encode() for x in rows["tail"].to_pylist()), (ends - starts).tolist(), strict=True) for p in place[:n]]
            yield counted(0, codes, starts, ends, names)
            for rep in range(1, reps + 1):
                head = f"{seed}|{rep}".encode()
                d = np.frombuffer(b"".join([md5(head + t).digest() for t in tails]), ">u8").reshape(-1, 2).astype(np.uint64)
                key = row << (np.uint64(64) - room) | d[:, 0] >> room
                order = np.argsort(key)
                key = key[order]
                if (key[1:] == key[:-1]).any():
                    order = np.lexsort((d[:, 1], d[:, 0], row))
                yield counted(rep, codes[order], starts, ends, names)

        waiting, k = [], 0
        for batch in batches:
            waiting.append(batch)
            k += len(batch["symbols"].flatten())
            if k >= CHUNK:
                yield from shuffled(pa.Table.from_batches(waiting))
                waiting, k = [], 0
        if k:
            yield from shuffled(pa.Table.from_batches(waiting))

    x = seq.where("size(symbols) > 0").select(F.coalesce(F.concat(F.lit("|"), F.col("seq_id").cast("string")), F.lit("")).alias("tail"), "symbols")
    name = kind.simpleString()
    rows = x.mapInArrow(run, f"rep int, sym {name}, nb {name}, first boolean, last boolean, cnt long")
    return written(rows.groupBy("rep", "sym", "nb", "first", "last").agg(F.sum("cnt").alias("cnt")), "neighbours")


def _total(c: Column) -> Column:
    return F.sum(F.when(c, F.col("cnt")).otherwise(0))


def neighbour_rates(neighbours: DataFrame, by: list[str], min_count: int = 3) -> DataFrame:
    """positions.rates from counts of shuffled_neighbours."""
    c = neighbours.groupBy(*by, "sym").agg(F.sum("cnt").alias("n"), _total(F.col("first") & ~F.col("last")).alias("fi"), _total(F.col("last") & ~F.col("first")).alias("la"))
    return positions.classed(c, by, min_count)


def neighbour_polysemy(neighbours: DataFrame, by: list[str], targets: DataFrame, least: int = 3, bits: float = 0.3) -> DataFrame:
    """polysemy_rate from counts of shuffled_neighbours."""
    c = neighbours.where("NOT last").groupBy(*by, "sym", "nb").agg(_total(F.col("first")).alias("ci"), _total(~F.col("first")).alias("cr"))
    return _polysemy(c, by, targets, least, bits)


def neighbour_labels(neighbours: DataFrame) -> DataFrame:
    """label_counts from the counts of shuffled_neighbours that were observed."""
    both = F.col("first") & F.col("last")
    return neighbours.where("rep = 0").groupBy("sym").agg(_total(~both).alias("n"), _total(F.col("first") & ~both).alias("first"), _total(F.col("last") & ~both).alias("last"))


def tested(values: DataFrame, by: list[str], reps: int, value: str = "value") -> DataFrame:
    """by, observed, null_mean, null_sd, p95, p99, p, z and verdict of values (by, rep, value).

    A replicate without a row, or with a null, counts as 0, as does what was observed.
    p = (1 + null values of at least the observed) / (1 + reps); percentiles are the
    values at the places floor(q reps) of the sorted null, which is as long as reps.
    The verdict goes by the percentiles, then by one deviation over the mean.
    """
    null = F.when(F.col("rep") > 0, F.coalesce(value, F.lit(0.0)))
    g = values.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("rep") == 0, F.col(value))), F.lit(0.0)).alias("observed"), F.collect_list(null).alias("v"))
    g = g.withColumn("v", F.array_sort(F.concat("v", F.array_repeat(F.lit(0.0), reps - F.size("v")))))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x))
    g = g.withColumn("null_mean", total(lambda x: x) / reps)
    g = g.withColumn("null_sd", F.sqrt(total(lambda x: (x - F.col("null_mean")) * (x - F.col("null_mean"))) / reps))
    at = lambda q: F.get("v", F.lit(min(reps - 1, int(q * reps))))
    over = F.size(F.filter("v", lambda x: F.round(x, PLACES) >= F.round("observed", PLACES)))
    more = lambda c: F.round("observed", PLACES) > F.round(c, PLACES)
    verdict = F.when(more(F.col("p99")), "STRONGLY_CONFIRMED").when(more(F.col("p95")), "CONFIRMED").when(more(F.col("null_mean") + F.col("null_sd")), "BORDERLINE").otherwise("FAILED")
    z = F.when(F.col("null_sd") > 1e-9, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0)
    g = g.withColumns({"p95": at(0.95), "p99": at(0.99)})
    return g.select(*by, "observed", "null_mean", "null_sd", "p95", "p99", ((over + 1) / (reps + 1)).alias("p"), z.alias("z"), verdict.alias("verdict"))


def polysemy_rate(seq: DataFrame, by: list[str], targets: DataFrame, least: int = 3, bits: float = 0.3) -> DataFrame:
    """(by, value): share of target symbols (sym) whose right neighbours differ between starts and other places by over so many bits.

    KL with one added to each count of the neighbours met in either place; symbols
    with fewer than least neighbours in one of them count as not differing.
    """
    n = F.size("symbols") - 1
    most = F.greatest(n, F.lit(0))
    pair = F.arrays_zip(F.slice("symbols", F.lit(1), most).alias("sym"), F.slice("symbols", F.lit(2), most).alias("nb"))
    e = unrolled(seq, pair, "pos", "p", *by).select(*by, "p.*", (F.col("pos") == 0).alias("first"))
    c = e.groupBy(*by, "sym", "nb").agg(F.sum(F.when(F.col("first"), 1).otherwise(0)).alias("ci"), F.sum(F.when(F.col("first"), 0).otherwise(1)).alias("cr"))
    return _polysemy(c, by, targets, least, bits)


def _polysemy(c: DataFrame, by: list[str], targets: DataFrame, least: int, bits: float) -> DataFrame:
    """polysemy_rate from counts (by, sym, nb, ci, cr); targets meet these, not the tokens."""
    known = targets.select("sym").distinct()
    c = c.join(known, "sym", "left_semi")
    m = c.groupBy(*by, "sym").agg(F.sum("ci").alias("ni"), F.sum("cr").alias("nr"), F.count("*").alias("v")).where(f"ni >= {least} AND nr >= {least}")
    p, q = (F.col("ci") + 1) / (F.col("ni") + F.col("v")), (F.col("cr") + 1) / (F.col("nr") + F.col("v"))
    kl = c.join(m, [*by, "sym"]).groupBy(*by, "sym").agg(F.sum(p * F.log2(p / q)).alias("kl"))
    hit = F.sum(F.when(F.round("kl", 9) > bits, 1).otherwise(0))
    size = known.agg(F.count("*").alias("targets"))
    return kl.groupBy(*by).agg(hit.alias("hits")).crossJoin(F.broadcast(size)).select(*by, (F.col("hits") / F.col("targets")).alias("value"))


def label_counts(seq: DataFrame) -> DataFrame:
    """(sym, n, first, last): tokens of each symbol in sequences of two symbols and more, and those at a start and at an end."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x = tokens(seq.select("symbols"))
    return x.groupBy("sym").agg(n(F.col("len") > 1).alias("n"), n((F.col("pos") == 0) & (F.col("len") > 1)).alias("first"), n((F.col("pos") == F.col("len") - 1) & (F.col("len") > 1)).alias("last"))


def label_scores(counts: DataFrame, initial: DataFrame, terminal: DataFrame, seed: str, reps: int) -> DataFrame:
    """(rep, value): mean of the shares of initial labels' tokens at a start and of terminal labels' at an end, in sequences of two symbols and more.

    counts are those of label_counts. Replicates give as many labels of both kinds to other symbols, by the rank of
    an md5; symbols of the vocabulary alone take part.
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    flag = lambda d, name: d.select("sym", F.lit(True).alias(name)).distinct()
    c = written(counts.join(flag(initial, "i"), "sym", "left").join(flag(terminal, "t"), "sym", "left").fillna(False, ["i", "t"]), "labels")
    sizes = c.agg(n(F.col("t")).alias("nt"), n(F.col("i")).alias("ni"))
    ranked = hash_rank(replicated(c.select("sym", "n", "first", "last"), reps, 1).withColumn("h", hashed(seed, "label", F.col("rep"), F.col("sym"))), "h", ["rep"]).crossJoin(F.broadcast(sizes))
    null = ranked.select("rep", "n", "first", "last", ((F.col("rank") > F.col("nt")) & (F.col("rank") <= F.col("nt") + F.col("ni"))).alias("i"), (F.col("rank") <= F.col("nt")).alias("t"))
    both = c.select(F.lit(0).alias("rep"), "n", "first", "last", "i", "t").unionByName(null)
    share = lambda hit, label: F.coalesce(F.sum(F.when(F.col(label), F.col(hit))) / F.nullif(F.sum(F.when(F.col(label), F.col("n"))), F.lit(0)), F.lit(0.0))
    return both.groupBy("rep").agg(((share("first", "i") + share("last", "t")) / 2).alias("value"))


def one_to_one(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y, score, round): mutual-best pairs within each group, all groups in the same rounds; groups that are through have no rows left.

    The best pair of a group's rest is always mutual, so every round shrinks every
    group. Ties go to the smaller x, then y. Repeated pairs count as one, with
    their best score; rows with a null in x, y or score go.
    """
    left = written(scores.where("x IS NOT NULL AND y IS NOT NULL AND score IS NOT NULL").groupBy(*by, "x", "y").agg(F.max("score").alias("score")), "scores")
    out, r = left.limit(0).withColumn("round", F.lit(0)), 0
    order = F.struct((-F.col("score")).alias("s"), "x", "y")
    while not left.isEmpty():
        r += 1
        best = lambda c: left.groupBy(*by, c).agg(F.min(order).alias("m")).select(*by, "m.x", "m.y", (-F.col("m.s")).alias("score"))  # noqa: B023, E731
        got = written(best("x").join(best("y").select(*by, "x", "y"), [*by, "x", "y"]).select(*by, "x", "y", "score", F.lit(r).alias("round")), "pairs")
        out = out.unionByName(got)
        left = written(left.join(got.select(*by, "x"), [*by, "x"], "left_anti").join(got.select(*by, "y"), [*by, "y"], "left_anti"), "scores")
    return out


def assignment_test(scores: DataFrame, stratum: str, seed: str, reps: int = 20) -> DataFrame:
    """Total score of the mutual-best pairs of each stratum against scores dealt anew to its pairs: the columns of tested, by stratum.

    scores (stratum, x, y, score), each pair of a stratum once; strata of null are
    left out. All replicates of all strata are matched together.
    """
    pairs = written(scores.where(F.col(stratum).isNotNull()).select(F.col(stratum).alias("stratum"), "x", "y", "score"), "scores")
    x = replicated(pairs, reps, 1)
    by = ["rep", "stratum"]
    keyed = lambda kind: hashed(seed, kind, *[F.col(c) for c in ("rep", "stratum", "x", "y")])
    places = hash_rank(x.withColumn("h", keyed("pair")), "h", by).select(*by, "x", "y", "rank")
    dealt = hash_rank(x.withColumn("h", keyed("score")), "h", by).select(*by, "score", "rank")
    both = replicated(pairs, 0).select(*by, "x", "y", "score").unionByName(join_ranks(places, dealt, by).select(*by, "x", "y", "score"))
    totals = one_to_one(both, by).groupBy(*by).agg(F.sum("score").alias("value"))
    return tested(totals, ["stratum"], reps)


def best_length_pairs(names: DataFrame, objects: DataFrame, k: int = 50, reach: int = 5, least: int = 1) -> DataFrame:
    """The k best pairs (object, name, object_len, name_len, occurrences, score) with score = 1 - |difference| / reach over 0.

    names (name, len): equal names count as one, with their occurrences, of which
    there must be at least so many; objects (object, len). Order: score, object, name. Counts by length
    say at which difference k pairs are reached; nothing beyond it is joined, and
    of a length only the first k names and objects can be among the best.
    """
    n = names.where("name IS NOT NULL AND len IS NOT NULL").groupBy("name", "len").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)
    o = objects.where("object IS NOT NULL AND len IS NOT NULL").select("object", "len").distinct()
    n, o = written(n, "names"), written(o, "objects")
    size = lambda d, c: d.groupBy("len").agg(F.count("*").alias(c))
    offsets = F.explode(F.array(*[F.lit(d) for d in range(-reach + 1, reach)]))
    met = size(o, "no").withColumn("d", offsets).withColumn("near", F.col("len") + F.col("d")).join(size(n, "nn").withColumnRenamed("len", "near"), "near")
    counts = {r.d: r.n for r in met.groupBy(F.abs("d").alias("d")).agg(F.sum(F.col("no").cast("double") * F.col("nn")).alias("n")).collect()}  # reach rows
    widest, found = 0, 0
    for d in range(reach):
        found += counts.get(d, 0)
        widest = d
        if found >= k:
            break
    first = lambda df, c: df.withColumn("_r", F.row_number().over(Window.partitionBy("len").orderBy(c))).where(F.col("_r") <= k).drop("_r")
    x = first(o, "object").withColumn("near", F.explode(F.sequence(F.col("len") - widest, F.col("len") + widest)))
    j = x.join(first(n, "name").withColumnRenamed("len", "name_len"), F.col("near") == F.col("name_len"))
    j = j.select("object", "name", F.col("len").alias("object_len"), "name_len", "occurrences", (1 - F.abs(F.col("len") - F.col("name_len")) / reach).alias("score"))
    return j.orderBy(F.desc("score"), "object", "name").limit(k)
