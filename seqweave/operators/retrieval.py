"""Retrieval of the best chunks for batches of queries: each chunk meets all queries at once, in its row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import top_per
from seqweave.functions.tables import written
from seqweave.operators.evidence import TERM, bags, idfs, in_bags, postings, with_idf

#: Scores are sums of doubles: bounds may be off by this much.
SLACK = 1e-8


@dataclass
class Index:
    """bags (key, n, bag, norm), a row for each chunk with its terms, and terms (term, df, idf)."""

    bags: DataFrame
    terms: DataFrame
    key: list[str]

    def meet(self, x: DataFrame, bags: DataFrame | None = None, on: tuple[str, ...] = ("term",)) -> DataFrame:
        """x (term, idf, ...) with key and w of the postings of its terms; vectors of chunks have length 1."""
        b = self.bags if bags is None else bags
        posts = in_bags(b, *[c for c in b.columns if c not in ("n", "bag")])
        return posts.join(x, list(on)).withColumn("w", F.col("tf") * F.col("idf") / F.col("norm"))


def build(chunks: DataFrame, key: list[str], text: str) -> Index:
    """TF-IDF index of chunks; tf = count / all, idf = ln((N + 1) / (df + 1)) + 1. Chunks without a term aren't in it, but count in N.

    A chunk's terms stay in one row; weights follow from counts when they are looked up.
    """
    n = chunks.count()
    b = written(bags(chunks.where(F.col(text).isNotNull()), key, text), "bags")
    terms = idfs(b, n)
    w = F.col("tf") * F.col("idf")
    norm = with_idf(in_bags(b, *key), terms).groupBy(*key).agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return Index(written(b.join(norm, key), "index"), terms, key)


def weighted(index: Index, queries: DataFrame, qid: str, text: str, unknown: bool = True) -> DataFrame:
    """(qid, term, qw, df, idf): queries as vectors of length 1.

    Terms that the index lacks go; before, they have an idf of 1 in the query's length, or with unknown=False none.
    """
    q = postings(queries.where(F.col(text).isNotNull()), [qid], text).join(index.terms, "term", "left" if unknown else "inner")
    q = q.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norm = q.groupBy(qid).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return written(q.join(norm, qid).where("df IS NOT NULL").select(qid, "term", (F.col("w") / F.col("norm")).alias("qw"), "df", "idf"), "queries")


def with_bounds(index: Index, q: DataFrame, qid: str, k: int, least: float, seeds: int = 3) -> DataFrame:
    """q with floor, the score that a chunk must reach, and essential.

    floor is the k-th best score by a query's rarest terms alone, or least. Terms
    by rising bound qw * top, as long as their bounds together stay under the
    floor, aren't essential: no chunk gets there by them alone. top is the largest w of a term.
    """
    top = index.meet(written(q.select("term", "idf").distinct(), "terms")).groupBy("term").agg(F.max("w").alias("top"))
    q = written(q.join(top, "term").select(qid, "term", "qw", "df", "idf", "top"), "queries")
    rare = top_per(q, [qid], ["df", "term"], seeds)
    some = index.meet(written(rare.select(qid, "term", "qw", "idf"), "rare")).groupBy(qid, *index.key).agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    best = top_per(some.select(qid, *index.key, "score"), [qid], [F.desc("score"), *index.key], k).groupBy(qid).agg(F.min("score").alias("low"), F.count("*").alias("n"))
    floors = best.where(F.col("n") == k).select(qid, "low")
    x = q.join(floors, qid, "left").withColumn("floor", F.greatest(F.coalesce("low", F.lit(least)), F.lit(float(least)))).drop("low")
    bound = F.col("qw") * F.col("top")
    reach = F.sum(bound).over(Window.partitionBy(qid).orderBy(bound, "term").rowsBetween(Window.unboundedPreceding, 0))
    return written(x.withColumn("bound", bound).withColumn("essential", reach >= F.col("floor") - SLACK), "bounds")


#: Rows of queries that the driver hands out at a time, cells of a matrix of terms and queries, and products that are formed at a time.
PASS, MATRIX, PRODUCTS = 1 << 16, 1 << 22, 1 << 20


def search(index: Index, q: DataFrame, qid: str, k: int = 5, least: float = 0.05) -> DataFrame:
    """(qid, rank, key, score): cosine top k of each query, by the score to nine decimals and then the key, cut at least.

    q is from weighted. Queries go to the chunks, so many rows at a time; a chunk's products with all of them are summed
    up where it stands, and a task hands on the k best of a query and their ties. So no pair of a query and a chunk
    is shuffled. Queries without a known term have no rows.
    """
    passes = -(-q.count() // PASS)
    found = None
    for p in range(passes):
        some = q if passes == 1 else q.where(F.pmod(F.xxhash64(qid), F.lit(passes)) == p)
        best = written(_best(index, some.select(qid, "term", "qw", "idf"), qid, k, least), "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = q.select(qid).crossJoin(index.bags.select(*index.key)).withColumn("score", F.lit(0.0)).limit(0)
    w = Window.partitionBy(qid).orderBy(F.desc(F.round("score", 9)), *index.key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(qid, "rank", *index.key, "score")


def _best(index: Index, q: DataFrame, qid: str, k: int, least: float) -> DataFrame:
    """(qid, key, score): from each batch of chunks those that may be among the k best of a query, q (qid, term, qw, idf)."""
    import numpy as np

    key, rows = index.key, q.toArrow().combine_chunks()

    def run(batches: Iterator) -> Iterator:  # of Arrow batches
        import pyarrow as pa
        import pyarrow.compute as pc

        terms, ids = (rows[c].combine_chunks().dictionary_encode() if rows[c].num_chunks else rows[c] for c in ("term", qid))
        term, query, qw = terms.indices.to_numpy(), ids.indices.to_numpy(), rows["qw"].to_numpy()
        idf = np.zeros(len(terms.dictionary))
        idf[term] = rows["idf"].to_numpy()
        order = np.argsort(query, kind="stable")
        ends = np.cumsum(np.bincount(query, minlength=len(ids.dictionary)))
        blocks, low = [], 0
        while low < len(ends):  # queries whose matrix isn't too large
            begin = ends[low - 1] if low else 0
            high = low + 1
            while high < len(ends) and (high + 1 - low) * (ends[high] - begin) <= MATRIX:
                high += 1
            mine = order[begin : ends[high - 1]]
            used, at = np.unique(term[mine], return_inverse=True)
            weights = np.zeros((len(used), high - low))
            weights[at, query[mine] - low] = qw[mine]
            place = np.full(len(idf) + 1, -1)
            place[used] = np.arange(len(used))
            blocks.append((low, place, weights))
            low = high
        floors = np.full(len(ends), float(least))
        for batch in batches:
            bags = batch["bag"]
            sizes = np.diff(bags.offsets.to_numpy())
            flat = bags.flatten()
            code = pc.fill_null(pc.index_in(flat.field("term"), value_set=terms.dictionary), len(idf)).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            known = code < len(idf)
            code, row = code[known], row[known]
            w = flat.field("c").to_numpy()[known] / batch["n"].to_numpy()[row] * idf[code] / batch["norm"].to_numpy()[row]
            keys = pa.table([batch[c] for c in key], names=key)
            after = np.empty(len(sizes), np.int64)
            after[pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in key]).to_numpy()] = np.arange(len(sizes))
            for low, place, weights in blocks:
                mine = np.flatnonzero(place[code] >= 0)
                if not len(mine):
                    continue
                met, starts = np.unique(row[mine], return_index=True)
                scores = np.empty((len(met), weights.shape[1]))
                step = max(1, PRODUCTS // weights.shape[1])
                i = 0
                while i < len(met):  # whole chunks
                    j = max(i + 1, int(np.searchsorted(starts, starts[i] + step, "right")) - 1)
                    part = mine[starts[i] : starts[j] if j < len(met) else len(mine)]
                    scores[i:j] = np.add.reduceat(weights[place[code[part]]] * w[part, None], starts[i:j] - starts[i], axis=0)
                    i = j
                n = weights.shape[1]
                if len(met) >= k:
                    kth = np.partition(scores, len(met) - k, axis=0)[len(met) - k]
                    floors[low : low + n] = np.maximum(floors[low : low + n], kth - SLACK)
                at, of = np.nonzero((scores >= floors[low : low + n]) & (scores >= least) & (scores > 0))
                got = scores[at, of]
                by = np.lexsort((after[met[at]], -np.round(got, 9), of))
                at, of, got = at[by], of[by], got[by]
                place_of = np.arange(len(of)) - np.searchsorted(of, of)
                sure = place_of < k
                at, of, got = met[at[sure]], of[sure], got[sure]
                yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(of + low)), *[batch[c].take(pa.array(at)) for c in key], pa.array(got)], [qid, *key, "score"])

    kinds = dict(q.dtypes) | dict(index.bags.dtypes)
    return index.bags.select(*key, "n", "bag", "norm").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (qid, *key)) + ", score double")


def without_repeats(found: DataFrame, chunks: DataFrame, qid: str, key: list[str], text: str, letters: int = 80) -> DataFrame:
    """found with the chunks' texts, of results of a query that begin with the same letters the best alone; after the top k, so fewer than k may stay."""
    x = written(written(found, "found").join(chunks.select(*key, F.col(text).alias("text")), key), "found")  # few rows: the chunks aren't shuffled
    first = x.groupBy(qid, F.substring("text", 1, letters).alias("_head")).agg(F.min("rank").alias("rank"))
    return x.join(first.select(qid, "rank"), [qid, "rank"])


__all__ = ["TERM", "Index", "build", "search", "weighted", "with_bounds", "without_repeats"]
