"""Toxicity by a factorization machine over hashed terms.

Besides a weight for each term, terms have small vectors whose products are
pairwise interactions: a term can count for more beside another one.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import id_crc, map_batches

BUCKETS = 1 << 20
STEM = 5  # letters of the stem that longer words have as a term of its own
WORD = re.compile(r"\w+")


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the words, and of the longer ones' stems, of the whole text."""
    words = set(WORD.findall((text or "").lower()))
    words |= {w[:STEM] + "~" for w in words if len(w) > STEM}
    return np.unique(np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words)))


@dataclass
class Machine:
    """buckets are sorted; weights and vectors belong to them, one by one."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
            at = at[self.buckets[at] == found]
        else:
            at = np.empty(0, np.int64)
        v = self.vectors[at]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[at].sum()) + pairs, -30, 30))))


def select(rows: list[np.ndarray], y: np.ndarray, most: int, least: int = 3) -> np.ndarray:
    """The buckets whose presence goes with the label most, by chi-squared."""
    n, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, y, strict=True):  # a row holds a bucket once
        n[row] += 1
        hit[row] += label
    share = y.mean() if len(y) else 0.5
    chi = (hit - n * share) ** 2 / np.maximum(n * share * (1 - share) * (1 - n / (len(y) + 1)), 1e-9)
    chi[n < least] = 0
    order = np.lexsort((np.arange(BUCKETS), -chi))[:most]
    return np.sort(order[chi[order] > 6.6])


def partners(rows: list[np.ndarray], rest: np.ndarray, share: float, least: int = 3, block: int = 1024) -> np.ndarray:
    """The buckets of pairs that go with what single terms leave over of the label, by chi-squared with Bonferroni's bound.

    A pair in n rows whose rests sum up to s passes at s * s > bound * n; as abs(s) <= n,
    abs(s) > bound is needed, which a term must reach over its rows of either sign. No
    other pair can pass, so only these terms are multiplied, block by block.
    """
    n = np.zeros(BUCKETS, np.int64)
    signed = np.zeros((2, BUCKETS))
    for row, e in zip(rows, rest, strict=True):
        n[row] += 1
        signed[int(e < 0)][row] += abs(e)
    d = int((n >= least).sum())
    if d < 2 or not 0 < share < 1:
        return np.empty(0, np.int64)
    bound = NormalDist().inv_cdf(0.005 / (d * (d - 1) / 2)) ** 2 * share * (1 - share)
    kept = np.flatnonzero((n >= least) & (signed.max(0) > bound))
    where = np.full(BUCKETS, -1, np.int32)
    where[kept] = np.arange(len(kept))
    at = [where[row] for row in rows]
    at = [a[a >= 0] for a in at]
    doc, col = np.repeat(np.arange(len(rows), dtype=np.int32), [len(a) for a in at]), np.concatenate([*at, np.empty(0, np.int32)])
    order = np.argsort(col, kind="stable")
    doc, starts = doc[order], np.searchsorted(col[order], np.arange(len(kept) + 1))

    def dense(lo: int) -> np.ndarray:
        hi = min(lo + block, len(kept))
        x = np.zeros((len(rows), hi - lo), np.float32)
        x[doc[starts[lo] : starts[hi]], np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))] = 1
        return x

    found = np.zeros(len(kept), bool)
    for lo in range(0, len(kept), block):
        left = dense(lo)
        weighed = (left * rest[:, None].astype(np.float32)).T
        for lo2 in range(lo, len(kept), block):
            right = left if lo2 == lo else dense(lo2)
            sums = weighed @ right
            if lo2 == lo:
                np.fill_diagonal(sums, 0)
            a, b = np.nonzero(np.abs(sums) > bound)
            if len(a):
                both = (left.T @ right)[a, b]
                passed = sums[a, b].astype(float) ** 2 > bound * both
                found[lo + a[passed]] = found[lo2 + b[passed]] = True
    return kept[found]


def fit(rows: list[np.ndarray], y: np.ndarray, most: int = BUCKETS, rank: int = 6, epochs: int = 20, rate: float = 0.3, decay: float = 1e-5, seed: int = 7, over: float = 0.0) -> Machine:
    """Learns terms that go with the label on their own, at most `most`; then, where pairs of any terms go with what is left over, learns anew with these.

    over is the log of how much likelier toxic documents are to be in the sample
    than others; learning over, the bias is lowered by it, which is exact for log-odds.
    """
    mixed = 0 < y.sum() < len(y)
    buckets = select(rows, y, most) if mixed else np.empty(0, np.int64)
    m = learn(rows, y, buckets, rank, epochs, rate, decay, seed)
    if mixed:
        wider = np.union1d(buckets, partners(rows, y - np.array([m.score(r) for r in rows]), float(y.mean())))
        if len(wider) > len(buckets):
            m = learn(rows, y, wider, rank, epochs, rate, decay, seed)
    m.bias -= over
    return m


def learn(rows: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, rank: int, epochs: int, rate: float, decay: float, seed: int) -> Machine:
    """Logistic loss, AdaGrad on mini-batches; a fixed seed makes it repeatable."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    d, rng = len(buckets), np.random.default_rng(seed)
    m = Machine(float(np.log(share / (1 - share))), buckets, np.zeros(d), rng.normal(0, 0.02, (d, rank)))
    if not d:
        return m
    at = [np.flatnonzero(np.isin(buckets, r, assume_unique=True)).astype(np.int32) for r in rows]
    g0, gw, gv = 1e-3, np.full(d, 1e-3), np.full((d, rank), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for b in range(0, len(y), 128):
            batch = order[b : b + 128]
            idx = np.concatenate([at[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(at[i]) for i in batch])
            v = m.vectors[idx]
            s = np.stack([np.bincount(row, v[:, f], len(batch)) for f in range(rank)], 1)
            squares = np.bincount(row, (v**2).sum(1), len(batch))
            z = m.bias + np.bincount(row, m.weights[idx], len(batch)) + 0.5 * ((s**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            db = g.sum()
            dw = np.bincount(idx, g[row], d)
            each = g[row][:, None] * (s[row] - v)
            dv = np.stack([np.bincount(idx, each[:, f], d) for f in range(rank)], 1)
            seen = np.bincount(idx, minlength=d) > 0
            dw[seen] += decay * m.weights[seen]
            dv[seen] += 10 * decay * m.vectors[seen]
            g0, gw, gv = g0 + db**2, gw + dw**2, gv + dv**2
            m.bias -= rate * db / np.sqrt(g0)
            m.weights -= rate * dw / np.sqrt(gw)
            m.vectors -= rate * dv / np.sqrt(gv)
    return m


def training_rows(df: DataFrame, labels: DataFrame, per_class: int, key: str, text: str, label: str) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Terms and labels of about per_class documents of either label, 8 * per_class rows at most, and the log of the labels' sampling rates' ratio.

    Documents that the fold holds out (crc32 of the id modulo 5 is 0) aren't used.
    The sample is by a hash of the id; its ids, bounded as they are, are broadcast.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg((F.max(label) > 0).cast("int").alias("y")).where(F.pmod(id_crc(F.col("_id")), F.lit(5)) != 0)
    sizes = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    scale = 1 << 30
    rates = [int(scale * min(1, per_class / sizes.get(y, 1))) for y in (0, 1)]
    rate = F.when(F.col("y") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    chosen = named.where(F.pmod(F.xxhash64("_id"), F.lit(scale)) < rate)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "y", "terms"])

    docs = df.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    rows = map_batches(docs.select(F.col("_id").cast("string").alias("id"), "text", "y"), fn, "id string, y int, terms binary").orderBy(F.xxhash64("id", "terms")).limit(8 * per_class).collect()
    rows.sort(key=lambda r: (r.id, bytes(r.terms)))
    return [np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.y for r in rows], float), float(np.log(rates[1] / rates[0]))


def train(df: DataFrame, labels: DataFrame, per_class: int = 6000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Fits the machine on a bounded sample of the documents with a label; the bias is put back to the labels' shares.

    Labels of null, without an id or of a held-out document don't count; of several
    labels of a document the highest does; rows that repeat a labelled id are rows of
    the sample each, and of more than 8 * per_class of these those of the lowest hash
    are taken. With no labels, or one kind only, the score is the same for every text.
    """
    rows, y, over = training_rows(df, labels, per_class, key, text, label)
    return fit(rows, y, over=over)


def score(df: DataFrame, model: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    An empty text or one of null gets the machine's bias as its score; repeated
    rows score alike; an id of null counts as held out, with the remainder 0.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.array([model.score(terms(t)) for t in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    docs = df.select(F.col(key).alias("doc_id"), (F.pmod(id_crc(F.col(key)), F.lit(5)) == 0).alias("held_out"), F.col(text).alias("text"))
    return map_batches(docs, fn, f"doc_id {dict(df.dtypes)[key]}, held_out boolean, score double, predicted int")


def keep_civil(df: DataFrame, model: Machine, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of df, all columns as they are, whose score is under the limit.

    An empty text, or one of null, is scored by the bias alone; no rows give no rows.
    """
    place = df.columns.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.score(terms(t)) < limit for t in batch.column(place).to_pylist()], pa.bool_()))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, df.schema)
