"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects documents whose measure is over a cutoff. In each stratum a quarter
of the labelled documents, by a hash of the id, orders the cutoffs of all rules into
a path from mild to strict: the next step is the one that rejects the fewest more
good documents for the bad ones it catches. The other three quarters certify: along the path,
an exact binomial test of what all rules together reject has to refute "more than
the allowed share of the good ones". The path is fixed before these are looked at
and testing stops at the first failure, so one level serves a stratum; over the
strata levels follow Holm. Strata with too few good documents for even a spotless
test are tested as one, "(pooled)", with the next larger ones if they are too few
together; its guarantee holds for all of them as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.llm.common import id_crc, join_small, map_batches, materialise

#: The symbols that count, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Measures that reject when they are over a cutoff, and the cutoffs from mild to strict.
RULES = {
    "symbol_share": ("n_symbols / word_chars", [0.6, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02]),
    "dup_line_share": ("n_dup_lines / n_words", [0.3, 0.2, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "repeat_share": ("n_repeat_words / n_words", [0.29, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "long_words": ("word_chars / n_words", [40.0, 25.0, 18.0, 15.0, 13.0, 12.0, 11.0, 10.0]),
}


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows of so many words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(n, np.uint64)
    for i in range(window):
        total = total * np.uint64(0x2545F4914F6CDD1D) + h[i : i + n]
    ordered = np.sort(total)
    if (ordered[1:] != ordered[:-1]).all():  # equal windows have equal hashes
        return 0
    # windows named by their words, exactly: pairs of names get a name of their own
    name, width = ids, 1
    while width < window:
        step = min(width, window - width)
        pair = name[: len(name) - step] * (int(name.max()) + 1) + name[step:]
        name, width = np.unique(pair, return_inverse=True)[1], width + step
    again = np.bincount(name)[name] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words, window)


def measures(df: DataFrame, stratum: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, stratum, the measures and base_failed of each row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([measure(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, i]) for i in range(len(MEASURES))]], ["doc_id", "stratum", *MEASURES])

    kind = dict(df.dtypes)[key]
    docs = df.selectExpr(f"`{key}` AS doc_id", f"coalesce(CAST(`{stratum}` AS STRING), '(none)') AS stratum", f"`{text}` AS text")
    out = map_batches(docs, fn, f"doc_id {kind}, stratum string, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    ratio = np.concatenate(([0.0], np.log((n - i[1:] + 1) / i[1:]))) if k else np.zeros(1)
    logs = np.cumsum(ratio) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def path(good: np.ndarray, bad: np.ndarray, n_good: np.ndarray, n_bad: np.ndarray, steps: list[int]) -> list[tuple[int, ...]]:
    """Vectors of cutoffs, each one step stricter in one rule than the one before it.

    good and bad are rows of the rules' ranks (how many cutoffs a document is over)
    with their counts; a vector's entry k rejects ranks of k or more, 0 nobody.
    """
    at, out = [0] * len(steps), []

    def caught(v: list[int], ranks: np.ndarray, n: np.ndarray) -> int:
        hit = np.zeros(len(n), bool)
        for r, k in enumerate(v):
            if k:
                hit |= ranks[:, r] > steps[r] - k  # entry 1 is the mildest cutoff, which the highest rank alone is over
        return int(n[hit].sum())

    while any(a < s for a, s in zip(at, steps, strict=True)):
        now_good, now_bad = caught(at, good, n_good), caught(at, bad, n_bad)
        tried = []
        for r in range(len(steps)):
            if at[r] < steps[r]:
                v = [a + (k == r) for k, a in enumerate(at)]
                tried.append(((caught(v, good, n_good) - now_good + 0.1) / (caught(v, bad, n_bad) - now_bad + 1), at[r] / steps[r], r, v))
        at = min(tried)[3]
        out.append(tuple(at))
    return out


def tests_along(cells: pd.DataFrame, share: float) -> pd.DataFrame:
    """stratum, step, vector and p of each step of one stratum's path, from its cells (fold, good, r0, r1, ..., n)."""
    ranks = [f"r{k}" for k in range(len(RULES))]
    steps = [len(cuts) for _, cuts in RULES.values()]
    some = lambda good, fold: cells[(cells.good == good) & (cells.fold == fold)]
    a, b, c = some(1, "order"), some(0, "order"), some(1, "certify")
    n = int(c.n.sum())
    hit, out = c[ranks].to_numpy(np.int64), []
    for step, v in enumerate(path(a[ranks].to_numpy(np.int64), b[ranks].to_numpy(np.int64), a.n.to_numpy(), b.n.to_numpy(), steps)):
        rejected = np.zeros(len(c), bool)
        for r, k in enumerate(v):
            if k:
                rejected |= hit[:, r] > steps[r] - k
        k = int(c.n.to_numpy()[rejected].sum())
        out.append((cells.stratum.iloc[0], step, list(v), binomial_cdf(k, n, share) if n else 1.0))
    return pd.DataFrame(out, columns=["stratum", "step", "vector", "p"])


def thresholds(measured: DataFrame, labels: DataFrame, share: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, home, one column per rule): certified cutoffs of each stratum with labels, null where there is none.

    labels (doc_id, quality); a document with several labels is good only if all
    say so, labels of null don't count. Counts are made on Spark over all labelled
    documents; tasks then see a cell for each combination of ranks, 7,776 for each
    label and fold of a stratum at most. home is the stratum it was tested as.
    """
    named = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).cast("int").alias("good"))
    over = [F.expr(" + ".join(f"int({expr} > {c}D)" for c in cuts)).alias(f"r{k}") for k, (expr, cuts) in enumerate(RULES.values())]
    fold = F.when(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 0, "order").otherwise("certify").alias("fold")
    ranks = [f"r{k}" for k in range(len(RULES))]
    held = measured.where("NOT base_failed").join(named, "doc_id").select("stratum", fold, "good", *over)
    cells = materialise(held.groupBy("stratum", "fold", "good", *ranks).agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy("stratum").agg(F.sum(F.when((F.col("good") == 1) & (F.col("fold") == "certify"), F.col("n")).otherwise(0)).alias("size"))
    every = Window.partitionBy()  # over strata, not documents
    least = F.ceil(F.ln(F.lit(error) / F.count("*").over(every)) / math.log1p(-share))
    smaller = F.coalesce(F.sum("size").over(Window.orderBy("size", "stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("small", F.col("size") < least).withColumn("helps", F.max("small").over(every) & (smaller < least))
    homes = materialise(sizes.select("stratum", F.when(F.col("small"), F.lit("(pooled)")).otherwise(F.col("stratum")).alias("home"), (F.col("small") | F.col("helps")).alias("pooled")), "homes")
    placed = cells.join(F.broadcast(homes), "stratum").withColumn("home", F.explode(F.expr("array_distinct(array_compact(array(home, IF(pooled, '(pooled)', NULL))))")))
    grouped = placed.groupBy(F.col("home").alias("stratum"), "fold", "good", *ranks).agg(F.sum("n").alias("n"))
    tests = materialise(grouped.groupBy("stratum").applyInPandas(lambda pdf: tests_along(pdf, share), "stratum string, step int, vector array<int>, p double"), "tests")
    # Holm: a stratum whose whole path holds hands its level on
    ends = tests.groupBy("stratum").agg(F.max("p").alias("worst"))
    place, m = F.row_number().over(Window.orderBy("worst", "stratum")), F.count("*").over(Window.partitionBy())
    ends = ends.withColumn("ok", F.col("worst") <= error / (m - place + 1)).withColumn("m", m)
    done = ends.select("stratum", "m", (F.min(F.col("ok").cast("int")).over(Window.orderBy("worst", "stratum").rowsBetween(Window.unboundedPreceding, 0))).alias("done"))
    level = done.agg((F.lit(error) / F.greatest(F.max("m") - F.sum("done"), F.lit(1))).alias("level"))
    failed = tests.crossJoin(F.broadcast(level)).groupBy("stratum").agg(F.min(F.when(F.col("p") > F.col("level"), F.col("step"))).alias("first"))  # level is one row
    passed = tests.join(failed, "stratum").where("first IS NULL OR step < first").groupBy("stratum").agg(F.max_by("vector", "step").alias("vector"))
    cuts = [F.when(F.get("vector", F.lit(k)) > 0, F.get(F.array(*[F.lit(c) for c in values]), F.get("vector", F.lit(k)) - 1)).alias(rule) for k, (rule, (_, values)) in enumerate(RULES.items())]
    found = passed.select(F.col("stratum").alias("home"), *cuts)
    return homes.drop("pooled").unionByName(homes.sparkSession.createDataFrame([("(pooled)", "(pooled)")], "stratum string, home string")).dropDuplicates(["stratum"]).join(found, "home", "left").select("stratum", "home", *RULES)


def judge(df: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", text: str = "text", share: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, the measures, base_failed, reasons and kept of each row.

    kept is false if base_failed or if a rule with a certified cutoff in the row's
    stratum rejects it; a stratum without labels of its own is judged as "(pooled)".
    A text of null has no words and fails the base; a stratum of null is the
    stratum "(none)"; repeated rows are judged alike; no rows give no rows. Where
    the pooled strata too have too few good labels, or there are none at all, only
    the base decides. Other columns aren't looked at.
    """
    rows = materialise(measures(df, stratum, key, text), "measures")
    cuts = materialise(thresholds(rows, labels, share, error), "cutoffs")
    known = join_small(rows, cuts.select("stratum", F.col("stratum").alias("of")), ["stratum"]).withColumn("of", F.coalesce("of", F.lit("(pooled)")))
    judged = join_small(known, cuts.select(F.col("stratum").alias("of"), *RULES), ["of"])
    reasons = F.array_compact(F.array(*[F.when(F.expr(f"n_words > 0 AND {expr} > {rule}"), F.lit(rule)) for rule, (expr, _) in RULES.items()]))
    return judged.withColumn("reasons", reasons).select("doc_id", "stratum", *MEASURES, "base_failed", "reasons", F.expr("NOT base_failed AND size(reasons) = 0").alias("kept"))
