"""What pairs of documents and written tables leave on disk, at sizes that only show on large inputs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from seqweave.functions import tables
from seqweave.llm import common, jaccard


def test_counts_tell_large_sets_apart():
    rng = np.random.default_rng(5)
    scheme = jaccard.Scheme(80)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    for size, more in ((0, 3), (5, 0), (300, 40), (4000, 3900), (20_000, 70_000)):
        x = draw(size)
        y = np.unique(np.concatenate((x[size // 5 :], draw(more))))
        apart = len(np.setxor1d(x, y))
        assert jaccard.least_difference(jaccard.counts(x), jaccard.counts(y)) <= apart  # a bound, so no pair is lost
        assert jaccard.least_difference(jaccard.counts(x), jaccard.counts(x)) == 0
    x, y = draw(4000), draw(4000)
    assert np.bitwise_count(jaccard.sketch(x) ^ jaccard.sketch(y)).sum() <= scheme.difference(8000)  # their sketches don't tell them apart
    assert jaccard.least_difference(jaccard.counts(x), jaccard.counts(y)) > scheme.difference(8000)
    many = np.arange(0, 1 << 24, 1 << 8, dtype=np.uint64)  # all at one place, cut at 255
    assert jaccard.counts(many).max() == 255 and jaccard.least_difference(jaccard.counts(many), jaccard.counts(many[:300])) <= len(many) - 300


def test_texts_of_distant_pairs_are_not_shuffled(spark):
    rng = random.Random(8)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(4000))
    one = text()
    docs = spark.createDataFrame([(1, one), (2, text()), (3, one + " more"), (4, text())], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    texts = jaccard._texts(docs, pairs, "doc_id", "text", 5)
    assert jaccard._near(pairs, texts, 80).collect() == [(1, 3)]
    assert jaccard._verified(pairs, texts, 5, 80).collect() == [(1, 3)]


def test_shuffle_files_go_with_a_write(spark):
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, kept = files(), spark.conf.get(tables.CLEANUP, None)
    for write in (tables.written, lambda df: common.materialise(df, "t")):
        df = write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert len(df.collect()) == 7
    for _ in range(50):  # files are removed beside what follows
        if not files() - before:
            break
        time.sleep(0.1)
    assert files() - before == set() and spark.conf.get(tables.CLEANUP, None) == kept
