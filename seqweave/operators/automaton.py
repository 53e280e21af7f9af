"""Many words in many texts at once, by Aho-Corasick automata.

A join on n-grams finds words of a few symbols, a condition for each keyword those
of a short list. Words of any length from a long list are found in one pass over
each text instead: the list is written to the shared folder, in parts of a bounded
size, and each Python worker builds the automaton of a part once, whatever the
number of batches it reads.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.functions.exprs import ngrams
from seqweave.functions.tables import shared_folder, written

PART_BYTES = 1 << 20
#: Words of more symbols are found by so many of their first ones.
ANCHOR = 8

_built: dict[str, object] = {}


def _automaton(path: str):  # noqa: ANN202
    """The automaton of the words in a folder; a worker keeps the last one alone."""
    if path not in _built:
        import ahocorasick
        import pyarrow.dataset as ds
        from pyarrow import fs

        if path.startswith("file:") or "://" not in path:
            system, inner = fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
        else:
            system, inner = fs.FileSystem.from_uri(path)
        found = ahocorasick.Automaton()
        for word in ds.dataset(inner, format="parquet", filesystem=system).to_table(columns=["word"]).column(0).to_pylist():
            found.add_word(word, word)
        found.make_automaton()
        _built.clear()
        _built[path] = found
    return _built[path]


def occurrences(df: DataFrame, words: DataFrame, key: str, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, word, cnt): the words that stand anywhere in a text, overlapping ones too, and how often.

    words has a column word; nulls and empty ones go, repeated ones count once. Words
    are compared as they are. A text of null or without any gives no rows; rows that
    share a key, one of null as well, stay apart, so add up their counts if they are
    one. Texts are read once for every `part_bytes` of words, the bound on what an
    automaton is built of; a longer single word is a part of its own.
    """
    spark = df.sparkSession
    w = words.where("length(word) > 0").select("word").distinct()
    w = written(w, "words")
    size = w.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    # half filled on average, so that hashing doesn't overfill one
    parts = max(1, -(-2 * size // part_bytes)) if size > part_bytes else 1
    path = f"{shared_folder(spark)}/seqweave-parts-{uuid.uuid4().hex}"
    w.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts))).repartition(min(parts, 200), "part").write.partitionBy("part").parquet(path)
    filled = [r.part for r in w.select(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")).distinct().collect()]  # numbers of parts
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.col(text).alias("_text"))
    schema = f"`{key}` {kind}, word string, cnt long"

    def of(part: int) -> DataFrame:
        folder = f"{path}/part={part}"

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(folder)
            for batch in batches:
                at, word, cnt = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for w, n in Counter(v for _, v in found.iter(t)).items():
                        at.append(i)
                        word.append(w)
                        cnt.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(word, pa.string()), pa.array(cnt, pa.int64())], [key, "word", "cnt"])

        return rows.mapInArrow(fn, schema)

    if not filled:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [of(p) for p in sorted(filled)])


def phrase_matches(seq: DataFrame, vocabulary: DataFrame, separator: str = " ") -> DataFrame:
    """(word, meaning, cnt, sequences): words of the vocabulary of any number of symbols, where and in how many sequences they stand.

    vocabulary has word (symbols joined by the separator) and meaning; of a word that
    is listed more than once the smallest meaning stays, words of null or without
    symbols go. Null symbols are skipped. seq_id tells sequences apart. Sequences are
    read once, whatever the size of the vocabulary: their n-grams meet its words in a join.
    """
    cut = lambda c: F.split(c, f"\\Q{separator}\\E")
    v = written(vocabulary.where("length(word) > 0").groupBy("word").agg(F.min("meaning").alias("meaning")).withColumn("n", F.size(cut(F.col("word")))), "vocabulary")
    rows = written(seq.select("seq_id", cut(F.array_join("symbols", separator)).alias("symbols"), F.monotonically_increasing_id().alias("_row")), "texts")
    least, most = v.agg(F.min(F.least("n", F.lit(ANCHOR))), F.max("n")).first()
    if least is None:
        return rows.limit(0).select(F.lit("").alias("word"), F.lit(None).cast(dict(vocabulary.dtypes)["meaning"]).alias("meaning"), F.lit(0).cast("long").alias("cnt"), F.lit(0).cast("long").alias("sequences"))
    grams = lambda lo, hi: ngrams(rows, lo, hi, joined=False).withColumn("gram", F.array_join("gram", separator))
    found = grams(least, min(most, ANCHOR)).select("seq_id", F.col("gram").alias("word"))
    if most > ANCHOR:  # where the first symbols of a longer word stand, it is compared with what follows there
        begin = v.where(F.col("n") > ANCHOR).select(F.array_join(F.slice(cut(F.col("word")), 1, ANCHOR), separator).alias("gram"), F.col("n").alias("_n")).distinct()
        at = grams(ANCHOR, ANCHOR).select("_row", "at", "gram").join(begin, "gram").select("_row", "at", "_n")
        whole = rows.join(at, "_row").where(F.col("at") + F.col("_n") <= F.size("symbols"))
        found = found.unionByName(whole.select("seq_id", F.array_join(F.slice("symbols", F.col("at") + 1, F.col("_n")), separator).alias("word")))
    counts = found.join(v.select("word", "meaning"), "word").groupBy("word", "meaning").agg(F.count("*").alias("cnt"), F.countDistinct("seq_id").alias("sequences"))
    return counts.select("word", "meaning", "cnt", "sequences")


def topics_by_table(items: DataFrame, topics: DataFrame, key: str, text: str) -> DataFrame:
    """(key, topic): items with any keyword of a topic and none that it excludes, in lower case.

    topics has topic, keyword and excluded (null: no); it may be long. Keywords of null
    or nothing go; items of null have no topic; rows that share a key are one item.
    """
    t = topics.where("length(keyword) > 0").groupBy("topic", F.lower("keyword").alias("word")).agg(F.max(F.coalesce("excluded", F.lit(False))).alias("bad"))
    t = written(t, "topics")
    low = items.select(F.col(key), F.lower(text).alias("_low"))
    found = occurrences(low, t, key, "_low").select(key, "word")
    met = found.join(t, "word").groupBy(key, "topic").agg(F.max("bad").alias("bad"))
    return met.where("NOT bad").select(key, "topic")
