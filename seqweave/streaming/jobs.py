"""Structured Streaming versions of ingest, counting and session building."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, ngrams
from seqweave.operators.lm import bounded

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest_items(stream: DataFrame, directory: str, delay: str = "1 day"):  # noqa: ANN201
    """Continuous ingest of items (item_id, title, topics, fetched_at): repeats within the delay go, the rest is added batch by batch.

    A batch writes its own merged items under its number and nothing else, so its
    cost is that of the batch; a batch that runs again writes the same files again.
    current_items merges the batches, compact_items stores the merged table.
    """

    def add(batch: DataFrame, number: int) -> None:
        merged = batch.groupBy("item_id").agg(F.min_by("title", F.struct("fetched_at", "title")).alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"), F.max("fetched_at").alias("fetched_at"))
        merged.write.mode("overwrite").parquet(f"{directory}/version={number}")

    fresh = stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["item_id", "title", "fetched_at"])
    return fresh.writeStream.foreachBatch(add)


def current_items(spark: SparkSession, directory: str) -> DataFrame:
    """The items of all batches: the first batch's title stays, topics are merged, fetched_at is the latest."""
    added = spark.read.parquet(directory)
    topics = F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics"))))
    return added.groupBy("item_id").agg(F.min_by("title", F.struct("version", "fetched_at", "title")).alias("title"), topics.alias("topics"), F.max("fetched_at").alias("fetched_at"))


def compact_items(spark: SparkSession, directory: str, into: str, number: int = 0) -> None:
    """Writes the merged items as one version of a new directory, in which later batches can go on."""
    current_items(spark, directory).write.mode("overwrite").parquet(f"{into}/version={number}")


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user as sequences: symbols are event types by time and id."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return g.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("w.start").cast("string")).alias("seq_id"), "user_id", F.col("w.start").alias("start"), F.col("x.event_type").alias("symbols"))


def running_bigrams(seq: DataFrame) -> DataFrame:
    """Running bigram counts of a stream of sequences, for update mode."""
    return bigrams(seq.select("symbols")).groupBy("a", "b").agg(F.count("*").alias("cnt"))


def refreshed_model(seq: DataFrame, directory: str):  # noqa: ANN201
    """A stream of sequences as a bigram model with bounds, (a, b, cnt, p of b after a), written anew under each batch's number."""

    def write(counts: DataFrame, number: int) -> None:
        totals = counts.groupBy("a").agg(F.sum("cnt").alias("total"))
        counts.join(totals, "a").select("a", "b", "cnt", (F.col("cnt") / F.col("total")).alias("p")).write.mode("overwrite").parquet(f"{directory}/version={number}")

    return running_bigrams(bounded(seq.select("symbols"))).writeStream.outputMode("complete").foreachBatch(write)


def ngram_changes(seq: DataFrame, most: int = 3) -> DataFrame:
    """Running counts (n, given, gram, cnt) of a stream of sequences, for update mode: symbols, and n-grams with the sequences' bounds up to `most`.

    given is the gram without its last symbol; sequences of null or without symbols
    have no symbols, null symbols are skipped.
    """
    s = seq.select(F.array_compact("symbols").alias("symbols")).where("size(symbols) > 0")
    one = s.select(F.lit(1).alias("n"), F.lit("").alias("given"), F.explode("symbols").alias("gram"))
    if most > 1:
        g = ngrams(bounded(s), 2, most, joined=False)
        one = one.unionByName(g.select("n", F.array_join(F.slice("gram", F.lit(1), F.col("n") - 1), " ").alias("given"), F.array_join("gram", " ").alias("gram")))
    return one.groupBy("n", "given", "gram").agg(F.count("*").alias("cnt"))


def running_model(seq: DataFrame, directory: str, most: int = 3):  # noqa: ANN201
    """A stream of sequences as a model of n-grams: each batch writes under its number the grams whose counts changed, and nothing else.

    So a batch's cost is that of its own grams; a batch that runs again writes the
    same rows again. The state holds a count for each gram of the model.
    current_model merges the batches, compact_model stores the merged model.
    """

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{directory}/version={number}")

    return ngram_changes(seq, most).writeStream.outputMode("update").foreachBatch(write)


def current_model(spark: SparkSession, directory: str) -> DataFrame:
    """(n, given, gram, cnt, p): each gram's latest count, p within the grams of the same n and given."""
    schema = "n int, given string, gram string, cnt long, version long"
    c = spark.read.schema(schema).parquet(directory).groupBy("n", "given", "gram").agg(F.max_by("cnt", "version").alias("cnt"))
    return c.join(c.groupBy("n", "given").agg(F.sum("cnt").alias("total")), ["n", "given"]).select("n", "given", "gram", "cnt", (F.col("cnt") / F.col("total")).alias("p"))


def compact_model(spark: SparkSession, directory: str, into: str, number: int) -> None:
    """Writes the merged counts as version `number` (the last batch's) of a new directory, in which later batches of the stream can go on."""
    current_model(spark, directory).drop("p").write.mode("overwrite").parquet(f"{into}/version={number}")


def silent_keys(events: DataFrame, key: str, timeout_ms: int, delay: str = "1 minute") -> DataFrame:
    """Keys silent for longer than the timeout in event time: (key, last_seen). State holds one time per key."""

    def fn(k: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:  # noqa: ANN401
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [str(k[0])], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["ts"].max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(fn, "key string, last_seen timestamp", "last long", "append", "EventTimeTimeout")
