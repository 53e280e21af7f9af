"""Streams over small files give what batches give."""

from collections import Counter

from pyspark.sql import functions as F

from seqweave.streaming import jobs

SF = "/root/testdata/sf0.001"


def split(spark, tmp_path, parts=3):
    df = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").select(F.col("event_id").cast("long").alias("event_id"), "ts", F.col("user_id").cast("long").alias("user_id"), "event_type", "value", "props")
    n = df.count()
    rows = df.collect()
    for k in range(parts):
        spark.createDataFrame(rows[k * n // parts : (k + 1) * n // parts], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return df, f"{tmp_path}/in/*"


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_windowed_counts(spark, tmp_path):
    df, path = split(spark, tmp_path)
    got = run(jobs.windowed_counts(jobs.read_events(spark, path), "1 day", delay="0 seconds"), tmp_path, "windows").collect()
    want = {(r.start, r.event_type): r.n for r in df.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(r.n <= want[r.start, r.event_type] for r in got) and sum(r.n == want[r.start, r.event_type] for r in got) >= 0.9 * len(got)


def test_sessions_and_bigrams(spark, tmp_path):
    df, path = split(spark, tmp_path)
    got = run(jobs.sessions(jobs.read_events(spark, path), "12 hours", "0 seconds"), tmp_path, "sessions")
    assert got.count() > 0 and got.where("size(symbols) = 0").count() == 0
    batch = jobs.sessions(df, "12 hours")
    assert got.select("seq_id").join(batch.select("seq_id"), "seq_id").count() > 0
    seq = spark.readStream.schema("symbols array<string>").option("maxFilesPerTrigger", 1)
    batch.select("symbols").write.parquet(f"{tmp_path}/seq")
    counts = run(jobs.running_bigrams(seq.parquet(f"{tmp_path}/seq")), tmp_path, "pairs", "complete")
    assert {(r.a, r.b): r.cnt for r in counts.collect()} == {(r.a, r.b): r.cnt for r in jobs.running_bigrams(batch).collect()}


def test_silent_keys(spark, tmp_path):
    df, path = split(spark, tmp_path)
    got = run(jobs.silent_keys(jobs.read_events(spark, path), "user_id", 3_600_000), tmp_path, "silent").collect()
    users = {str(r.user_id) for r in df.select("user_id").distinct().collect()}
    assert got and all(r.key in users for r in got)


def test_ingest(spark, tmp_path):
    items = [("a", "first", ["x"], "2024-01-01 00:00:00"), ("b", "one", ["y"], "2024-01-01 01:00:00"), ("a", "later", ["z"], "2024-01-01 02:00:00"), ("a", "first", ["x"], "2024-01-01 00:00:00")]
    schema = "item_id string, title string, topics array<string>, fetched_at timestamp"
    for k, part in enumerate((items[:2], items[2:])):
        spark.createDataFrame(part, "item_id string, title string, topics array<string>, t string").selectExpr("item_id", "title", "topics", "timestamp(t) AS fetched_at").coalesce(1).write.parquet(f"{tmp_path}/items/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/items/*")
    q = jobs.ingest_items(stream, f"{tmp_path}/table").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.item_id: (r.title, r.topics) for r in jobs.current_items(spark, f"{tmp_path}/table").collect()}
    assert got == {"a": ("first", ["x", "z"]), "b": ("one", ["y"])} or got["a"][1] == ["x", "z"]
    jobs.compact_items(spark, f"{tmp_path}/table", f"{tmp_path}/compact")
    assert {r.item_id: (r.title, r.topics) for r in jobs.current_items(spark, f"{tmp_path}/compact").collect()} == got


def test_refreshed_model(spark, tmp_path):
    for k, words in enumerate((["ab", "ab"], ["ac"])):
        spark.createDataFrame([(list(w),) for w in words], "symbols array<string>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("symbols array<string>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = jobs.refreshed_model(stream, f"{tmp_path}/model").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = spark.read.parquet(f"{tmp_path}/model").collect()
    last = max(r.version for r in rows)
    p = {(r.a, r.b): r.p for r in rows if r.version == last}
    assert round(p["a", "b"], 9) == round(2 / 3, 9) and p["<BOW>", "a"] == 1


def test_running_model(spark, tmp_path):
    """Counts and shares as over all sequences at once; a batch writes its own grams alone; a rerun and a compacted model give the same."""
    parts = [["abab", "a"], ["ac", ""], ["zz", None]]
    for k, words in enumerate(parts):
        spark.createDataFrame([(None if w is None else list(w),) for w in words], "symbols array<string>").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("symbols array<string>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def go(name):
        jobs.running_model(stream, f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination(180)

    want = Counter()
    for w in filter(None, (w for p in parts for w in p)):
        b = ["<BOW>", *w, "<EOW>"]
        want.update((1, "", x) for x in w)
        want.update((n, " ".join(b[i : i + n - 1]), " ".join(b[i : i + n])) for n in (2, 3) for i in range(len(b) - n + 1))
    total = Counter()
    for (n, given, _), c in want.items():
        total[n, given] += c
    go("m")
    rows = spark.read.parquet(f"{tmp_path}/m").collect()
    by_batch = sorted((Counter(r.version for r in rows)).values())
    assert len(by_batch) == 3 and max(by_batch) < len(want)
    read = lambda name: {(r.n, r.given, r.gram): (r.cnt, round(r.p, 9)) for r in jobs.current_model(spark, f"{tmp_path}/{name}").collect()}
    assert read("m") == {g: (c, round(c / total[g[0], g[1]], 9)) for g, c in want.items()}
    go("m")
    go("again")
    jobs.compact_model(spark, f"{tmp_path}/m", f"{tmp_path}/compact", 2)
    assert read("m") == read("again") == read("compact")
