"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm import bpe, centroids, jaccard, langid, media, mixing, packing, quality, runs, secrets, sharding, toxicity, warc
from seqweave.llm.common import id_crc, table
from seqweave.llm.sql import ORACLE

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    parts = packing.pieces(docs, public_tokenizers.path(WORD_VOCABULARY), capacity)
    return packing.pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents")).withColumn("random_base", F.filter("verdicts", lambda v: v["random"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.spelled("base"), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"), secrets.spelled("random_base").alias("random_base"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.similar_documents(table(spark, sf_dir, "documents"), n=3, percent=90)
    return rows.select("doc_id", "n_shingles", "component_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.integral(table(spark, sf_dir, "embeddings"))
    found = centroids.fit(vectors)
    digests = centroids.centroid_table(spark, found).select("cluster", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))
    return centroids.assign(vectors, found).join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row per centroid


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where those whose id's CRC-32 is a multiple of 10 repeat a stretch of their words from some place to their end."""
    h, g, n = id_crc(F.col("doc_id")), F.floor(id_crc(F.col("doc_id")) / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    words = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    split = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    x = docs.select("doc_id", "text", split.alias("words")).select("doc_id", "text", "words", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    return x.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    x = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(spelled.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    size = -F.col("x.shorter")
    return x.select("doc_id", "n_runs", F.col("x.start").alias("start"), size.alias("length"), F.col("x.period").alias("period"), F.floor(1000 * size / F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_VOCABULARY)
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_warc, op2_language, op3_media, op4_mixing, op5_packing, op6_sharding, op7_quality, op8_secrets, op9_toxicity, op10_jaccard, op11_centroids, op12_runs, op13_bpe]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
