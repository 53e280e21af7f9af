"""Readers and writers of corpora in the forms they come in; all give (seq_id, symbols, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.exprs import tokens


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def read_lines(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """A sequence for each line of text files, symbols apart by white space; shorter ones go. seq_id is a hash of file and the row's number, which follows how files are split: write the result to keep it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"), _words(F.col("value")).alias("symbols"))
    return rows.where(F.size("symbols") >= least).select(F.xxhash64("file", "i").alias("seq_id"), "symbols")


def read_csv(spark: SparkSession, path: str, column: str, least: int = 2, schema: str | None = None) -> DataFrame:
    """A CSV column of space-joined symbols; all columns are kept, as strings unless a schema is given."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.withColumn("symbols", _words(F.col(column))).where(F.size("symbols") >= least)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON files in any of four shapes: a list of lists; objects with signs, sequence or tokens; either under inscriptions, data or texts.

    The text is parsed by Spark's own JSON functions with explicit schemas, one
    file a row, so files should be of a size that fits a task.
    """
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    body = F.coalesce(*[F.get_json_object("v", f"$.{k}") for k in ("inscriptions", "data", "texts")], F.col("v"))
    raw = raw.withColumn("body", F.when(F.col("v").startswith("{"), body).otherwise(F.col("v")))
    items = F.from_json("body", "array<string>")
    each = raw.select("file", F.posexplode(items).alias("i", "item"))
    listed = F.from_json("item", "array<string>")
    keyed = F.coalesce(*[F.from_json(F.get_json_object("item", f"$.{k}"), "array<string>") for k in ("signs", "sequence", "tokens")])
    one = each.withColumn("symbols", F.when(F.col("item").startswith("["), listed).when(F.col("item").startswith("{"), keyed))
    nested = one.where(F.col("symbols").isNotNull()).select(F.xxhash64("file", "i").alias("seq_id"), "symbols")
    # a flat list of strings is one sequence
    flat = raw.select("file", items.alias("symbols")).where("size(symbols) > 0").where(~F.exists("symbols", lambda x: x.startswith("[") | x.startswith("{"))).select(F.xxhash64("file", F.lit(-1)).alias("seq_id"), "symbols")
    return nested.unionByName(flat)


def assemble(sites: DataFrame, seals: DataFrame, inscriptions: DataFrame, glyphs: DataFrame, digits: int = 3) -> DataFrame:
    """A corpus from four tables: glyphs in order, each as a padded id; site 'unknown' where there is none; direction from its text."""
    glyph = F.col("glyph_id").cast("string")
    seq = glyphs.groupBy("seal_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.when(F.length(glyph) < digits, F.lpad(glyph, digits, "0")).otherwise(glyph).alias("g")))).alias("x")).select("seal_id", F.col("x.g").alias("symbols"))
    low = F.lower("direction")
    way = F.when(F.contains(low, F.lit("right to left")) | F.contains(low, F.lit("r/l")) | (low == "rtl"), "rtl").when(F.contains(low, F.lit("left to right")) | F.contains(low, F.lit("l/r")) | (low == "ltr"), "ltr").otherwise("unknown")
    j = inscriptions.join(seals, "seal_id", "left").join(sites.withColumnRenamed("name", "site"), "site_id", "left").join(seq, "seal_id")
    return j.select(F.col("seal_id").alias("seq_id"), F.coalesce("site", F.lit("unknown")).alias("site"), "material", way.alias("direction"), "is_complete", "symbols")


def from_rows(rows: DataFrame, key: str, position: str, symbol: str, order: str) -> DataFrame:
    """Long rows to sequences: the last row of a position wins, by order; empty symbols go."""
    last = rows.groupBy(key, position).agg(F.max_by(symbol, order).alias("s")).where("s IS NOT NULL AND s <> ''")
    return last.groupBy(F.col(key).alias("seq_id")).agg(F.array_sort(F.collect_list(F.struct(position, "s"))).alias("x")).select("seq_id", F.col("x.s").alias("symbols"))


def from_transliteration(df: DataFrame, key: str, text: str, comments: tuple[str, ...] = ("#", "$", "@", "&"), least: int = 2) -> DataFrame:
    """A sequence for each line; symbols that begin a comment go, short lines too."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    keep = lambda x: ~reduce(lambda c, m: c | x.startswith(m), comments, F.lit(False))
    return lines.select(key, "line_no", F.filter(_words(F.col("line")), keep).alias("symbols")).where(F.size("symbols") >= least)


def union(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora in one table under their names."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("corpus_id", F.lit(name)) for name, d in corpora.items()])


def export(seq: DataFrame, path: str, form: str) -> None:
    """txt: symbols joined by spaces; csv: seq_id, position, token; json or parquet: the table."""
    if form == "txt":
        seq.select(F.array_join("symbols", " ").alias("value")).write.text(path)
    elif form == "csv":
        tokens(seq.select("seq_id", "symbols")).select("seq_id", F.col("pos").alias("position"), F.col("sym").alias("token")).write.option("header", True).csv(path)
    elif form in ("json", "parquet"):
        seq.write.format(form).save(path)
    else:
        raise ValueError(f"unknown form {form}")
