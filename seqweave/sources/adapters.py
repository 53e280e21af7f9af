"""Tables as sequences: (seq_id, symbols, strata...), in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each line of a document with a letter in it: its runs of letters, in lower case."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    symbols = F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+)"), 1)
    # a filter on symbols would find all runs of letters twice
    return rows.where(F.rlike("line", F.lit(r"\p{L}"))).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("seq_id"), "lang", "source", symbols.alias("symbols"))


LINES = """
lines AS (
  SELECT doc_id * 1000000 + i - 1 AS seq_id, lang, source, regexp_extract_all(lower(line), '\\p{L}+') AS symbols
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE len(regexp_extract_all(lower(line), '\\p{L}+')) > 0)
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each order: the brands of its lines by line number."""
    t = lambda name: table(spark, sf_dir, name)
    items = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brands = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_brand"))).alias("x"))
    head = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    head = head.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = brands.join(head, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("seq_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("x.p_brand").alias("symbols"))


ORDERS = """
orders_seq AS (
  SELECT o_orderkey AS seq_id, c_mktsegment AS segment, n_name AS nation, list(p_brand ORDER BY l_linenumber, p_brand) AS symbols
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each user and day: event types by time and id."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"))
    rows = rows.agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return rows.select(F.concat_ws("/", F.col("user_id").cast("string"), "day").alias("seq_id"), "day", F.col("x.event_type").alias("symbols"))


EVENTS = """
events_seq AS (
  SELECT user_id::VARCHAR || '/' || CAST(ts AS DATE)::VARCHAR AS seq_id, CAST(ts AS DATE)::VARCHAR AS day, list(event_type ORDER BY ts, event_id) AS symbols
  FROM events GROUP BY user_id, CAST(ts AS DATE))
"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each conversation: the roles of its turns."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select(F.col("conv_id").alias("seq_id"), F.col("x.role").alias("symbols"))


ROLES = """
roles_seq AS (SELECT conv_id AS seq_id, list(role ORDER BY turn, role) AS symbols FROM conversations GROUP BY conv_id)
"""


def tok(seq: str, *keep: str) -> str:
    """SQL: the tokens of a sequence table, as a common table expression `tok`."""
    cols = ", ".join(["seq_id", *keep])
    return f"tok AS (SELECT {cols}, unnest(symbols) AS sym, generate_subscripts(symbols, 1) - 1 AS pos, len(symbols) AS len FROM {seq})"


def grams(seq: str, *keep: str, most: int = 2, least: int = 2) -> str:
    """SQL: n-grams within sequences as `grams` (seq_id, n, st, gram), gram joined by spaces."""
    cols = ", ".join(["seq_id", *keep])
    return f"""grams AS (
  SELECT {cols}, n, st, array_to_string(symbols[st + 1 : st + n], ' ') AS gram FROM (
    SELECT {cols}, symbols, n, unnest(range(0, len(symbols) - n + 1)) AS st FROM {seq}, range({least}, {most + 1}) r(n)))"""
