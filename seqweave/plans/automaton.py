"""Queries over long lists of words, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import automaton as a
from seqweave.plans.registry import query
from seqweave.sources.adapters import ORDERS, orders, table

# topics: each benchmark item, with its words of 8 letters or more as keywords and those of 7 as exclusions
TOPICS = "k AS (SELECT DISTINCT item_id AS topic, w AS keyword, length(w) = 7 AS excluded FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM benchmark))"


@query("evd_8_topic_table", f"WITH {TOPICS} SELECT doc_id, topic FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY doc_id, topic HAVING bool_or(NOT excluded) AND NOT bool_or(excluded)")
def _(spark, sf):  # noqa: ANN001, ANN202
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), 1)).alias("keyword")).distinct()
    return a.topics_by_table(table(spark, sf, "documents"), words.select(F.col("item_id").alias("topic"), "keyword", (F.length("keyword") == 7).alias("excluded")), "doc_id", "text")


# phrases: whole sequences of one segment, of any length, in all others
PHRASES = f"""WITH {ORDERS}, v AS (SELECT array_to_string(symbols, ' ') AS word, min(nation) AS meaning FROM orders_seq WHERE segment = 'BUILDING' GROUP BY 1),
s AS (SELECT seq_id, symbols, unnest(range(1, len(symbols) + 1)) AS i FROM orders_seq WHERE segment <> 'BUILDING'), p AS (SELECT seq_id, symbols, i, unnest(range(i, len(symbols) + 1)) AS j FROM s)
SELECT word, meaning, count(*) AS cnt, count(DISTINCT seq_id) AS sequences FROM (SELECT seq_id, array_to_string(symbols[i:j], ' ') AS word FROM p) JOIN v USING (word) GROUP BY word, meaning"""


@query("lm_11_phrases", PHRASES)
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    vocabulary = x.where("segment = 'BUILDING'").select(F.array_join("symbols", " ").alias("word"), F.col("nation").alias("meaning"))
    return a.phrase_matches(x.where("segment <> 'BUILDING'"), vocabulary)
