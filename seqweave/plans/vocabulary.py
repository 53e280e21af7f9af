"""Queries over vocabularies, candidate words and the agreement of mappings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import lm
from seqweave.operators import positions as p
from seqweave.operators import vocabulary as v
from seqweave.plans.counting import POS3, TOK_ORDERS, _rounded
from seqweave.plans.inference import RUNS, _runs
from seqweave.plans.registry import query
from seqweave.sources.adapters import LINES, ORDERS, grams, lines, orders

# words: whole sequences of one segment, those of two other segments are looked through
WORDS = f"""WITH {ORDERS}, {grams("(SELECT * FROM orders_seq WHERE segment <> 'BUILDING')", most=5)}, o AS (SELECT array_to_string(symbols, ' ') AS word FROM orders_seq WHERE segment <> 'BUILDING'),
pc AS (SELECT gram AS word, count(*) AS cnt FROM grams GROUP BY gram), wc AS (SELECT word, count(*) AS whole FROM o GROUP BY word), f AS (SELECT word, coalesce(cnt, 0) AS cnt, coalesce(whole, 0) AS whole FROM pc FULL JOIN wc USING (word)),
v AS (SELECT array_to_string(symbols, ' ') AS word, min(nation) AS meaning FROM orders_seq WHERE segment = 'BUILDING' GROUP BY 1)"""


def _vocabulary(x):  # noqa: ANN001, ANN202
    return x.where("segment = 'BUILDING'").select(F.array_join("symbols", " ").alias("word"), F.col("nation").alias("meaning"))


@query("lm_11_word_matches", f"{WORDS} SELECT word, meaning, len(string_split(word, ' ')) AS length, cnt, whole FROM f JOIN v USING (word)")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(v.word_matches(x.where("segment <> 'BUILDING'"), _vocabulary(x)))


@query("lm_11_coverage", f"{WORDS} SELECT (SELECT count(*) FROM f JOIN v USING (word)) AS matches, (SELECT count(*) FROM f) AS checked, (SELECT count(*) FROM v) AS words, round((SELECT count(*) FROM f JOIN v USING (word)) / (SELECT count(*) FROM v), 6) AS coverage")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(v.word_coverage(x.where("segment <> 'BUILDING'"), _vocabulary(x)), "coverage")


@query("lm_12_candidate_words", f"""{POS3.replace('nation, sym', 'sym')}, x AS (SELECT t.seq_id, t.pos, t.sym, CASE WHEN lag(t.pos) OVER (PARTITION BY t.seq_id ORDER BY t.pos) = t.pos - 1 THEN 0 ELSE 1 END AS new FROM tok t JOIN q USING (sym) WHERE class = 'MIXED'),
y AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM x), z AS (SELECT *, (row_number() OVER (PARTITION BY seq_id, run ORDER BY pos) - 1) // 6 AS part FROM y),
rd AS (SELECT sym, substr(sym, 7, 1) AS reading, i_rate AS confidence FROM q WHERE sym NOT LIKE '%5'),
g AS (SELECT string_agg(z.sym, ' ' ORDER BY pos) AS word, string_agg(coalesce(reading, '?'), '' ORDER BY pos) AS reading, count(*) AS n, avg(coalesce(confidence, 0)) AS confidence FROM z LEFT JOIN rd USING (sym) GROUP BY seq_id, run, part HAVING count(*) >= 2),
u AS (SELECT word, reading, n, count(*) AS occurrences, min(confidence) AS confidence FROM g GROUP BY word, reading, n), vo AS (SELECT printf('%d', i) AS reading, 'number ' || i AS meaning FROM range(10, 40) r(i))
SELECT word, u.reading, n, occurrences, round(confidence, 6) AS confidence, meaning IS NOT NULL AS known, meaning, round(confidence * CASE WHEN meaning IS NOT NULL THEN 2 ELSE 1 END, 6) AS score FROM u LEFT JOIN vo USING (reading)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    c = p.rates(x, [])
    readings = c.where("sym NOT LIKE '%5'").select("sym", F.substring("sym", 7, 1).alias("reading"), F.col("i_rate").alias("confidence"))
    numbers = spark.range(10, 40).select(F.col("id").cast("string").alias("word"), F.concat(F.lit("number "), F.col("id").cast("string")).alias("meaning"))
    return _rounded(v.candidate_words(x, c.select("sym", "class"), readings, numbers, "MIXED"), "confidence", "score")


@query("lm_16_boundary_coherence", f"""WITH {LINES}, w AS (SELECT lang, source, string_split(s, '') AS c FROM (SELECT lang, source, unnest(symbols) AS s FROM lines)), e AS (SELECT lang, source, c, unnest(range(1, len(c))) AS i FROM w WHERE len(c) > 1),
t AS (SELECT a, b, cnt / sum(cnt) OVER (PARTITION BY a) AS p FROM (SELECT c[i] AS a, c[i + 1] AS b, count(*) AS cnt FROM e WHERE lang = 'en' GROUP BY ALL)), k AS (SELECT source, c[i] AS a, c[i + 1] AS b, count(*) AS cnt FROM e GROUP BY ALL)
SELECT s.source, round(coalesce(sum(cnt * ln(coalesce(p, 1e-8))) / sum(cnt), 0), 6) AS coherence, coalesce(sum(cnt), 0)::BIGINT AS scored FROM (SELECT DISTINCT source FROM w WHERE source IS NOT NULL) s LEFT JOIN k USING (source) LEFT JOIN t USING (a, b) GROUP BY s.source""")
def _(spark, sf):  # noqa: ANN001, ANN202
    words = lines(spark, sf).select("lang", "source", F.explode("symbols").alias("w")).select("lang", "source", F.split("w", "").alias("symbols"))
    pairs = lm.bigrams(words.where("lang = 'en'").select("symbols")).groupBy("a", "b").agg(F.count("*").alias("cnt"))
    target = pairs.join(pairs.groupBy("a").agg(F.sum("cnt").alias("n")), "a").select("a", "b", (F.col("cnt") / F.col("n")).alias("p"))
    return _rounded(v.boundary_coherence(words.where("source IS NOT NULL"), target, ["source"]), "coherence")


@query("lm_7_mapping_agreement", f"{TOK_ORDERS}, {RUNS}, k AS (SELECT * FROM mp WHERE run_id < 3 OR sym LIKE '%3_'), n AS (SELECT run_id, count(*) AS n FROM k GROUP BY run_id) SELECT a.run_id AS run_a, b.run_id AS run_b, count(x.sym) AS shared, count(x.sym) FILTER (x.value = y.value) AS same, round(coalesce(count(x.sym) FILTER (x.value = y.value) / nullif(count(x.sym), 0), 0), 6) AS share, round(count(x.sym) / (any_value(a.n) + any_value(b.n) - count(x.sym)), 6) AS keys FROM n a JOIN n b ON a.run_id < b.run_id LEFT JOIN (k x JOIN k y ON x.sym = y.sym) ON x.run_id = a.run_id AND y.run_id = b.run_id GROUP BY a.run_id, b.run_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(v.mapping_agreement(_runs(spark, sf).where("run_id < 3 OR sym LIKE '%3_'")), "share", "keys")


@query("lm_5_high_consistency", f"{TOK_ORDERS}, {RUNS}, c AS (SELECT sym, max(n) AS top, sum(n) AS runs FROM (SELECT sym, value, count(*) AS n FROM mp GROUP BY ALL) GROUP BY sym) SELECT count(*) AS symbols, count(*) FILTER (runs >= 2) AS compared, count(*) FILTER (runs >= 2 AND top = runs) AS unanimous, count(*) FILTER (top >= 0.75 * runs) AS high FROM c")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(v.unanimous(_runs(spark, sf)))
