"""Queries over zones, stratified nulls and allographs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import hypotheses as h
from seqweave.operators import lm
from seqweave.operators import measures as m
from seqweave.operators import strata as st
from seqweave.operators import zones as z
from seqweave.plans.counting import TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.inference import RUNS, _runs, div_sql
from seqweave.plans.registry import query
from seqweave.sources.adapters import ORDERS, grams, lines, orders, table


@query("trn_14_shuffle_globally", f"""{TOK_ORDERS}, a AS (SELECT segment, sym, row_number() OVER (PARTITION BY segment ORDER BY md5('s1|token|' || seq_id || '|' || pos)) AS i FROM tok), b AS (SELECT segment, seq_id, pos, row_number() OVER (PARTITION BY segment ORDER BY md5('s1|place|' || seq_id || '|' || pos)) AS i FROM tok)
SELECT seq_id, string_agg(sym, ' ' ORDER BY pos) AS symbols FROM a JOIN b ON a.segment = b.segment AND a.i = b.i GROUP BY seq_id""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return z.shuffle_globally(orders(spark, sf), "s1", ["segment"]).select("seq_id", F.array_join("symbols", " ").alias("symbols"))


ZONED = f"{TOK_ORDERS}, zn AS (SELECT t.*, 'zone' || n_regionkey AS zone FROM tok t JOIN nation ON n_name = nation)"


def _zones(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "nation").select(F.col("n_name").alias("nation"), F.concat(F.lit("zone"), F.col("n_regionkey").cast("string")).alias("zone"))


@query("cmp_9_zones", div_sql(ZONED, "zone", counted="zn") + " SELECT x, y, shared, only_x, only_y, round(shared / (shared + only_x + only_y), 6) AS jaccard, round(kl, 6) + 0.0 AS kl, round(kl_back, 6) + 0.0 AS kl_back, round(js, 6) AS js FROM dv")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(z.zone_report(orders(spark, sf), "nation", _zones(spark, sf)), "jaccard", "kl", "kl_back", "js")


@query("cmp_9_zone_inventories", f"{ZONED}, g AS (SELECT zone, sym, count(*) AS n, count(*) FILTER (pos = 0) AS f, count(*) FILTER (pos = len - 1 AND pos > 0) AS l FROM zn GROUP BY ALL), s AS (SELECT zone, count(DISTINCT seq_id) AS sequences FROM zn GROUP BY zone) SELECT zone, any_value(sequences) AS sequences, sum(n)::BIGINT AS tokens, count(*) AS types, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (f / n >= 0.3), '') AS initials, coalesce(string_agg(sym, ',' ORDER BY sym) FILTER (l / n >= 0.2), '') AS terminals FROM g JOIN s USING (zone) GROUP BY zone")
def _(spark, sf):  # noqa: ANN001, ANN202
    return z.zone_inventories(orders(spark, sf), "nation", _zones(spark, sf), 0.3, 0.2)


SIGNED = f"""WITH {ORDERS}, {grams('orders_seq', 'nation', least=1, most=3)}, c AS (SELECT nation, n, gram, count(*) AS cnt FROM grams GROUP BY ALL), e AS (SELECT nation, n, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) AS h FROM c GROUP BY ALL), w AS (SELECT nation, max(h) FILTER (n = 1) AS h1, max(h) FILTER (n = 2) AS h2, max(h) FILTER (n = 3) AS h3 FROM e GROUP BY nation), r AS (SELECT nation, cnt, row_number() OVER (PARTITION BY nation ORDER BY cnt DESC, gram) AS rank FROM c WHERE n = 1),
sg AS (SELECT nation, CASE WHEN right(nation, 1) < '5' THEN 'language' ELSE 'other' END AS role, any_value(h1) AS h1, greatest(0, least(1, any_value((2 * h1 - h2) / h1))) AS e2, greatest(0, least(1, any_value((3 * h1 - 3 * h2 + h3) / h1))) AS e3, -regr_slope(ln(cnt), ln(rank)) AS alpha FROM r JOIN w USING (nation) GROUP BY nation),
tm AS (SELECT role, avg(h1) AS m1, avg(e2) AS m2, avg(e3) AS m3, avg(alpha) AS ma, greatest(max(h1) - min(h1), 1e-9) AS s1, greatest(max(e2) - min(e2), 1e-9) AS s2, greatest(max(e3) - min(e3), 1e-9) AS s3, greatest(max(alpha) - min(alpha), 1e-9) AS sa FROM sg GROUP BY role), ds AS (SELECT nation, tm.role, sqrt(pow((h1 - m1) / s1, 2) + pow((e2 - m2) / s2, 2) + pow((e3 - m3) / s3, 2) + pow((alpha - ma) / sa, 2)) AS distance FROM sg, tm)"""


def _signed(spark, sf):  # noqa: ANN001, ANN202
    return st.signature(orders(spark, sf), ["nation"]).withColumn("role", F.when(F.substring("nation", -1, 1) < "5", "language").otherwise("other"))


@query("cmp_13_signature_distance", f"{SIGNED} SELECT nation, role, round(distance, 6) AS distance FROM ds")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(z.signature_distance(_signed(spark, sf), "nation", "role", ["alpha", "h1", "e2", "e3"]), "distance")


@query("cmp_13_template_verdicts", f"{SIGNED} SELECT nation, round(min(distance) FILTER (role = 'language'), 6) AS positive, round(min(distance) FILTER (role <> 'language'), 6) AS negative, CASE WHEN min(distance) FILTER (role = 'language') < min(distance) FILTER (role <> 'language') THEN 'language' ELSE 'other' END AS verdict FROM ds GROUP BY nation")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(z.template_distance(_signed(spark, sf), "nation", "role", ["alpha", "h1", "e2", "e3"], "language"), "positive", "negative")


DIGRAPHS, LETTERS = {"TH": 1, "SH": 2, "CH": 2}, {"A": 3, "E": 3, "I": 3, "O": 3, "U": 3, "T": 4, "D": 4, "N": 5, "M": 5}


@query("cmp_17_sound_groups", f"{TOK_LINES}, g AS (SELECT CASE upper(left(sym, 2)) WHEN 'TH' THEN 1 WHEN 'SH' THEN 2 WHEN 'CH' THEN 2 ELSE CASE WHEN upper(left(sym, 1)) IN ('A', 'E', 'I', 'O', 'U') THEN 3 WHEN upper(left(sym, 1)) IN ('T', 'D') THEN 4 WHEN upper(left(sym, 1)) IN ('N', 'M') THEN 5 END END AS g FROM (SELECT DISTINCT sym FROM tok)) SELECT g::BIGINT AS \"group\", count(*) AS n, round(count(*) / (SELECT count(*) FROM g WHERE g IS NOT NULL), 6) AS share FROM g WHERE g IS NOT NULL GROUP BY g")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(z.sound_groups(m.symbol_counts(lines(spark, sf)).select("sym"), "sym", DIGRAPHS, LETTERS), "share")


@query("sig_14_confidence_null", f"""{TOK_ORDERS}, c AS (SELECT sym, count(*) AS cnt, CASE WHEN right(sym, 1) = '1' THEN 1.0::DOUBLE WHEN right(sym, 1) < '4' THEN 0.2 ELSE 0 END AS w FROM tok GROUP BY sym), x AS (SELECT * FROM c, range(1, 21) r(rep)), a AS (SELECT rep, cnt, row_number() OVER (PARTITION BY rep ORDER BY md5('s1|a|' || rep || '|' || sym)) AS i FROM x), b AS (SELECT rep, w, row_number() OVER (PARTITION BY rep ORDER BY md5('s1|b|' || rep || '|' || sym)) AS i FROM x),
v AS (SELECT rep, sum(cnt * w) AS v FROM a JOIN b USING (rep, i) GROUP BY rep), o AS (SELECT sum(cnt * w) AS o FROM c) SELECT round(any_value(o), 6) AS observed, round((count(*) FILTER (round(v, 12) >= round(o, 12)) + 1) / (count(*) + 1), 6) AS p, round(avg(v), 6) AS null_mean, round((any_value(o) - avg(v)) / stddev_samp(v), 6) + 0.0 AS z FROM v, o""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    labels = m.symbol_counts(x).where("right(sym, 1) < '4'").select("sym", F.expr("CASE WHEN right(sym, 1) = '1' THEN 'HIGH' ELSE 'LOW' END").alias("confidence"))
    return _rounded(z.confidence_null(x, labels, "s1"), "observed", "p", "null_mean", "z")


@query("sig_17_stratified_readout", f"WITH {ORDERS}, x AS (SELECT len(symbols) AS len, count(*) AS n FROM orders_seq WHERE segment = 'BUILDING' GROUP BY 1), y AS (SELECT DISTINCT len(symbols) AS len_o, segment FROM orders_seq WHERE segment <> 'BUILDING' UNION SELECT len(symbols), '(all)' FROM orders_seq WHERE segment <> 'BUILDING'), b AS (SELECT segment, len, n, max(1 - abs(len - len_o) / 5) AS score FROM x, y WHERE abs(len - len_o) < 5 GROUP BY ALL) SELECT segment AS stratum, round(sum(n * score), 6)::DOUBLE AS total, sum(n)::BIGINT AS matched FROM b GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).select("segment", F.size("symbols").alias("len"))
    return _rounded(z.stratified_readout(x.where("segment = 'BUILDING'"), x.where("segment <> 'BUILDING'"), "segment"), "total")


@query("lm_10_matched_words", f"{TOK_ORDERS}, {RUNS}, d AS (SELECT seq_id, lower(string_agg(value, '' ORDER BY pos)) AS word FROM tok JOIN (SELECT * FROM mp WHERE run_id = 1) x ON tok.sym = x.sym GROUP BY seq_id), v AS (SELECT DISTINCT lower(array_to_string(symbols, '')) AS word FROM orders_seq WHERE len(symbols) <= 2), j AS (SELECT seq_id, word, row_number() OVER (PARTITION BY word ORDER BY seq_id) AS i FROM d JOIN v USING (word)) SELECT word, count(*) AS hits, string_agg(seq_id::VARCHAR, ',' ORDER BY seq_id) FILTER (i <= 3) AS examples FROM j GROUP BY word")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    v = x.where("size(symbols) <= 2").select(F.array_join("symbols", "").alias("word"))
    return z.matched_words(lm.decode(x, _runs(spark, sf).where("run_id = 1")), v)


@query("lm_22_retagged", f"{TOK_ORDERS}, c AS (SELECT sym, row_number() OVER (ORDER BY count(*) DESC, sym) AS i FROM tok GROUP BY sym) SELECT sym AS value, CASE WHEN i <= 5 THEN 'logogram' ELSE left(sym, 7) END AS role FROM c")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = m.symbol_counts(orders(spark, sf))
    return z.retagged(c.select(F.col("sym").alias("value"), F.substring("sym", 1, 7).alias("role")), c.select(F.col("sym").alias("word"), "cnt"), 5)


@query("aln_5_function_lookup", "SELECT p_brand AS sym, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS functions, left(sha256(p_brand), 32) AS stable_id FROM part GROUP BY p_brand")
def _(spark, sf):  # noqa: ANN001, ANN202
    part = table(spark, sf, "part")
    reg = part.groupBy(F.col("p_brand").alias("sym")).agg(F.array_join(F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))), "|").alias("ids"))
    return z.function_lookup(reg, "ids", part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("function")))


@query("agg_35_coverage_summary", f"{TOK_ORDERS}, r AS (SELECT seq_id, segment, count(*) FILTER (sym LIKE '%#1_') / count(*) AS c FROM tok GROUP BY ALL) SELECT segment, count(*) AS sequences, round(avg(c), 6) AS coverage, round(avg(CASE WHEN c >= 1 THEN 1 ELSE 0 END), 6) AS full_share FROM r GROUP BY GROUPING SETS ((), (segment))")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    anchors = m.symbol_counts(x).where("sym LIKE '%#1_'").select("sym", F.col("sym").alias("reading"))
    read = h.transliterate(x, anchors).join(x.select("seq_id", "segment"), "seq_id")
    return _rounded(z.coverage_summary(read, ["segment"]), "coverage", "full_share")
