"""Queries over flat networks, grids, sounds, readings and anchors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import lm
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators import summaries as s
from seqweave.plans.counting import POS1, TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.inference import RUNS, _runs
from seqweave.plans.registry import query
from seqweave.plans.zones import DIGRAPHS, LETTERS
from seqweave.sources.adapters import lines, orders

FLAT = f"""{TOK_ORDERS}, r AS (SELECT sym, row_number() OVER (ORDER BY seq_id, pos) AS i FROM tok), nd AS (SELECT sym, count(*) AS cnt FROM tok GROUP BY sym HAVING count(*) >= 5 ORDER BY cnt DESC, sym LIMIT 20),
fe AS (SELECT least(x.sym, y.sym) AS a, greatest(x.sym, y.sym) AS b, count(*) AS weight FROM r x JOIN r y ON y.i IN (x.i + 1, x.i + 2) WHERE x.sym IN (SELECT sym FROM nd) AND y.sym IN (SELECT sym FROM nd) GROUP BY ALL HAVING count(*) >= 10)"""


@query("net_7_flat_edges", f"{FLAT} SELECT * FROM fe")
def _(spark, sf):  # noqa: ANN001, ANN202
    return s.flat_edges(orders(spark, sf), 2, 5, 20, 10)


@query("net_7_flat_degrees", f"{FLAT} SELECT sym, cnt, coalesce(degree, 0) AS degree, coalesce(strength, 0)::BIGINT AS strength FROM nd LEFT JOIN (SELECT sym, count(*) AS degree, sum(weight) AS strength FROM (SELECT a AS sym, weight FROM fe UNION ALL SELECT b, weight FROM fe WHERE a <> b) GROUP BY sym) USING (sym)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return s.flat_degrees(orders(spark, sf), 2, 5, 20, 10)


@query("net_18_density", f"{POS1}, k AS (SELECT sym, CASE WHEN sym <> 'Brand#1' THEN left(sym, 7) END AS r, CASE WHEN sym = 'Brand#2' THEN NULL WHEN sum(n_end) / sum(n) >= 0.2 THEN 'END' ELSE 'REST' END AS c FROM q GROUP BY sym) SELECT count(DISTINCT r) AS rows, count(DISTINCT c) AS columns, count(DISTINCT (r, c)) FILTER (r IS NOT NULL AND c IS NOT NULL) AS cells, count(*) FILTER (c IS NULL) AS row_only, count(*) FILTER (r IS NULL) AS col_only, round(count(DISTINCT (r, c)) FILTER (r IS NOT NULL AND c IS NOT NULL) / (count(DISTINCT r) * count(DISTINCT c)), 6) AS density FROM k")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = p.start_end_counts(orders(spark, sf), [])
    rows = c.where("sym <> 'Brand#1'").select("sym", F.substring("sym", 1, 7).alias("cluster"))
    return _rounded(s.grid_density(rows, c.where("sym <> 'Brand#2'").select("sym", F.when(F.col("end_rate") >= 0.2, "END").otherwise("REST").alias("cluster"))), "density")


@query("cmp_17_sound_similarity", f"""{TOK_LINES}, c AS (SELECT lang AS s, CASE upper(left(sym, 2)) WHEN 'TH' THEN 1 WHEN 'SH' THEN 2 WHEN 'CH' THEN 2 ELSE CASE WHEN upper(left(sym, 1)) IN ('A', 'E', 'I', 'O', 'U') THEN 3 WHEN upper(left(sym, 1)) IN ('T', 'D') THEN 4 WHEN upper(left(sym, 1)) IN ('N', 'M') THEN 5 END END AS g, count(*)::DOUBLE AS n FROM tok WHERE lang IS NOT NULL GROUP BY ALL),
v AS (SELECT s, g, n / sqrt(sum(n * n) OVER (PARTITION BY s)) AS w FROM c WHERE g IS NOT NULL), st AS (SELECT DISTINCT s FROM c)
SELECT a.s AS x, b.s AS y, round(coalesce((SELECT sum(p.w * q.w) FROM v p JOIN v q ON p.g = q.g WHERE p.s = a.s AND q.s = b.s), 0), 6) AS similarity FROM st a JOIN st b ON a.s < b.s""")
def _(spark, sf):  # noqa: ANN001, ANN202
    words = lines(spark, sf).select("lang", F.explode("symbols").alias("word"))
    return _rounded(s.sound_similarity(words, "word", "lang", DIGRAPHS, LETTERS), "similarity")


@query("agg_35_readings_summary", f"""{TOK_ORDERS}, {RUNS}, d AS (SELECT segment, nation, coalesce(string_agg(value, '' ORDER BY pos), '') AS reading, count(value) / max(len) AS coverage FROM tok LEFT JOIN (SELECT * FROM mp WHERE run_id = 1 AND value <> 'Brand#11') x ON tok.sym = x.sym GROUP BY seq_id, segment, nation),
c AS (SELECT '(all)' AS dim, '' AS value, count(*) AS n FROM d UNION ALL SELECT '(full)', '', count(*) FROM d WHERE coverage >= 1 HAVING count(*) > 0 UNION ALL SELECT 'reading', reading, count(*) FROM d WHERE reading <> '' GROUP BY reading UNION ALL SELECT 'segment', segment, count(*) FROM d GROUP BY segment UNION ALL SELECT 'nation', nation, count(*) FROM d GROUP BY nation)
SELECT dim, value, n, round(n / (SELECT count(*) FROM d), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) <= 50""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    d = lm.decode(x, _runs(spark, sf).where("run_id = 1 AND value <> 'Brand#11'")).join(x.select("seq_id", "segment", "nation"), "seq_id")
    return _rounded(s.readings_summary(d.select("segment", "nation", F.col("decoded").alias("reading"), (F.col("mapped") / F.col("len")).alias("coverage")), ["segment", "nation"]), "share")


SURE = "CASE WHEN right(sym, 1) IN ('1', '2') THEN 'HIGH' WHEN right(sym, 1) < '6' THEN 'MEDIUM' ELSE 'LOW' END"


@query("lm_20_anchor_variants", f"""{TOK_ORDERS}, {RUNS}, a AS (SELECT sym, left(sym, 7) AS value, {SURE} AS confidence, left(sym, 7) AS family FROM (SELECT DISTINCT sym FROM tok)), mm AS (SELECT sym, lower(value) AS mapped, right(value, 1) = '1' AS sure FROM mp WHERE run_id = 1),
h AS (SELECT a.*, mapped, sure, contains(mapped, lower(value)) AS matches FROM a JOIN mm USING (sym)), o AS (SELECT a.family, a.sym AS other, mapped FROM a JOIN mm USING (sym)),
v AS (SELECT h.sym, count(*) AS variants FROM h JOIN o ON h.family = o.family AND h.sym <> o.other AND contains(o.mapped, lower(h.value)) WHERE matches GROUP BY h.sym)
SELECT h.sym, value, confidence, mapped, matches, coalesce(variants, 0) AS variants, round(CASE WHEN matches THEN CASE confidence WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0.5 END * CASE WHEN sure THEN 1.5 ELSE 1 END + 0.25 * coalesce(variants, 0) ELSE 0 END, 6) AS score FROM h LEFT JOIN v USING (sym)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    syms = m.symbol_counts(orders(spark, sf)).select("sym")
    a = syms.select("sym", F.substring("sym", 1, 7).alias("value"), F.expr(SURE).alias("confidence"))
    mapping = _runs(spark, sf).where("run_id = 1").select("sym", "value", F.when(F.expr("right(value, 1) = '1'"), "high").alias("confidence"))
    return _rounded(s.anchors_with_variants(mapping, a, syms.select("sym", F.substring("sym", 1, 7).alias("family"))), "score")
