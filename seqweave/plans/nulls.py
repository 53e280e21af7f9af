"""Queries over permutation tests, pairings and full mapping scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import lm, nulls
from seqweave.operators import positions as p
from seqweave.plans.counting import TOK_ORDERS, _rounded
from seqweave.plans.inference import MODEL, RUNS, _runs
from seqweave.plans.registry import query
from seqweave.sources.adapters import ORDERS, orders, tok

REPS = 20
TESTED = ("observed", "null_mean", "null_sd", "p95", "p99", "p", "z")


def tested_sql(values: str, key: str) -> str:
    """SQL: the test's columns from values (key, rep, value) with a row for each replicate."""
    return f"""o AS (SELECT {key}, value AS o FROM {values} WHERE rep = 0), n AS (SELECT {key}, avg(value) AS mean, stddev_pop(value) AS sd, list_sort(list(value)) AS v FROM {values} WHERE rep > 0 GROUP BY {key}),
x AS (SELECT {key}, o, mean, sd, v[20] AS p95, v[20] AS p99, (len(list_filter(v, lambda y: round(y, 12) >= round(o, 12))) + 1) / 21 AS p FROM o JOIN n USING ({key}))
SELECT {key}, round(o, 6) + 0.0 AS observed, round(mean, 6) + 0.0 AS null_mean, round(sd, 6) + 0.0 AS null_sd, round(p95, 6) + 0.0 AS p95, round(p99, 6) + 0.0 AS p99, round(p, 6) AS p, round(CASE WHEN sd > 1e-9 THEN (o - mean) / sd ELSE 0 END, 6) + 0.0 AS z,
CASE WHEN round(o, 12) > round(p99, 12) THEN 'STRONGLY_CONFIRMED' WHEN round(o, 12) > round(p95, 12) THEN 'CONFIRMED' WHEN round(o, 12) > round(mean + sd, 12) THEN 'BORDERLINE' ELSE 'FAILED' END AS verdict FROM x"""


@query("sig_4_metrics", f"""WITH {ORDERS}, {tok('orders_seq')}, sh AS (SELECT rep, seq_id, list(sym ORDER BY md5('s4|' || rep || '|' || seq_id || '|' || pos)) AS symbols FROM tok, range(1, 21) r(rep) GROUP BY ALL), al AS (SELECT 0 AS rep, seq_id, symbols FROM orders_seq UNION ALL SELECT * FROM sh),
t AS (SELECT rep, seq_id, unnest(symbols) AS sym, generate_subscripts(symbols, 1) - 1 AS pos, len(symbols) AS len FROM al), q0 AS (SELECT rep, sym, count(*) AS n, count(*) FILTER (pos = 0 AND len > 1) AS f, count(*) FILTER (pos = len - 1 AND len > 1) AS l FROM t GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT rep, f / n AS i, l / n AS t, CASE WHEN l / n >= 0.6 THEN 'TERMINAL' WHEN f / n >= 0.5 THEN 'INITIAL' WHEN (n - f - l) / n >= 0.65 THEN 'MEDIAL' ELSE 'MIXED' END AS class FROM q0), w AS (SELECT rep, sum(k * (vi + vt)) AS within FROM (SELECT rep, class, count(*) AS k, var_pop(i) AS vi, var_pop(t) AS vt FROM q GROUP BY ALL) GROUP BY rep), a AS (SELECT rep, count(*) * (var_pop(i) + var_pop(t)) AS total FROM q GROUP BY rep),
bg AS (SELECT x.rep, x.sym, y.sym AS nb, count(*) FILTER (x.pos = 0) AS ci, count(*) FILTER (x.pos > 0) AS cr FROM t x JOIN t y ON x.rep = y.rep AND x.seq_id = y.seq_id AND y.pos = x.pos + 1 GROUP BY ALL), bm AS (SELECT rep, sym, sum(ci) AS ni, sum(cr) AS nr, count(*) AS v FROM bg GROUP BY ALL HAVING sum(ci) >= 3 AND sum(cr) >= 3),
kl AS (SELECT rep, sym, sum((ci + 1) / (ni + v) * log2(((ci + 1) / (ni + v)) / ((cr + 1) / (nr + v)))) AS kl FROM bg JOIN bm USING (rep, sym) GROUP BY ALL), tg AS (SELECT count(DISTINCT sym) AS k FROM tok),
sc AS (SELECT sym, count(*) FILTER (len > 1) AS n, count(*) FILTER (pos = 0 AND len > 1) AS first, count(*) FILTER (pos = len - 1 AND len > 1) AS last FROM tok GROUP BY sym), lr AS (SELECT rep, sc.*, row_number() OVER (PARTITION BY rep ORDER BY md5('s4|label|' || rep || '|' || sym)) AS k FROM sc, range(1, 21) r(rep)),
sz AS (SELECT count(*) FILTER (sym LIKE '%1') AS nt, count(*) FILTER (sym LIKE '%2') AS ni FROM sc), lb AS (SELECT 0 AS rep, n, first, last, sym LIKE '%2' AS i, sym LIKE '%1' AS t FROM sc UNION ALL SELECT rep, n, first, last, k > nt AND k <= nt + ni, k <= nt FROM lr, sz),
vals AS (SELECT 'r2' AS metric, rep, CASE WHEN total > 0 THEN 1 - within / total ELSE 0 END AS value FROM w JOIN a USING (rep) UNION ALL SELECT 'polysemy', rep, count(*) FILTER (round(kl, 9) > 0.3) / any_value(k) FROM kl, tg GROUP BY rep UNION ALL SELECT 'labels', rep, (coalesce(sum(first) FILTER (i) / sum(n) FILTER (i), 0) + coalesce(sum(last) FILTER (t) / sum(n) FILTER (t), 0)) / 2 FROM lb GROUP BY rep),
{tested_sql('vals', 'metric')}""")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Three measures against their nulls in one job: class means' share of variance, ambiguous symbols, labels' places."""
    both = nulls.shuffled_neighbours(orders(spark, sf), "s4", REPS)
    symbols = both.where("rep = 0").select("sym").distinct()
    named = lambda d, name, c: d.select(F.lit(name).alias("metric"), "rep", F.col(c).alias("value"))
    values = named(p.grammar_r2(nulls.neighbour_rates(both, ["rep"]), ["rep"]), "r2", "r2").unionByName(named(nulls.neighbour_polysemy(both, ["rep"], symbols), "polysemy", "value"))
    values = values.unionByName(named(nulls.label_scores(nulls.neighbour_labels(both), symbols.where("sym LIKE '%2'"), symbols.where("sym LIKE '%1'"), "s4", REPS), "labels", "value"))
    return _rounded(nulls.tested(values, ["metric"], REPS), *TESTED)


_BEST = "(SELECT * EXCLUDE (rx, ry) FROM (SELECT *, row_number() OVER (PARTITION BY rep, stratum, x ORDER BY score DESC, x, y) AS rx, row_number() OVER (PARTITION BY rep, stratum, y ORDER BY score DESC, x, y) AS ry FROM {0}) WHERE rx = 1 AND ry = 1)"
_ROUNDS = ", ".join(f"r{k} AS {_BEST.format(f's{k}')}, s{k + 1} AS (SELECT s{k}.* FROM s{k} ANTI JOIN r{k} a ON a.rep = s{k}.rep AND a.stratum = s{k}.stratum AND a.x = s{k}.x ANTI JOIN r{k} b ON b.rep = s{k}.rep AND b.stratum = s{k}.stratum AND b.y = s{k}.y)" for k in range(1, 6))


@query("aln_9_assignment_null", f"""WITH {ORDERS}, pr AS (SELECT CASE WHEN len(symbols) <= 3 THEN 'short' ELSE 'long' END AS stratum, nation AS x, segment AS y, count(*)::DOUBLE AS score FROM orders_seq GROUP BY ALL), xs AS (SELECT * FROM pr, range(1, 21) r(rep)),
pl AS (SELECT rep, stratum, x, y, row_number() OVER (PARTITION BY rep, stratum ORDER BY md5('a9|pair|' || rep || '|' || stratum || '|' || x || '|' || y)) AS i FROM xs), dl AS (SELECT rep, stratum, score, row_number() OVER (PARTITION BY rep, stratum ORDER BY md5('a9|score|' || rep || '|' || stratum || '|' || x || '|' || y)) AS i FROM xs),
s1 AS (SELECT 0 AS rep, stratum, x, y, score FROM pr UNION ALL SELECT rep, stratum, x, y, score FROM pl JOIN dl USING (rep, stratum, i)), {_ROUNDS}, vals AS (SELECT stratum, rep, sum(score) AS value FROM ({' UNION ALL '.join(f'SELECT rep, stratum, score FROM r{k}' for k in range(1, 6))}) GROUP BY ALL), {tested_sql('vals', 'stratum')}""")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Nations and segments paired by their orders, within short and long orders, against dealt scores."""
    s = orders(spark, sf).groupBy(F.when(F.size("symbols") <= 3, "short").otherwise("long").alias("stratum"), F.col("nation").alias("x"), F.col("segment").alias("y")).agg(F.count("*").cast("double").alias("score"))
    return _rounded(nulls.assignment_test(s, "stratum", "a9", REPS), *TESTED)


@query("aln_7_best_pairs", f"WITH {ORDERS}, n AS (SELECT p_name AS name, len(string_split(p_name, ' ')) AS name_len, count(*) AS occurrences FROM part GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT DISTINCT seq_id AS object, len(symbols) AS object_len FROM orders_seq WHERE len(symbols) > 4) SELECT object, name, object_len, name_len, occurrences, round(1 - abs(object_len - name_len) / 5, 6) AS score FROM o, n WHERE abs(object_len - name_len) < 5 ORDER BY score DESC, object, name LIMIT 50")
def _(spark, sf):  # noqa: ANN001, ANN202
    """The fifty best pairs of long orders and part names by the numbers of their segments."""
    names = table_names(spark, sf)
    o = orders(spark, sf).where("size(symbols) > 4").select(F.col("seq_id").alias("object"), F.size("symbols").alias("len"))
    return _rounded(nulls.best_length_pairs(names, o, 50, 5, 2), "score")


def table_names(spark, sf):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("name"), F.size(F.split("p_name", " ")).alias("len"))


@query("lm_4_full_scores", f"""{MODEL}, {RUNS}, ma AS (SELECT * FROM mp WHERE sym NOT LIKE '%5'), pb AS (SELECT gram, p FROM lmod WHERE kind = 'bigram' AND segment = 'BUILDING'), d AS (SELECT r.run_id, t.seq_id, t.pos, t.len, coalesce(ma.value, '?') AS v FROM tok t CROSS JOIN (SELECT DISTINCT run_id FROM ma) r LEFT JOIN ma ON ma.run_id = r.run_id AND ma.sym = t.sym),
e AS (SELECT run_id, seq_id, pos, v FROM d UNION ALL SELECT DISTINCT run_id, seq_id, -1, '<BOW>' FROM d UNION ALL SELECT DISTINCT run_id, seq_id, len, '<EOW>' FROM d), l0 AS (SELECT x.run_id, sum(ln(coalesce(p, 1e-8))) AS ll FROM e x JOIN e y ON x.run_id = y.run_id AND x.seq_id = y.seq_id AND y.pos = x.pos + 1 LEFT JOIN pb ON gram = x.v || ' ' || y.v GROUP BY x.run_id),
pp AS (SELECT segment = 'BUILDING' AS target, sym, pos = 0 AS i, pos = len - 1 AS t FROM tok WHERE len >= 2), cp AS (SELECT sym, avg(i::INT) AS i, avg((NOT i AND NOT t)::INT) AS m, avg(t::INT) AS t FROM pp GROUP BY sym), tp AS (SELECT sym, avg(i::INT) AS i, avg((NOT i AND NOT t)::INT) AS m, avg(t::INT) AS t FROM pp WHERE target GROUP BY sym),
po AS (SELECT run_id, sum(cp.i * tp.i + cp.m * tp.m + cp.t * tp.t) AS "positional" FROM cp JOIN ma ON ma.sym = cp.sym JOIN tp ON tp.sym = ma.value GROUP BY run_id), rb AS (SELECT avg((x.sym = y.sym)::INT) AS base FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 WHERE x.segment = 'BUILDING'),
rp AS (SELECT x.run_id, greatest(avg((x.v = y.v)::INT) - any_value(base), 0) AS repeats FROM d x JOIN d y ON x.run_id = y.run_id AND x.seq_id = y.seq_id AND y.pos = x.pos + 1, rb GROUP BY x.run_id), tn AS (SELECT count(*) AS n FROM orders_seq WHERE segment = 'BUILDING' AND len(symbols) >= 2), td AS (SELECT DISTINCT seq_id, sym FROM tok WHERE segment = 'BUILDING' AND len >= 2),
tc AS (SELECT x.sym AS a, y.sym AS b, count(*) / any_value(n) AS p FROM td x JOIN td y ON x.seq_id = y.seq_id AND x.sym < y.sym, tn GROUP BY ALL), dd AS (SELECT DISTINCT run_id, seq_id, v FROM d WHERE len >= 2 AND v <> '?'), co AS (SELECT x.run_id, avg(ln(coalesce(p, 1e-4))) AS together FROM dd x JOIN dd y ON x.run_id = y.run_id AND x.seq_id = y.seq_id AND x.v < y.v LEFT JOIN tc ON a = x.v AND b = y.v GROUP BY x.run_id),
s1 AS (SELECT run_id, ll, "positional", repeats, together, ll + "positional" * abs(ll) * 0.005 AS s FROM l0 JOIN po USING (run_id) JOIN rp USING (run_id) JOIN co USING (run_id)), s2 AS (SELECT *, s - 0.5 * repeats * abs(s) AS u FROM s1)
SELECT run_id, round(ll, 3) AS ll, round("positional", 6) AS "positional", round(repeats, 6) AS repeats, round(together, 6) AS together, round(u + 0.02 * together * abs(u), 3) AS score FROM s2""")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Four mappings, which leave some symbols without a value, against the sequences of one segment."""
    x = orders(spark, sf)
    s = lm.score_mappings_fully(x, _runs(spark, sf).where("sym NOT LIKE '%5'"), x.where("segment = 'BUILDING'"), 0.005, 0.5, 0.02)
    return _rounded(s.withColumns({c: F.round(c, 3) for c in ("ll", "score")}), "positional", "repeats", "together")
