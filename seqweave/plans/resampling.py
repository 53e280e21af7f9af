"""Queries over bootstraps and permutation nulls of whole measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import resampling as r
from seqweave.plans.counting import SEG, _rounded
from seqweave.plans.inference import div_sql, poisson_sql, unit_sql
from seqweave.plans.registry import query
from seqweave.sources.adapters import ORDERS, orders

REPS = 40
DRAWN = f"WITH {ORDERS}, rs AS (SELECT rep, segment, symbols, CASE WHEN rep = 0 THEN 1 ELSE {poisson_sql('b1')} END AS w FROM (SELECT *, {unit_sql('b1', 'rep', 'seq_id')} AS u FROM orders_seq, range(0, {REPS + 1}) r(rep))), wt AS (SELECT rep, segment, w, unnest(symbols) AS sym FROM rs WHERE w > 0)"


@query("sig_7_divergence_bootstrap", div_sql(DRAWN, "segment", 1.0, keys="rep", counted="wt", weight="sum(w)") + ", k AS (SELECT x, y, max((kl + kl_back) / 2) FILTER (rep = 0) AS kl, avg((kl + kl_back) / 2) FILTER (rep > 0) AS mean, quantile_cont((kl + kl_back) / 2, 0.025) FILTER (rep > 0) AS low, quantile_cont((kl + kl_back) / 2, 0.975) FILTER (rep > 0) AS high FROM dv GROUP BY x, y) SELECT x, y, round(kl, 6) AS kl, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0.3 THEN 'ROBUST' WHEN low > 0.1 THEN 'SUPPORTED' ELSE 'FRAGILE' END AS verdict FROM k")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(r.divergence_bootstrap(orders(spark, sf), "segment", "b1", REPS), "kl", "mean", "low", "high")


@query("sig_5_gap_null")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(r.gap_null(orders(spark, sf), SEG, "g1", 10), "gap", "p", "null_mean", "null_p05", "null_p95")


def readout_sql(objects: str) -> str:
    """SQL: the readout test of names (BUILDING) against a table of objects (id, len, stratum)."""
    return f"""WITH {ORDERS}, ob AS ({objects}), pool AS (SELECT stratum, 'o' AS kind, id, len FROM ob UNION ALL SELECT stratum, 'n', seq_id, len(symbols) FROM orders_seq, (SELECT DISTINCT stratum FROM ob) WHERE segment = 'BUILDING'), x AS (SELECT * FROM pool, range(1, 21) r(rep)),
a AS (SELECT rep, stratum, kind, row_number() OVER (PARTITION BY rep, stratum ORDER BY md5('r1|a|' || rep || '|' || stratum || '|' || kind || '|' || id)) AS i FROM x), b AS (SELECT rep, stratum, len, row_number() OVER (PARTITION BY rep, stratum ORDER BY md5('r1|b|' || rep || '|' || stratum || '|' || kind || '|' || id)) AS i FROM x),
al AS (SELECT 0 AS rep, stratum, kind, len FROM pool UNION ALL SELECT rep, stratum, kind, b.len FROM a JOIN b USING (rep, stratum, i)), c AS (SELECT rep, stratum, kind, len, count(*) AS n FROM al GROUP BY ALL),
bs AS (SELECT x.rep, x.stratum, x.len, x.n, max(1 - abs(x.len - y.len) / 5) AS score FROM c x JOIN c y ON x.rep = y.rep AND x.stratum = y.stratum AND x.kind = 'n' AND y.kind = 'o' AND abs(x.len - y.len) < 5 GROUP BY ALL), t AS (SELECT rep, stratum, sum(n * score) AS total, sum(n)::BIGINT AS matched FROM bs GROUP BY ALL),
rd AS (SELECT s.stratum, round(s.total, 6)::DOUBLE AS total, s.matched, round(coalesce(sum(u.total), 0) / 20, 6)::DOUBLE AS null_mean, count(*) FILTER (round(u.total, 9) >= round(s.total, 9)) / 20 AS p FROM t s LEFT JOIN t u ON u.rep > 0 AND u.stratum = s.stratum WHERE s.rep = 0 GROUP BY s.stratum, s.total, s.matched)"""


def _tested(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).select(F.col("seq_id").alias("id"), "segment", F.size("symbols").alias("len"))
    o = x.where("segment <> 'BUILDING'").withColumn("stratum", F.explode(F.array("segment", F.lit("(all)"))))
    return r.readout_test(x.where("segment = 'BUILDING'"), o, "stratum", "r1")


BOTH = "SELECT seq_id AS id, len(symbols) AS len, unnest([segment, '(all)']) AS stratum FROM orders_seq WHERE segment <> 'BUILDING'"


@query("sig_16_readout_null", readout_sql(BOTH) + " SELECT stratum, total, matched, null_mean, round(p, 6) AS p FROM rd")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(_tested(spark, sf), "total", "null_mean", "p")


@query("sig_17_significant_strata", readout_sql(BOTH) + " SELECT count(*) AS strata, count(*) FILTER (p < 0.05) AS significant FROM rd WHERE stratum <> '(all)'")
def _(spark, sf):  # noqa: ANN001, ANN202
    return r.significant_strata(_tested(spark, sf).where("stratum <> '(all)'"))
