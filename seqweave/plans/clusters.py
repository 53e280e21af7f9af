"""Queries over choices of clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import assoc as a
from seqweave.operators import clusters as k
from seqweave.operators import positions as p
from seqweave.plans.counting import POS1, _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import orders

FEATURES = ["log_freq", "start_rate", "end_rate", "pos_entropy", "out_entropy", "in_entropy"]


@query("net_26_choice", f"""{POS1}, x AS (SELECT sym, sum(n_start) / sum(n) AS s, sum(n_end) / sum(n) AS e FROM q GROUP BY sym), y AS (SELECT *, substr(sym, 7)::INT AS i FROM x),
c AS (SELECT 2 AS k, sym, s, e, CASE WHEN i < 13 THEN 0 ELSE 1 END AS cluster FROM y UNION ALL SELECT 5, sym, s, e, i % 5 FROM y UNION ALL SELECT 6, sym, s, e, (i % 10) * (i // 10 % 2) FROM y),
d AS (SELECT a.k, a.sym, a.cluster, b.cluster AS other, avg((a.s - b.s) ** 2 + (a.e - b.e) ** 2) FILTER (a.sym <> b.sym) AS d FROM c a JOIN c b ON a.k = b.k GROUP BY ALL),
m AS (SELECT k, sym, max(d) FILTER (other = cluster) AS a, min(d) FILTER (other <> cluster) AS b FROM d GROUP BY ALL), si AS (SELECT k, avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS silhouette FROM m GROUP BY k),
n AS (SELECT k, cluster, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT k, sum(n)::BIGINT AS symbols, count(*) AS clusters, max(n) / sum(n) AS largest, 1 - (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(sum(n)) AS reduction FROM n GROUP BY k),
r AS (SELECT *, silhouette * (1 + reduction) AS score FROM g JOIN si USING (k))
SELECT k, symbols, clusters, round(largest, 6) AS largest, round(silhouette, 6) AS silhouette, round(reduction, 6) AS reduction, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 4) DESC, k) = 1 AS best, CASE WHEN largest > 0.5 THEN 'crowded' WHEN reduction > 0.9 THEN 'flat' WHEN clusters < 5 THEN 'few' END AS fault FROM r""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = p.start_end_counts(orders(spark, sf), []).select("sym", "start_rate", "end_rate")
    i = F.expr("substring(sym, 7)").cast("int")
    cut = lambda n, c: F.struct(F.lit(n).alias("k"), c.cast("int").alias("cluster"))
    c = x.select("sym", F.explode(F.array(cut(2, F.when(i < 13, 0).otherwise(1)), cut(5, i % 5), cut(6, (i % 10) * (F.floor(i / 10) % 2)))).alias("c")).select("c.k", "sym", "c.cluster")
    return _rounded(k.choice(x, ["start_rate", "end_rate"], c, least_clusters=5), "largest", "silhouette", "reduction", "score")


@query("net_26_chosen_clusters")
def _(spark, sf):  # noqa: ANN001, ANN202
    f = a.features(orders(spark, sf), [])
    return _rounded(k.chosen(f, FEATURES, [2, 3, 4, 6, 8], least_clusters=3), "score")
