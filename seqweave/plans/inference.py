"""Queries over comparison, significance, language models and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions.exprs import r6
from seqweave.operators import align as al
from seqweave.operators import compare as c
from seqweave.operators import lm
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators import signif as s
from seqweave.operators.resampling import POISSON
from seqweave.operators import transforms as t
from seqweave.plans.counting import BI_ORDERS, POS3, SEG, TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import ORDERS, events, grams, lines, orders, table, tok

def unit_sql(seed: str, *keys: str) -> str:
    """SQL: a number in [0, 1) from 8 digits of the md5 of seed and keys."""
    return f"('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(keys)}), 1, 8))::BIGINT::DOUBLE / 4294967296.0"


def poisson_sql(seed: str) -> str:
    """SQL: Poisson(1) inverted at u."""
    return "(" + " + ".join(f"(u >= {p!r})::INT" for p in POISSON) + ")"


PAIRS = f"""{TOK_LINES}, c AS (SELECT lang AS s, sym, count(*)::DOUBLE AS cnt FROM tok WHERE lang IS NOT NULL GROUP BY ALL), n AS (SELECT DISTINCT s FROM c),
pr AS (SELECT a.s AS x, b.s AS y FROM n a JOIN n b ON a.s < b.s), sy AS (SELECT DISTINCT sym FROM c),
pq0 AS (SELECT pr.x, pr.y, sy.sym, coalesce(d.cnt, 0) AS cx, coalesce(e.cnt, 0) AS cy FROM pr CROSS JOIN sy LEFT JOIN c d ON d.s = pr.x AND d.sym = sy.sym LEFT JOIN c e ON e.s = pr.y AND e.sym = sy.sym), pq AS (SELECT * FROM pq0 WHERE cx > 0 OR cy > 0)"""
DIV = f"{PAIRS}, sh AS (SELECT x, y, (cx + {{0}}) / (sum(cx) OVER w + {{0}} * count(*) OVER w) AS p, (cy + {{0}}) / (sum(cy) OVER w + {{0}} * count(*) OVER w) AS q FROM pq WINDOW w AS (PARTITION BY x, y)) SELECT x, y, round(sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END), 6) AS kl, round(sum(CASE WHEN p > 0 AND q > 0 THEN q * log2(q / p) ELSE 0 END), 6) AS kl_back, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 6) AS js FROM sh GROUP BY x, y"


def div_sql(head: str, stratum: str, smoothing: float = 0.0, epsilon: float = 0.0, keys: str = "", counted: str = "tok", weight: str = "count(*)") -> str:
    """SQL: divergences and overlaps `dv` of all pairs of strata, by more keys if given, after a head that ends in a table of tokens."""
    k = lambda t: "".join(f"{t}.{x}, " for x in keys.split(", ") if x)
    on = lambda a, b: "".join(f" AND {a}.{x} = {b}.{x}" for x in keys.split(", ") if x)
    comma = f"{keys}, " if keys else ""
    return f"""{head}, c AS (SELECT {comma}{stratum} AS s, sym, {weight}::DOUBLE AS cnt FROM {counted} WHERE {stratum} IS NOT NULL GROUP BY ALL), n AS (SELECT DISTINCT s FROM c),
pq AS (SELECT * FROM (SELECT {k('sy')}a.s AS x, b.s AS y, sy.sym, coalesce(d.cnt, 0) AS cx, coalesce(e.cnt, 0) AS cy FROM n a JOIN n b ON a.s < b.s CROSS JOIN (SELECT DISTINCT {comma}sym FROM c) sy LEFT JOIN c d ON d.s = a.s AND d.sym = sy.sym{on('d', 'sy')} LEFT JOIN c e ON e.s = b.s AND e.sym = sy.sym{on('e', 'sy')}) WHERE cx > 0 OR cy > 0),
sh AS (SELECT {comma}x, y, cx, cy, ((cx + {smoothing}) / (sum(cx) OVER w + {smoothing} * count(*) OVER w) + {epsilon}) / (1 + {epsilon} * count(*) OVER w) AS p, ((cy + {smoothing}) / (sum(cy) OVER w + {smoothing} * count(*) OVER w) + {epsilon}) / (1 + {epsilon} * count(*) OVER w) AS q FROM pq WINDOW w AS (PARTITION BY {comma}x, y)),
dv AS (SELECT {comma}x, y, sum(CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END) AS kl, sum(CASE WHEN p > 0 AND q > 0 THEN q * log2(q / p) ELSE 0 END) AS kl_back, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END) AS js,
count(*) FILTER (cx > 0 AND cy > 0) AS shared, count(*) FILTER (cy = 0) AS only_x, count(*) FILTER (cx = 0) AS only_y FROM sh GROUP BY {comma}x, y)"""


def _pairs(spark, sf):  # noqa: ANN001, ANN202
    return c.stratum_pairs(m.symbol_counts(lines(spark, sf), ["lang"]), "lang")


@query("cmp_1_divergence", DIV.replace("{0}", "0.0"))
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.divergences(_pairs(spark, sf)), "kl", "kl_back", "js")


@query("cmp_3_smoothed_divergence", DIV.replace("{0}", "1.0"))
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.divergences(_pairs(spark, sf), 1.0), "kl", "kl_back", "js")


@query("cmp_2_epsilon_divergence", div_sql(TOK_LINES, "lang", epsilon=0.001) + " SELECT x, y, round(kl, 6) AS kl, round(kl_back, 6) AS kl_back, round(js, 6) AS js FROM dv")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.divergences(_pairs(spark, sf), epsilon=0.001), "kl", "kl_back", "js")


@query("cmp_6_overlap", f"{PAIRS} SELECT x, y, count(*) FILTER (cx > 0 AND cy > 0) AS shared, count(*) FILTER (cy = 0) AS only_x, count(*) FILTER (cx = 0) AS only_y, round(count(*) FILTER (cx > 0 AND cy > 0) / count(*), 6) AS jaccard FROM pq GROUP BY x, y")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.overlaps(_pairs(spark, sf)), "jaccard")


@query("cmp_4_slot_divergence", f"""{BI_ORDERS.replace('SELECT x.segment,', 'SELECT x.pos AS pos, x.segment,')}, g AS (SELECT segment, a, b, count(*) FILTER (pos = 0) AS ca, count(*) FILTER (pos > 0) AS cb FROM bi GROUP BY ALL),
w AS (SELECT *, count(*) OVER w AS v, sum(ca) OVER w AS na, sum(cb) OVER w AS nb FROM g WINDOW w AS (PARTITION BY segment, a)) SELECT segment, a AS sym, round(sum((ca + 1) / (na + v) * log2(((ca + 1) / (na + v)) / ((cb + 1) / (nb + v)))), 6) + 0.0 AS kl FROM w WHERE na > 0 AND nb > 0 GROUP BY ALL""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.slot_divergence(orders(spark, sf), SEG), "kl")


@query("cmp_5_site_profile", f"""{TOK_ORDERS}, u AS (SELECT nation, sym, count(*) AS cnt FROM tok GROUP BY ALL), n AS (SELECT nation, count(*) AS sequences FROM orders_seq GROUP BY ALL)
SELECT nation, any_value(sequences) AS sequences, sum(cnt)::BIGINT AS tokens, count(*) AS types, count(*) FILTER (cnt = 1) AS hapax, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS h1 FROM u JOIN n USING (nation) GROUP BY nation""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    u = m.symbol_counts(x, ["nation"])
    n = F.sum(F.col("cnt").cast("double"))
    h = u.groupBy("nation").agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"), F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).alias("hapax"), r6(F.log2(n) - F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))) / n).alias("h1"))
    return x.groupBy("nation").agg(F.count("*").alias("sequences")).join(h, "nation")


@query("cmp_7_class_stability", f"{POS3} SELECT sym, count(DISTINCT nation) AS sites, count(DISTINCT class) AS classes, string_agg(DISTINCT class, ',' ORDER BY class) AS found, count(DISTINCT class) = 1 AS stable FROM q GROUP BY sym HAVING count(DISTINCT nation) >= 2")
def _(spark, sf):  # noqa: ANN001, ANN202
    return c.class_stability(p.rates(orders(spark, sf), ["nation"]), "nation")


@query("cmp_10_nearest", f"""{TOK_ORDERS}, u AS (SELECT nation, sym, count(*) AS cnt FROM tok GROUP BY ALL), l AS (SELECT nation, avg(len(symbols)) AS mean_len FROM orders_seq GROUP BY ALL),
f AS (SELECT nation, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h, any_value(mean_len) AS mean_len FROM u JOIN l USING (nation) GROUP BY nation), b AS (SELECT min(h) AS h0, max(h) AS h1, min(mean_len) AS l0, max(mean_len) AS l1 FROM f),
d AS (SELECT x.nation, y.nation AS ref, round(sqrt(pow((x.h - y.h) / (h1 - h0), 2) + pow((x.mean_len - y.mean_len) / (l1 - l0), 2)), 9) AS distance FROM f x JOIN f y ON x.nation <> y.nation, b)
SELECT nation, ref, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY distance, ref) AS rank FROM d) WHERE rank <= 3""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    f = m.entropy(m.symbol_counts(x, ["nation"]), ["nation"]).select("nation", "h").join(x.groupBy("nation").agg(F.avg(F.size("symbols")).alias("mean_len")), "nation")
    return _rounded(c.nearest(f, "nation", ["h", "mean_len"], f), "distance")


@query("cmp_10_cosine", f"""{TOK_ORDERS}, u AS (SELECT nation, sym, count(*) AS cnt FROM tok GROUP BY ALL), l AS (SELECT nation, avg(len(symbols)) AS mean_len FROM orders_seq GROUP BY ALL),
f AS (SELECT nation, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h, any_value(mean_len) AS m FROM u JOIN l USING (nation) GROUP BY nation), d AS (SELECT x.nation, y.nation AS ref, round(1 - (x.h * y.h + x.m * y.m) / sqrt((x.h * x.h + x.m * x.m) * (y.h * y.h + y.m * y.m)), 9) AS distance FROM f x JOIN f y ON x.nation <> y.nation)
SELECT nation, ref, round(distance, 6) + 0.0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY distance, ref) AS rank FROM d) WHERE rank <= 3""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    f = m.entropy(m.symbol_counts(x, ["nation"]), ["nation"]).select("nation", "h").join(x.groupBy("nation").agg(F.avg(F.size("symbols")).alias("mean_len")), "nation")
    return _rounded(c.nearest(f, "nation", ["h", "mean_len"], f, metric="cosine"), "distance")


@query("cmp_14_patterns", f"WITH {ORDERS} SELECT segment, array_to_string(symbols[1:4], '+') AS pattern, count(*) AS n FROM orders_seq GROUP BY ALL HAVING count(*) >= 2")
def _(spark, sf):  # noqa: ANN001, ANN202
    return orders(spark, sf).groupBy("segment", F.array_join(F.slice("symbols", 1, 4), "+").alias("pattern")).agg(F.count("*").alias("n")).where("n >= 2")


@query("cmp_20_catalogue", "SELECT 'o_orderstatus' AS dim, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(spark, sf):  # noqa: ANN001, ANN202
    return c.catalogue(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("sig_1_context_association", f"""WITH {ORDERS}, b AS (SELECT seq_id, segment AS ctx, list_distinct(symbols) AS symbols FROM orders_seq), x AS (SELECT rep, seq_id, ctx, symbols FROM b, range(1, 21) r(rep)),
l AS (SELECT rep, symbols, row_number() OVER (PARTITION BY rep ORDER BY md5('s1|a|' || rep || '|' || seq_id)) AS i FROM x), r AS (SELECT rep, ctx, row_number() OVER (PARTITION BY rep ORDER BY md5('s1|b|' || rep || '|' || seq_id)) AS i FROM x),
al AS (SELECT 0 AS rep, ctx, unnest(symbols) AS sym FROM b UNION ALL SELECT l.rep, ctx, unnest(symbols) FROM l JOIN r ON l.rep = r.rep AND l.i = r.i), c AS (SELECT rep, sym, ctx, count(*) AS cnt FROM al GROUP BY ALL),
pm AS (SELECT *, ln(cnt * sum(cnt) OVER (PARTITION BY rep) / (sum(cnt) OVER (PARTITION BY rep, sym) * sum(cnt) OVER (PARTITION BY rep, ctx))) AS pmi FROM c),
nu AS (SELECT sym, ctx, sum(pmi) AS s, sum(pmi * pmi) AS ss FROM pm WHERE rep > 0 GROUP BY ALL)
SELECT sym, ctx, cnt, round(pmi, 5) + 0.0 AS pmi, round(coalesce(s, 0) / 20, 5) + 0.0 AS null_mean FROM pm LEFT JOIN nu USING (sym, ctx) WHERE rep = 0 AND cnt >= 5""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = s.context_association(orders(spark, sf), "segment", "s1")
    return x.select("sym", "ctx", "cnt", (F.round("pmi", 5) + 0.0).alias("pmi"), (F.round("null_mean", 5) + 0.0).alias("null_mean"))


@query("sig_3_position_null", f"""WITH {ORDERS}, {tok('orders_seq')}, sh AS (SELECT rep, seq_id, list(sym ORDER BY md5('s1|' || rep || '|' || seq_id || '|' || pos)) AS symbols FROM tok, range(1, 21) r(rep) GROUP BY ALL),
al AS (SELECT 0 AS rep, symbols FROM orders_seq UNION ALL SELECT rep, symbols FROM sh), e AS (SELECT rep, symbols[1] AS sym, 'start' AS "end" FROM al WHERE len(symbols) > 1 UNION ALL SELECT rep, symbols[-1], 'end' FROM al WHERE len(symbols) > 1), c AS (SELECT rep, sym, "end", count(*) AS cnt FROM e GROUP BY ALL),
j AS (SELECT o.sym, o."end", o.cnt, n.cnt AS k FROM c o LEFT JOIN c n ON n.rep > 0 AND o.sym = n.sym AND o."end" = n."end" WHERE o.rep = 0), g AS (SELECT sym, "end", cnt, coalesce(sum(k), 0) / 20 AS mean, coalesce(sum(k * k), 0) AS ss, count(*) FILTER (k >= cnt) AS over_n FROM j GROUP BY ALL)
SELECT sym, "end", cnt, round(mean, 6) AS null_mean, round(CASE WHEN greatest((ss - 20 * mean * mean) / 19, 0) > 0 THEN (cnt - mean) / sqrt(greatest((ss - 20 * mean * mean) / 19, 0)) ELSE 0 END, 5) + 0.0 AS z, round(greatest(over_n / 20, 0.05), 6)::DOUBLE AS p FROM g""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = s.position_null(orders(spark, sf), "s1")
    return x.select("sym", "end", "cnt", r6("null_mean").alias("null_mean"), (F.round("z", 5) + 0.0).alias("z"), r6("p").alias("p"))


@query("sig_6_bootstrap", f"WITH {ORDERS}, x AS (SELECT segment, len(symbols) AS v, rep, {poisson_sql('s1')} AS w FROM (SELECT *, {unit_sql('s1', 'rep', 'seq_id')} AS u FROM orders_seq, range(1, 51) r(rep))), m AS (SELECT segment, rep, sum(w * v) / sum(w) AS m FROM x GROUP BY ALL) SELECT segment, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).select("seq_id", "segment", F.size("symbols").alias("n"))
    return _rounded(s.bootstrap_mean(x, "n", "seq_id", SEG, "s1", 50), "mean", "low", "high")


@query("sig_9_contingency", "WITH t AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS cnt FROM orders GROUP BY ALL), r AS (SELECT a, sum(cnt) AS r FROM t GROUP BY a), k AS (SELECT b, sum(cnt) AS k FROM t GROUP BY b) SELECT round(sum(cnt) * (sum(cnt * cnt / (r * k)) - 1), 6) AS chi2, sum(cnt)::BIGINT AS n, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS dof FROM t JOIN r USING (a) JOIN k USING (b)")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("cnt"))
    return _rounded(c.chi_square(x, "o_orderpriority", "o_orderstatus").select("chi2", "n", "dof"), "chi2")


@query("sig_9_enrichment", f"WITH {ORDERS}, t AS (SELECT segment, list_contains(symbols, 'Brand#11') AS hit FROM orders_seq) SELECT segment, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*) / (SELECT count(*) FILTER (hit) / count(*) FROM t), 6) AS enrichment FROM t GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).groupBy("segment", F.array_contains("symbols", "Brand#11").alias("hit")).agg(F.count("*").alias("cnt"))
    return _rounded(c.enrichment(x, "segment", "hit"), "enrichment")


@query("sig_9_independence", f"{BI_ORDERS}, g AS (SELECT segment, a, b, count(*) AS cnt FROM bi GROUP BY ALL), w AS (SELECT *, sum(cnt) OVER (PARTITION BY segment, a) AS ra, sum(cnt) OVER (PARTITION BY segment, b) AS cb FROM g) SELECT segment, round(sum(cnt) * (sum(cnt * cnt / (ra * cb)) - 1), 5) AS chi2, sum(cnt)::BIGINT AS n, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM w GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    return s.independence(orders(spark, sf), SEG).select("segment", F.round("chi2", 5).alias("chi2"), "n", "dof")


@query("sig_11_folds", f"WITH {ORDERS}, f AS (SELECT segment, floor(('0x' || substr(md5('7|' || seq_id), 1, 8))::BIGINT * 5 / 4294967296.0) AS fold, avg(len(symbols)) AS v FROM orders_seq GROUP BY ALL) SELECT segment, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS low, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS high FROM f GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    f = t.folds(orders(spark, sf), 5).groupBy("segment", "fold").agg(F.avg(F.size("symbols")).alias("v"))
    low, high = c.interval(F.avg("v"), F.stddev_samp("v"), F.count("*"))
    return f.groupBy("segment").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"), r6(low).alias("low"), r6(high).alias("high"))


@query("sig_12_cohens_d", "SELECT count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b, round((avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O')) / sqrt(((count(*) FILTER (o_orderstatus = 'F') - 1) * var_samp(o_totalprice) FILTER (o_orderstatus = 'F') + (count(*) FILTER (o_orderstatus = 'O') - 1) * var_samp(o_totalprice) FILTER (o_orderstatus = 'O')) / (count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'O') - 2)), 6) + 0.0 AS d FROM orders")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(s.cohens_d(table(spark, sf, "orders"), "o_orderstatus", "F", "O", "o_totalprice"), "d")


@query("sig_12_mann_whitney", "WITH h AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS ka, count(*) AS k FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), g AS (SELECT *, coalesce(sum(k) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS mid FROM h), t AS (SELECT sum(ka)::BIGINT AS na, (sum(k) - sum(ka))::BIGINT AS nb, sum(mid * ka) - sum(ka) * (sum(ka) + 1) / 2 AS u FROM g) SELECT na AS n_a, nb AS n_b, round(u, 3) AS u, round(2 * u / (na::DOUBLE * nb) - 1, 6) + 0.0 AS r FROM t")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = s.mann_whitney(table(spark, sf, "lineitem"), "l_returnflag", "A", "R", "l_quantity")
    return x.select("n_a", "n_b", F.round("u", 3).alias("u"), r6("r").alias("r"))


BOUND = "bd AS (SELECT seq_id, segment, list_concat(list_concat(['<BOW>'], symbols), ['<EOW>']) AS symbols FROM orders_seq), bt AS (SELECT seq_id, segment, unnest(symbols) AS sym, generate_subscripts(symbols, 1) AS pos FROM bd), bb AS (SELECT x.seq_id, x.segment, x.sym AS a, y.sym AS b FROM bt x JOIN bt y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1)"
MODEL = f"{TOK_ORDERS}, {BOUND}, al AS (SELECT segment, 'unigram' AS kind, '' AS given, sym AS gram FROM tok UNION ALL SELECT segment, 'bigram', a, a || ' ' || b FROM bb UNION ALL SELECT segment, 'initial', '', symbols[1] FROM orders_seq UNION ALL SELECT segment, 'final', '', symbols[-1] FROM orders_seq), lc AS (SELECT segment, kind, given, gram, count(*) AS cnt FROM al GROUP BY ALL), lmod AS (SELECT segment, kind, gram, cnt, cnt / sum(cnt) OVER (PARTITION BY segment, kind, given) AS p FROM lc)"


@query("lm_1_model", f"{MODEL} SELECT segment, kind, gram, cnt, round(p, 6) AS p FROM lmod")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.model(orders(spark, sf), SEG), "p")


@query("lm_1_stream", f"""WITH {ORDERS}, fl AS (SELECT segment, sym, row_number() OVER (PARTITION BY segment ORDER BY seq_id, pos) AS i FROM (SELECT segment, seq_id, unnest(symbols) AS sym, generate_subscripts(symbols, 1) AS pos FROM orders_seq)),
w AS (SELECT segment, sym AS a, lead(sym) OVER o AS b, lead(sym, 2) OVER o AS c FROM fl WINDOW o AS (PARTITION BY segment ORDER BY i)), g AS (SELECT segment, 1 AS n, a AS gram FROM w UNION ALL SELECT segment, 2, a || ' ' || b FROM w WHERE b IS NOT NULL UNION ALL SELECT segment, 3, a || ' ' || b || ' ' || c FROM w WHERE c IS NOT NULL), k AS (SELECT segment, n::BIGINT AS n, gram, count(*) AS cnt FROM g GROUP BY ALL)
SELECT segment, n, gram, cnt, round(cnt / sum(cnt) OVER (PARTITION BY segment, n), 6) AS p FROM k""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.stream_model(orders(spark, sf), SEG), "p")


@query("lm_1_words", f"{BI_ORDERS} SELECT segment, count(*) AS pairs, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS repeat_rate FROM bi GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.word_statistics(orders(spark, sf), SEG), "repeat_rate")


@query("lm_1_together", f"WITH {ORDERS}, s AS (SELECT seq_id, segment, list_distinct(symbols) AS u FROM orders_seq WHERE len(symbols) >= 2), t AS (SELECT seq_id, segment, unnest(u) AS sym FROM s), n AS (SELECT segment, count(*) AS n FROM s GROUP BY segment) SELECT x.segment, x.sym AS a, y.sym AS b, round(count(*) / any_value(n.n), 6) AS p FROM t x JOIN t y ON x.seq_id = y.seq_id AND x.sym < y.sym JOIN n ON n.segment = x.segment GROUP BY x.segment, x.sym, y.sym")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.together(orders(spark, sf), SEG), "p")


@query("lm_1_positional", f"{TOK_ORDERS} SELECT segment, sym, round(avg(CASE WHEN pos = 0 THEN 1 ELSE 0 END), 6) AS initial, round(avg(CASE WHEN pos > 0 AND pos < len - 1 THEN 1 ELSE 0 END), 6) AS medial, round(avg(CASE WHEN pos = len - 1 THEN 1 ELSE 0 END), 6) AS terminal FROM tok WHERE len >= 2 GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.positional(orders(spark, sf), SEG), "initial", "medial", "terminal")


FREQUENT = f"WITH {ORDERS.replace('orders_seq AS', 'all_seq AS')}, {tok('all_seq', 'segment', 'nation').replace('tok AS', 'all_tok AS')}, orders_seq AS (SELECT seq_id, segment, nation, list(sym ORDER BY pos) AS symbols FROM all_tok WHERE sym IN (SELECT sym FROM all_tok GROUP BY sym HAVING count(*) >= 200) GROUP BY ALL)"


@query("lm_2_frequent_model", MODEL.replace(f"WITH {ORDERS}", FREQUENT) + " SELECT segment, kind, gram, cnt, round(p, 6) AS p FROM lmod")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.model(t.filter_tokens(orders(spark, sf), min_freq=200), SEG), "p")


@query("lm_3_stream_scores", f"""WITH {ORDERS}, {grams('orders_seq', most=3)}, fl AS (SELECT sym, row_number() OVER (ORDER BY seq_id, pos) AS i FROM (SELECT seq_id, unnest(symbols) AS sym, generate_subscripts(symbols, 1) AS pos FROM orders_seq WHERE segment = 'BUILDING')),
w AS (SELECT sym AS a, lead(sym) OVER o AS b, lead(sym, 2) OVER o AS c FROM fl WINDOW o AS (ORDER BY i)), g AS (SELECT 2 AS n, a || ' ' || b AS gram FROM w WHERE b IS NOT NULL UNION ALL SELECT 3, a || ' ' || b || ' ' || c FROM w WHERE c IS NOT NULL), k AS (SELECT n, gram, count(*) / sum(count(*)) OVER (PARTITION BY n) AS p FROM g GROUP BY n, gram),
s AS (SELECT seq_id, sum(CASE WHEN x.n = 2 THEN ln(coalesce(p, 1e-8)) ELSE 0 END) AS two, sum(CASE WHEN x.n = 3 THEN ln(coalesce(p, 1e-8)) ELSE 0 END) AS three, max(x.n) AS most FROM grams x LEFT JOIN k ON x.n = k.n AND x.gram = k.gram GROUP BY seq_id)
SELECT seq_id, round(CASE WHEN (SELECT count(*) FROM fl) >= 1000 AND most > 2 THEN 0.9 * two + 0.1 * three ELSE two END, 5) AS ll FROM s""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return lm.score_stream(x, lm.stream_model(x.where("segment = 'BUILDING'"), [])).select("seq_id", F.round("ll", 5).alias("ll"))


@query("lm_3_scores", f"{MODEL}, pb AS (SELECT gram, p FROM lmod WHERE kind = 'bigram' AND segment = 'BUILDING') SELECT seq_id, round(sum(ln(coalesce(p, 1e-8))), 5) AS ll, count(*) AS pairs FROM bb LEFT JOIN pb ON gram = a || ' ' || b GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return lm.score(x, lm.model(x.where("segment = 'BUILDING'"), [])).select("seq_id", F.round("ll", 5).alias("ll"), "pairs")


def _runs(spark, sf, runs=4):  # noqa: ANN001, ANN202
    """Mappings of four runs: each symbol's true brand, or that of a neighbour in hash order in a share of the runs."""
    v = m.symbol_counts(orders(spark, sf)).select("sym")
    x = v.withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("h", F.conv(F.substring(t.hashed("m", F.col("run_id"), F.col("sym")), 1, 2), 16, 10).cast("int"))
    return x.select(F.col("run_id").cast("long").alias("run_id"), "sym", F.when(F.col("h") < 180, F.col("sym")).otherwise("Brand#11").alias("value"))


RUNS = "mp AS (SELECT run_id, sym, CASE WHEN ('0x' || substr(md5('m|' || run_id || '|' || sym), 1, 2))::INT < 180 THEN sym ELSE 'Brand#11' END AS value FROM (SELECT DISTINCT sym FROM tok), range(1, 5) r(run_id))"


@query("lm_4_score_mappings", f"{MODEL}, {RUNS}, pb AS (SELECT gram, p FROM lmod WHERE kind = 'bigram' AND segment = 'BUILDING'), cc AS (SELECT x.sym AS a, y.sym AS b, count(*) AS cnt FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 GROUP BY ALL) SELECT x.run_id, round(sum(cnt * ln(coalesce(p, 1e-8))), 3) AS ll FROM cc JOIN mp x ON x.sym = a JOIN mp y ON y.sym = b AND x.run_id = y.run_id LEFT JOIN pb ON gram = x.value || ' ' || y.value GROUP BY x.run_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return lm.score_mappings(x, _runs(spark, sf), lm.model(x.where("segment = 'BUILDING'"), [])).select("run_id", F.round("ll", 3).alias("ll"))


@query("lm_5_consistency", f"{TOK_ORDERS}, {RUNS}, n AS (SELECT sym, value, count(*) AS cnt, row_number() OVER (PARTITION BY sym ORDER BY count(*) DESC, value) AS k, sum(count(*)) OVER (PARTITION BY sym) AS runs FROM mp GROUP BY sym, value) SELECT sym, max(value) FILTER (k = 1) AS value, round(max(cnt) FILTER (k = 1) / any_value(runs), 6) AS share, string_agg(value || ':' || cnt, ',' ORDER BY k) FILTER (k <= 3) AS top FROM n GROUP BY sym")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.consistency(_runs(spark, sf)), "share")


@query("lm_6_accuracy", f'{TOK_ORDERS}, {RUNS} SELECT run_id, count(*) FILTER (value = sym) AS "right", round(count(*) FILTER (value = sym) / count(*), 6) AS accuracy FROM mp GROUP BY run_id')
def _(spark, sf):  # noqa: ANN001, ANN202
    key = m.symbol_counts(orders(spark, sf)).select("sym", F.col("sym").alias("answer"))
    return _rounded(lm.accuracy(_runs(spark, sf), key), "accuracy")


@query("lm_7_agreement", f"{TOK_ORDERS}, {RUNS} SELECT x.run_id AS run_a, y.run_id AS run_b, count(*) AS shared, round(avg(CASE WHEN x.value = y.value THEN 1 ELSE 0 END), 6) AS same FROM mp x JOIN mp y ON x.sym = y.sym AND x.run_id < y.run_id GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(lm.agreement(_runs(spark, sf)), "same")


@query("lm_8_decode", f"{TOK_ORDERS}, {RUNS} SELECT seq_id, coalesce(string_agg(value, '' ORDER BY pos), '') AS decoded, count(value) AS mapped, max(len) AS len FROM tok LEFT JOIN (SELECT * FROM mp WHERE run_id = 1 AND value <> 'Brand#11') x ON tok.sym = x.sym GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    return lm.decode(orders(spark, sf), _runs(spark, sf).where("run_id = 1 AND value <> 'Brand#11'"))


RECALL = f"{TOK_ORDERS}, {RUNS}, d AS (SELECT DISTINCT lower(string_agg(value, '' ORDER BY pos)) AS word FROM tok JOIN (SELECT * FROM mp WHERE run_id = 1) x ON tok.sym = x.sym GROUP BY seq_id), v AS (SELECT DISTINCT lower(array_to_string(symbols, '')) AS word FROM orders_seq WHERE segment = 'BUILDING') SELECT (SELECT count(*) FROM v WHERE word IN (SELECT word FROM d WHERE length(word) >= {{0}})) AS hits, (SELECT count(*) FROM v) AS words"


def _recall(spark, sf, least):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    v = x.where("segment = 'BUILDING'").select(F.array_join("symbols", "").alias("word"))
    return _rounded(lm.recall(lm.decode(x, _runs(spark, sf).where("run_id = 1")), v, least), "rate")


@query("lm_8_recall", f"SELECT *, round(hits / words, 6) AS rate FROM ({RECALL.format(1)})")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _recall(spark, sf, 1)


@query("lm_9_long_recall", f"SELECT *, round(hits / words, 6) AS rate FROM ({RECALL.format(17)})")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Decodings of three symbols or more; a symbol's value has eight letters here."""
    return _recall(spark, sf, 17)


@query("lm_11_substring_matches", f"WITH {ORDERS}, {grams('orders_seq', most=5)}, v AS (SELECT DISTINCT array_to_string(symbols, ' ') AS gram FROM orders_seq WHERE len(symbols) BETWEEN 2 AND 5) SELECT gram, count(*) AS cnt FROM grams JOIN v USING (gram) GROUP BY gram")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return lm.substring_matches(x, x.where("size(symbols) BETWEEN 2 AND 5").select(F.array_join("symbols", " ").alias("word")))


@query("lm_12_class_runs", f"""{POS3.replace('nation, sym', 'sym')}, x AS (SELECT t.seq_id, t.pos, t.sym, class, CASE WHEN lag(class) OVER w = class AND lag(t.pos) OVER w = t.pos - 1 THEN 0 ELSE 1 END AS new FROM tok t JOIN q USING (sym) WINDOW w AS (PARTITION BY t.seq_id ORDER BY t.pos)),
y AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM x), z AS (SELECT *, (row_number() OVER (PARTITION BY seq_id, run ORDER BY pos) - 1) // 6 AS part FROM y)
SELECT seq_id, class, min(pos) AS start, count(*) AS n, string_agg(sym, ' ' ORDER BY pos) AS word FROM z GROUP BY seq_id, class, run, part HAVING count(*) >= 2""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(lm.class_runs(x, p.rates(x, []).select("sym", "class")))


@query("lm_15_internal_consistency", f"{TOK_ORDERS}, g AS (SELECT array_to_string(symbols, ' ') AS s, count(*) AS n FROM orders_seq GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS repeated, count(*) AS consistent FROM g")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return lm.internal_consistency(x, lm.decode(x, _runs(spark, sf).where("run_id = 1")).select("seq_id", "decoded"))


@query("lm_16_clipped_recall", f"WITH {ORDERS}, {grams('orders_seq', 'segment', most=3)}, r AS (SELECT n, gram, count(*) AS cnt FROM grams WHERE segment = 'BUILDING' GROUP BY ALL), h AS (SELECT n, gram, count(*) AS k FROM grams WHERE segment = 'MACHINERY' GROUP BY ALL) SELECT n, round(sum(least(cnt, coalesce(k, 0))) / sum(cnt), 6) AS recall FROM r LEFT JOIN h USING (n, gram) GROUP BY n")
def _(spark, sf):  # noqa: ANN001, ANN202
    g = m.ngram_counts(orders(spark, sf), 2, 3, SEG)
    return _rounded(lm.clipped_recall(g.where("segment = 'MACHINERY'").drop("segment"), g.where("segment = 'BUILDING'").drop("segment")), "recall")


@query("lm_18_anchors", f"{TOK_LINES} SELECT sym, count(*) AS cnt FROM tok GROUP BY sym ORDER BY cnt DESC, sym LIMIT 25")
def _(spark, sf):  # noqa: ANN001, ANN202
    return lm.anchors(lines(spark, sf), 25)


BIJ = "v AS (SELECT sym, printf('C%04d', row_number() OVER (ORDER BY md5('s1|' || sym))) AS match FROM (SELECT DISTINCT sym FROM tok))"


@query("aln_1_crosswalk", f"{TOK_ORDERS}, {BIJ}, n AS (SELECT sym, count(*) AS cnt FROM tok GROUP BY sym) SELECT sym, match, cnt, cnt AS total, 1.0::DOUBLE AS confidence, 'confirmed' AS status FROM v JOIN n USING (sym)")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return al.crosswalk(x, t.recode(x, t.bijection(x, "s1")))


@query("aln_2_gap_fill")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    code = t.bijection(x, "s1")
    known = code.where("to < 'C0020'").select("sym", F.col("to").alias("match"))
    return al.gap_fill(x, t.recode(x, code), known)


@query("aln_4_registry", f"{TOK_ORDERS}, c AS (SELECT sym, count(*) AS n FROM tok WHERE segment = 'BUILDING' GROUP BY sym), r AS (SELECT DISTINCT p_brand AS sym FROM part) SELECT coalesce(r.sym, c.sym) AS sym, coalesce(n, 0) AS n, CASE WHEN r.sym IS NOT NULL AND c.sym IS NOT NULL THEN 'both' WHEN c.sym IS NOT NULL THEN 'corpus' ELSE 'reference' END AS origin, left(sha256(coalesce(r.sym, c.sym)), 16) AS id FROM r FULL JOIN c ON r.sym = c.sym")
def _(spark, sf):  # noqa: ANN001, ANN202
    ref = table(spark, sf, "part").select(F.col("p_brand").alias("sym"))
    return al.registry(ref, orders(spark, sf).where("segment = 'BUILDING'")).select("sym", "n", "origin", "id")


@query("aln_6_neighbours", f"{BI_ORDERS}, e AS (SELECT segment, a AS sym, 'right' AS side, b AS nb FROM bi UNION ALL SELECT segment, b, 'left', a FROM bi), k AS (SELECT segment, sym, side, nb, count(*) AS cnt, row_number() OVER (PARTITION BY segment, sym, side ORDER BY count(*) DESC, nb) AS k FROM e GROUP BY ALL) SELECT segment, sym, side, string_agg(nb || ':' || cnt, ',' ORDER BY k) AS neighbours FROM k WHERE k <= 5 GROUP BY ALL".replace("count(*) AS cnt, row_number() OVER (PARTITION BY segment, sym, side ORDER BY count(*) DESC, nb) AS k FROM e GROUP BY ALL", "cnt, row_number() OVER (PARTITION BY segment, sym, side ORDER BY cnt DESC, nb) AS k FROM (SELECT segment, sym, side, nb, count(*) AS cnt FROM e GROUP BY ALL)"))
def _(spark, sf):  # noqa: ANN001, ANN202
    return al.top_neighbours(orders(spark, sf), SEG)


@query("aln_7_length_pairs", f"WITH {ORDERS}, x AS (SELECT len(symbols) AS len, count(*) AS na FROM orders_seq WHERE segment = 'BUILDING' GROUP BY 1), y AS (SELECT len(symbols) AS len_b, count(*) AS nb FROM orders_seq WHERE segment = 'MACHINERY' GROUP BY 1) SELECT len, len_b, na, nb, round(1 - abs(len - len_b) / 5, 6) AS score FROM x, y WHERE abs(len - len_b) < 5")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).select("segment", F.size("symbols").alias("len"))
    return _rounded(al.length_pairs(x.where("segment = 'BUILDING'"), x.where("segment = 'MACHINERY'")), "score")


@query("aln_8_entities", "SELECT user_id, count(*) AS occurrences, count(DISTINCT event_type) AS places, arg_min(event_type, event_id) AS first_place FROM events GROUP BY user_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    return al.entities(table(spark, sf, "events"), "user_id", "event_type", "event_id")


_ = events
