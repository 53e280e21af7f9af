"""Queries over typologies, permutation tests and checks of mappings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqweave.operators import hypotheses as h
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators import signif as s
from seqweave.operators import transforms as t
from seqweave.plans.counting import POS1, POS3, TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.classes import MODES
from seqweave.plans.inference import RUNS, _runs
from seqweave.plans.registry import ORACLE, query
from seqweave.sources.adapters import ORDERS, lines, orders, table, tok


POINTS = {
    "numeral": "4 * (log_freq > 0.8)::INT + 3 * (diversity < 0.2)::INT + 2 * (boundary > 0.2 AND boundary < 0.8)::INT + (isolation < 0.05)::INT",
    "determinative": "5 * (initial > 0.7 OR terminal > 0.7)::INT + 2 * (isolation < 0.02)::INT + 2 * (log_freq > 0.2 AND log_freq < 0.85)::INT + (entropy < 0.35)::INT",
    "logogram": "4 * (isolation > 0.15)::INT + 2 * (log_freq > 0.5)::INT + 2 * (entropy > 0.3 AND entropy < 0.75)::INT + 2 * (diversity > 0.15 AND diversity < 0.6)::INT",
    "phonetic": "3 * (boundary < 0.35)::INT + 3 * (diversity > 0.4)::INT + 2 * (entropy > 0.55)::INT + 2 * (isolation < 0.05)::INT",
    "boundary_marker": "5 * (boundary > 1.2)::INT + 3 * (log_freq > 0.7)::INT + 2 * (polyvalence > 0.15)::INT",
}
NINE = f"""{MODES}, cn AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL), tp AS (SELECT lang, sym AS top, cnt AS mx FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, sym) AS i FROM cn) WHERE i = 1), hd AS (SELECT lang, seq_id, sym, any_value(len) AS len, bool_or(pos = 0) AS f, bool_or(pos = len - 1) AS l FROM tok GROUP BY lang, seq_id, sym),
sm AS (SELECT h.lang, h.sym, count(*) AS same FROM hd h JOIN tp ON tp.lang = h.lang JOIN hd o ON o.seq_id = h.seq_id AND o.sym = tp.top GROUP BY ALL), ft AS (SELECT lang, sym, count(*) AS seqs, count(*) FILTER (len = 1) AS alone, count(*) FILTER (len > 1 AND f) AS fi, count(*) FILTER (len > 1 AND l) AS la FROM hd GROUP BY ALL),
nb AS (SELECT lang, sym, count(*) AS near FROM (SELECT DISTINCT x.lang, x.sym, y.sym AS o, 'r' AS d FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 UNION ALL SELECT DISTINCT y.lang, y.sym, x.sym, 'l' FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1) GROUP BY ALL),
nf AS (SELECT lang, sym, n, round(alone / seqs, 4) AS isolation, round(fi / seqs, 4) AS initial, round(la / seqs, 4) AS terminal, round((fi + la) / seqs, 4) AS boundary, round(CASE WHEN ln(mx) > 0 THEN ln(n) / ln(mx) ELSE 0 END, 4) AS log_freq, round(least(1, coalesce(near, 0) / greatest(2 * sqrt(n), 1)), 4) AS diversity, round(CASE WHEN n < 2 THEN 0.5 ELSE entropy END, 4) + 0.0 AS entropy, round(coalesce(same, 0) / seqs, 4) AS same_context, round(CASE WHEN n < 3 THEN 0 ELSE least(1, score) END, 4) AS polyvalence
FROM md JOIN ft USING (lang, sym) JOIN tp USING (lang) LEFT JOIN nb USING (lang, sym) LEFT JOIN sm USING (lang, sym)), k5 AS (SELECT *, {", ".join(f"({v}) AS k_{k}" for k, v in POINTS.items())} FROM nf), p5 AS (SELECT *, k_numeral + k_determinative + k_logogram + k_phonetic + k_boundary_marker AS total, greatest(k_numeral, k_determinative, k_logogram, k_phonetic, k_boundary_marker) AS best FROM k5)"""


@query("pos_10_function_shares", f"{NINE} SELECT lang, sym, n, {', '.join(h.FEATURES)}, {', '.join(f'round(CASE WHEN total > 0 THEN k_{k} / total ELSE 0.2 END, 6) AS p_{k}' for k in POINTS)}, CASE {' '.join(f'WHEN k_{k} = best THEN {chr(39)}{k}{chr(39)}' for k in POINTS)} END AS dominant FROM p5")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(h.estimator(lines(spark, sf), ["lang"]), *h.FEATURES, *[f"p_{k}" for k in POINTS])


@query("cmp_8_global_then_local", f"""{TOK_LINES}, g AS (SELECT sym, count(*) AS n, count(*) FILTER (pos = 0 AND len > 1) AS f, count(*) FILTER (pos = len - 1 AND len > 1) AS l FROM tok GROUP BY sym HAVING count(*) >= 3), gc AS (SELECT sym, CASE WHEN l / n >= 0.6 THEN 'TERMINAL' WHEN f / n >= 0.5 THEN 'INITIAL' WHEN (n - f - l) / n >= 0.65 THEN 'MEDIAL' ELSE 'MIXED' END AS class FROM g),
o AS (SELECT lang, sym, count(*) AS n, count(*) FILTER (pos = 0 AND len > 1) AS f, count(*) FILTER (pos = len - 1 AND len > 1) AS l FROM tok GROUP BY ALL), v AS (SELECT o.sym, class, CASE WHEN n < 5 THEN 'insufficient' WHEN CASE class WHEN 'TERMINAL' THEN l / n WHEN 'INITIAL' THEN f / n ELSE (n - f - l) / n END >= 0.5 THEN 'agree' ELSE 'disagree' END AS verdict FROM o JOIN gc ON gc.sym = o.sym WHERE class <> 'MIXED'),
k AS (SELECT sym, class AS class_global, count(*) FILTER (verdict = 'agree') AS agree, count(*) FILTER (verdict = 'disagree') AS disagree, count(*) FILTER (verdict = 'insufficient') AS insufficient FROM v GROUP BY ALL) SELECT *, CASE WHEN agree > 0 AND disagree = 0 THEN 'stable' WHEN agree > disagree THEN 'partial' ELSE 'unstable' END AS stability FROM k""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return h.global_then_local(lines(spark, sf), "lang")


MEASURED = f"{TOK_ORDERS}, al AS (SELECT nation, segment, sym FROM tok), f0 AS (SELECT nation AS k, sym, count(*) AS cnt FROM tok GROUP BY ALL), f AS (SELECT k, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h1, count(*) AS types FROM f0 GROUP BY k), g0 AS (SELECT segment AS k, sym, count(*) AS cnt FROM tok GROUP BY ALL), g AS (SELECT k, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h1, count(*) AS types FROM g0 GROUP BY k), fl AS (SELECT nation AS k, avg(len(symbols)) AS m FROM orders_seq GROUP BY 1), gl AS (SELECT segment AS k, avg(len(symbols)) AS m FROM orders_seq GROUP BY 1)"


def _measured(x, key):  # noqa: ANN001, ANN202
    return m.entropy(m.symbol_counts(x, [key]), [key]).select(key, F.col("h").alias("h1"), "types").join(x.groupBy(key).agg(F.avg(F.size("symbols")).alias("mean_len")), key)


@query("cmp_11_typology", f"""{MEASURED}, d AS (SELECT f.k AS nation, CASE WHEN f.h1 < 4.7 AND f.types < 50 THEN 'abjad' WHEN f.h1 < 6.5 AND f.types < 120 THEN 'syllabary' WHEN f.types > 200 THEN 'logographic' ELSE 'mixed' END AS tier, g.k AS name, round(sqrt(pow((f.h1 - g.h1) / 5, 2) + pow((ln(1 + f.types) - ln(1 + g.types)) / 2, 2) + pow((fl.m - gl.m) / 2, 2)), 4) AS distance FROM f JOIN fl ON fl.k = f.k, g JOIN gl ON gl.k = g.k)
SELECT nation, tier, rank, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY distance, name) AS rank FROM d) WHERE rank <= 3""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(h.typology(_measured(x, "nation"), "nation", _measured(x, "segment").withColumnRenamed("segment", "name")))


LENS = f"WITH {ORDERS}, l AS (SELECT nation, len(symbols) AS len, count(*) AS n FROM orders_seq GROUP BY ALL), q0 AS (SELECT segment AS profile, len(symbols) AS len, count(*) AS k FROM orders_seq GROUP BY ALL), q AS (SELECT profile, len, k / sum(k) OVER (PARTITION BY profile) AS q FROM q0)"


def _stats_sql(key: str, name: str) -> str:
    ent = lambda end, c: f"(SELECT k, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS {c} FROM (SELECT {key} AS k, symbols[{end}] AS sym, count(*) AS cnt FROM orders_seq GROUP BY ALL) GROUP BY k)"
    return f"{name} AS (SELECT * FROM (SELECT {key} AS k, avg(len(symbols)) AS mean_len, count(DISTINCT symbols) / count(*) AS distinct_share FROM orders_seq GROUP BY 1) JOIN (SELECT {key} AS k, count(DISTINCT sym) / count(*) AS ttr FROM (SELECT {key}, unnest(symbols) AS sym FROM orders_seq) GROUP BY 1) USING (k) JOIN {ent(-1, 'suffix_entropy')} USING (k) JOIN {ent(1, 'prefix_entropy')} USING (k))"


WEIGHTS = {"mean_len": 2.0, "suffix_entropy": 1.5, "prefix_entropy": 1.5, "ttr": 1.0, "distinct_share": 1.0}


@query("cmp_12_family_ranking", f"""{LENS}, pl AS (SELECT nation, len, n / sum(n) OVER (PARTITION BY nation) AS p FROM l), c AS (SELECT nation, n.profile, sum(p * ln(p / coalesce(q, 1e-6))) AS kl FROM pl CROSS JOIN (SELECT DISTINCT profile FROM q) n LEFT JOIN q ON q.profile = n.profile AND q.len = pl.len GROUP BY ALL), {_stats_sql('nation', 'sa')}, {_stats_sql('segment', 'sb')},
w AS (SELECT nation, profile, kl, 3 * kl + {' + '.join(f'{v} * abs(sa.{k} - sb.{k})' for k, v in WEIGHTS.items())} AS cost FROM c JOIN sa ON sa.k = nation JOIN sb ON sb.k = profile), r AS (SELECT *, row_number() OVER o AS rank, exp(-cost) - exp(-lead(cost) OVER o) AS gap FROM w WINDOW o AS (PARTITION BY nation ORDER BY round(cost, 9), profile))
SELECT nation, profile, round(kl, 6) + 0.0 AS kl, round(cost, 6) AS cost, round(exp(-cost), 6) AS likeness, rank, round(CASE WHEN rank = 1 THEN gap END, 6) AS margin FROM r""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    n = x.select("nation", "segment", F.size("symbols").alias("len"))
    q = n.groupBy(F.col("segment").alias("profile"), "len").agg(F.count("*").alias("k")).withColumn("q", F.col("k") / F.sum("k").over(Window.partitionBy("profile"))).drop("k")
    return _rounded(h.profile_cost(n.groupBy("nation", "len").agg(F.count("*").alias("n")), q, "nation", h.word_stats(x, "nation"), h.word_stats(x, "segment").withColumnRenamed("segment", "profile"), WEIGHTS), "kl", "cost", "likeness", "margin")


@query("cmp_16_cluster_agreement", f"{POS1}, k AS (SELECT sym, left(sym, 7) AS ca, CASE WHEN sum(n_end) / sum(n) >= 0.2 THEN 'END' ELSE 'REST' END AS cb FROM q GROUP BY sym), b AS (SELECT ca, cb, count(*) AS shared FROM k GROUP BY ALL), x AS (SELECT ca, count(*) AS na FROM k GROUP BY ca), y AS (SELECT cb, count(*) AS nb FROM k GROUP BY cb), j AS (SELECT ca, cb, shared, shared / (na + nb - shared) AS jaccard FROM b JOIN x USING (ca) JOIN y USING (cb)) SELECT ca, cb, shared, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY ca ORDER BY round(jaccard, 9) DESC, cb) AS i FROM j) WHERE i = 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = p.start_end_counts(orders(spark, sf), [])
    return _rounded(h.cluster_agreement(c.select("sym", F.substring("sym", 1, 7).alias("cluster")), c.select("sym", F.when(F.col("end_rate") >= 0.2, "END").otherwise("REST").alias("cluster"))), "jaccard")


@query("cmp_19_rank_hypotheses", f"{TOK_ORDERS}, v AS (SELECT nation, greatest(count(DISTINCT sym) / count(*), count(*) FILTER (pos = 0) / count(*)) AS violation FROM tok GROUP BY nation) SELECT nation, round(violation, 6) AS violation, row_number() OVER (ORDER BY round(violation, 9), nation) AS rank, violation <= (SELECT min(violation) FROM v) + 0.01 AS within_band FROM v")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = p.tokens(orders(spark, sf)).groupBy("nation").agg((F.count_distinct("sym") / F.count("*")).alias("a"), (F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)) / F.count("*")).alias("b"))
    return _rounded(h.rank_hypotheses(x, "nation", ["a", "b"], 0.01), "violation")


@query("sig_2_derived_anchors", ORACLE["sig_1_context_association"].rsplit("SELECT sym, ctx, cnt, round", 1)[0] + """, zz AS (SELECT sym, ctx, cnt, pmi, coalesce(s, 0) / 20 AS mean, sqrt(greatest((coalesce(ss, 0) - 20 * pow(coalesce(s, 0) / 20, 2)) / 19, 0)) AS sd FROM pm LEFT JOIN nu USING (sym, ctx) WHERE rep = 0 AND cnt >= 5), zr AS (SELECT *, round(CASE WHEN sd > 1e-9 THEN (pmi - mean) / sd ELSE 0 END, 6) AS z FROM zz), bz AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY z DESC, ctx) AS i FROM zr WHERE z >= 0.5)
SELECT sym, ctx, cnt, round(pmi, 6) + 0.0 AS pmi, round(mean, 6) + 0.0 AS null_mean, z FROM bz WHERE i = 1 ORDER BY z DESC, sym LIMIT 20""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = s.context_association(orders(spark, sf), "segment", "s1")
    return _rounded(h.derived_anchors(x, 0.5, 20), "pmi", "null_mean", "z")


@query("sig_4_permutation_r2", f"""WITH {ORDERS}, {tok('orders_seq')}, sh AS (SELECT rep, seq_id, list(sym ORDER BY md5('s1|' || rep || '|' || seq_id || '|' || pos)) AS symbols FROM tok, range(1, 21) r(rep) GROUP BY ALL), al AS (SELECT 0 AS rep, seq_id, symbols FROM orders_seq UNION ALL SELECT * FROM sh),
t AS (SELECT rep, unnest(symbols) AS sym, generate_subscripts(symbols, 1) - 1 AS pos, len(symbols) AS len FROM al), q0 AS (SELECT rep, sym, count(*) AS n, count(*) FILTER (pos = 0 AND len > 1) AS f, count(*) FILTER (pos = len - 1 AND len > 1) AS l FROM t GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT rep, f / n AS i, l / n AS t, CASE WHEN l / n >= 0.6 THEN 'TERMINAL' WHEN f / n >= 0.5 THEN 'INITIAL' WHEN (n - f - l) / n >= 0.65 THEN 'MEDIAL' ELSE 'MIXED' END AS class FROM q0), w AS (SELECT rep, sum(k * (vi + vt)) AS within FROM (SELECT rep, class, count(*) AS k, var_pop(i) AS vi, var_pop(t) AS vt FROM q GROUP BY ALL) GROUP BY rep), a AS (SELECT rep, count(*) * (var_pop(i) + var_pop(t)) AS total FROM q GROUP BY rep),
r AS (SELECT rep, CASE WHEN total > 0 THEN 1 - within / total ELSE 0 END AS r2 FROM w JOIN a USING (rep)), o AS (SELECT r2 AS o FROM r WHERE rep = 0), n AS (SELECT count(*) AS n, count(*) FILTER (round(r2, 12) >= round(o, 12)) AS over_n, avg(r2) AS mean, stddev_samp(r2) AS sd, any_value(o) AS o FROM r, o WHERE rep > 0)
SELECT round(o, 6) + 0.0 AS observed, round((over_n + 1) / (n + 1), 6) AS p, round(mean, 6) + 0.0 AS null_mean, round(CASE WHEN sd > 1e-12 THEN (o - mean) / sd ELSE 0 END, 6) + 0.0 AS z FROM n""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).select("seq_id", "symbols")
    score = lambda d, by: p.grammar_r2(p.rates(d, by), by)
    seen, null = score(x, []), score(t.shuffle_within(x, "s1", 20), ["rep"])
    return _rounded(h.permutation_p(seen, null, "r2"), "observed", "p", "null_mean", "z")


@query("sig_16_readout", f"WITH {ORDERS}, x AS (SELECT len(symbols) AS len, count(*) AS n FROM orders_seq WHERE segment = 'BUILDING' GROUP BY 1), y AS (SELECT DISTINCT len(symbols) AS len_o FROM orders_seq WHERE segment = 'MACHINERY'), b AS (SELECT len, n, max(1 - abs(len - len_o) / 5) AS score FROM x, y WHERE abs(len - len_o) < 5 GROUP BY ALL) SELECT round(sum(n * score), 6)::DOUBLE AS total, sum(n)::BIGINT AS matched FROM b")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).select("segment", F.size("symbols").alias("len"))
    return _rounded(h.readout(x.where("segment = 'BUILDING'"), x.where("segment = 'MACHINERY'")), "total")


MAP1 = "mp1 AS (SELECT sym, value FROM mp WHERE run_id = 1)"


@query("lm_13_admissible", f"{TOK_ORDERS}, {RUNS}, {MAP1} SELECT sym, value, left(sym, 7) = left(value, 7) AS admissible FROM mp1")
def _(spark, sf):  # noqa: ANN001, ANN202
    mp = _runs(spark, sf).where("run_id = 1").select("sym", "value")
    roles = m.symbol_counts(orders(spark, sf)).select("sym", F.substring("sym", 1, 7).alias("role"))
    return h.admissible(mp, roles.withColumnRenamed("sym", "value"), roles)


@query("lm_14_compounds", f"{TOK_ORDERS}, {RUNS}, {MAP1}, c AS (SELECT x.sym AS a, y.sym AS b, count(*) AS cnt FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 GROUP BY ALL), v AS (SELECT DISTINCT symbols[1] || symbols[2] AS w FROM orders_seq WHERE len(symbols) = 2) SELECT round(sum(CASE WHEN x.value || y.value IN (FROM v) THEN cnt ELSE -0.5 * cnt END), 6)::DOUBLE AS score, sum(cnt)::BIGINT AS bigrams FROM c JOIN mp1 x ON x.sym = a JOIN mp1 y ON y.sym = b")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    v = x.where("size(symbols) = 2").select(F.array_join("symbols", "").alias("word"))
    return _rounded(h.compound_score(x, _runs(spark, sf).where("run_id = 1"), v), "score")


@query("lm_17_transliterate", f"{TOK_ORDERS} SELECT seq_id, string_agg(CASE WHEN sym LIKE '%#1_' THEN 'r' || right(sym, 2) ELSE '[' || sym || ']' END, '-' ORDER BY pos) AS reading, round(count(*) FILTER (sym LIKE '%#1_') / count(*), 6) AS coverage FROM tok GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    anchors = m.symbol_counts(x).where("sym LIKE '%#1_'").select("sym", F.concat(F.lit("r"), F.substring("sym", -2, 2)).alias("reading"))
    return _rounded(h.transliterate(x, anchors), "coverage")


@query("lm_19_target_bigrams", f"{TOK_LINES}, v AS (SELECT DISTINCT sym FROM tok WHERE lang = 'en'), w AS (SELECT sym, unnest(range(1, length(sym) - 2)) AS i FROM v WHERE length(sym) >= 4) SELECT substr(sym, i, 2) AS a, substr(sym, i + 2, 2) AS b, count(*) AS cnt FROM w GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return h.target_bigrams(m.symbol_counts(lines(spark, sf).where("lang = 'en'")).select("sym"), "sym")


CONF = "CASE WHEN right(sym, 1) = '1' THEN 'HIGH' WHEN right(sym, 1) = '2' THEN 'MEDIUM' ELSE 'LOW' END"


@query("lm_20_anchor_score", f"{TOK_ORDERS}, {RUNS}, w AS (SELECT CASE {CONF} WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.5 ELSE 0.2 END AS w, value = sym AS ok FROM mp WHERE run_id = 1) SELECT round(sum(w), 6) AS total, round(sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w), 6) AS score FROM w")
def _(spark, sf):  # noqa: ANN001, ANN202
    a = m.symbol_counts(orders(spark, sf)).select("sym", F.col("sym").alias("value"), F.expr(CONF).alias("confidence"))
    return _rounded(h.anchor_score(_runs(spark, sf).where("run_id = 1"), a), "total", "score")


@query("lm_21_readable", f"{TOK_ORDERS} SELECT (SELECT count(*) FROM orders_seq) AS sequences, count(DISTINCT seq_id) AS readable, round(count(DISTINCT seq_id) / (SELECT count(*) FROM orders_seq), 6) AS share FROM tok WHERE right(sym, 1) = '1'")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(h.readable(x, m.symbol_counts(x).select("sym", F.expr(CONF).alias("confidence"))), "share")


@query("aln_3_cross_validate", f"{POS3.replace('nation, sym', 'sym')}, b AS (SELECT sym, class AS rb FROM q WHERE right(sym, 1) <> '3') SELECT q.sym, CASE WHEN rb IS NULL THEN 'unmapped' WHEN rb = class THEN 'confirmed' ELSE 'conflict' END AS status FROM q LEFT JOIN b ON q.sym = b.sym")
def _(spark, sf):  # noqa: ANN001, ANN202
    r = p.rates(orders(spark, sf), []).select("sym", F.col("class").alias("role"))
    return h.cross_validate(r, r.where("right(sym, 1) <> '3'"))


@query("aln_10_cohorts", f"WITH {ORDERS} SELECT CASE WHEN len(symbols) <= 2 THEN 'short' WHEN len(symbols) <= 4 THEN 'middle' ELSE 'long' END AS cohort, count(*) AS n, round(avg(CASE WHEN list_contains(symbols, 'Brand#11') THEN 1 ELSE 0 END), 6) AS hit_rate FROM orders_seq GROUP BY 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(h.cohorts(orders(spark, sf), F.size("symbols"), [("short", 0, 2), ("middle", 3, 4), ("long", 5, 10**6)], F.array_contains("symbols", "Brand#11")), "hit_rate")


@query("aln_12_contains", f"{TOK_LINES}, a AS (SELECT DISTINCT sym AS x FROM tok WHERE lang = 'de' AND length(sym) >= 4), b AS (SELECT DISTINCT sym AS y FROM tok WHERE lang = 'es' AND length(sym) >= 4) SELECT x, y FROM a JOIN b ON contains(y, x) OR contains(x, y)")
def _(spark, sf):  # noqa: ANN001, ANN202
    v = lambda k: m.symbol_counts(lines(spark, sf).where(F.col("lang") == k)).select(F.col("sym").alias("term"))
    return h.contains_either_way(v("de"), v("es"))


@query("evd_14_claims_listing", "WITH c AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[0-9]{6,}')) AS q FROM documents) SELECT lang, count(*) AS claims, count(DISTINCT doc_id) AS documents FROM c GROUP BY lang")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents")
    c = d.select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{6,}"), 0)).alias("q"))
    return c.groupBy("lang").agg(F.count("*").alias("claims"), F.count_distinct("doc_id").alias("documents"))


@query("evd_21_flatten_json", "SELECT event_id, j.key AS path, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) j")
def _(spark, sf):  # noqa: ANN001, ANN202
    return h.flattened(table(spark, sf, "events"), "event_id", "props")


@query("aln_10_top_of_cohorts", f"WITH {ORDERS}, c AS (SELECT CASE WHEN len(symbols) <= 2 THEN 'short' WHEN len(symbols) <= 4 THEN 'middle' ELSE 'long' END AS cohort, seq_id, len(list_filter(symbols, lambda x: x = 'Brand#11')) AS score FROM orders_seq) SELECT cohort, rank, seq_id, score FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY score DESC, seq_id) AS rank FROM c) WHERE rank <= 3")
def _(spark, sf):  # noqa: ANN001, ANN202
    hits = F.size(F.filter("symbols", lambda v: v == "Brand#11"))
    return _rounded(h.top_of_cohorts(orders(spark, sf), "seq_id", F.size("symbols"), [("short", 0, 2), ("middle", 3, 4), ("long", 5, 10**6)], hits))
