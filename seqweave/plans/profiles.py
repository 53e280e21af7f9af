"""Queries over recodings, corpus signatures, classes, items and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import r6
from seqweave.operators import assoc as a
from seqweave.operators import evidence as e
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators import strata as st
from seqweave.operators import transforms as t
from seqweave.plans.counting import BI_ORDERS, BLOCKS, POS1, SEG, TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import LINES, ORDERS, lines, orders, table

VARIANT = "CASE WHEN sym LIKE '%#1_' THEN 'Brand#10' ELSE sym END"


def _variants(seq):  # noqa: ANN001, ANN202
    return m.symbol_counts(seq).select("sym").where("sym LIKE '%#1_'").withColumn("to", F.lit("Brand#10"))


@query("fil_4_prefix_positions", f"{TOK_ORDERS} SELECT segment, sym, pos, count(*) AS n FROM tok WHERE sym LIKE 'Brand#2%' GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = p.tokens(orders(spark, sf)).where(F.col("sym").startswith("Brand#2"))
    return _rounded(x.groupBy("segment", "sym", "pos").agg(F.count("*").alias("n")))


@query("fil_5_zone_filter", f"WITH {ORDERS} SELECT seq_id, right(nation, 1) AS zone FROM orders_seq WHERE len(symbols) BETWEEN 3 AND 7 AND right(nation, 1) IN (SELECT right(n_name, 1) FROM nation WHERE n_regionkey = 1)")
def _(spark, sf):  # noqa: ANN001, ANN202
    zones = table(spark, sf, "nation").where("n_regionkey = 1").select(F.substring("n_name", -1, 1).alias("zone")).distinct()
    x = t.by_length(orders(spark, sf), 3, 7).select("seq_id", F.substring("nation", -1, 1).alias("zone"))
    return x.join(zones, "zone", "left_semi").select("seq_id", "zone")


@query("trn_6_strata", f"WITH {LINES} SELECT CASE WHEN len(symbols) <= 2 THEN 'short' WHEN len(symbols) <= 5 THEN 'medium' ELSE 'long' END AS stratum, count(*) AS n FROM lines GROUP BY 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    n = F.size("symbols")
    return lines(spark, sf).groupBy(F.when(n <= 2, "short").when(n <= 5, "medium").otherwise("long").alias("stratum")).agg(F.count("*").alias("n"))


@query("trn_10_variant_stats", f"{TOK_ORDERS}, b AS (SELECT sym, count(*) AS cnt FROM tok GROUP BY 1), f AS (SELECT {VARIANT} AS sym, sum(cnt) AS cnt FROM b GROUP BY 1) SELECT 'before' AS stage, count(*) AS types, sum(cnt)::BIGINT AS tokens, count(*) FILTER (cnt = 1) AS hapax FROM b UNION ALL SELECT 'after', count(*), sum(cnt)::BIGINT, count(*) FILTER (cnt = 1) FROM f")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return st.variant_stats(x, _variants(x))


@query("trn_10_variant_reduction", f"{TOK_ORDERS} SELECT seq_id, string_agg({VARIANT}, ' ' ORDER BY pos) AS symbols FROM tok GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return t.recode(x, _variants(x)).select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_11_map_rate", f"{TOK_ORDERS} SELECT segment, count(*) AS tokens, round(count(*) FILTER (sym LIKE '%#1_') / count(*), 6) AS map_rate FROM tok GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(st.map_rate(x, _variants(x), SEG), "map_rate")


@query("trn_12_crosswalk_fallback", f"{TOK_ORDERS} SELECT seq_id, string_agg(CASE WHEN sym LIKE '%#1_' THEN 'Brand#10' ELSE 'Yunknown_' || lpad(right(sym, 2), 4, '0') END, ' ' ORDER BY pos) AS symbols FROM tok GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    other = F.concat(F.lit("Yunknown_"), F.lpad(F.substring("sym", -2, 2), 4, "0"))
    return t.recode(x, _variants(x), other).select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_16_iid_control", f"""{TOK_ORDERS}, c AS (SELECT sym, sum(count(*)) OVER (ORDER BY sym) AS upto, count(*) AS cnt FROM tok GROUP BY sym), n AS (SELECT sum(cnt) AS n FROM c),
u AS (SELECT seq_id, pos, floor(('0x' || substr(md5('s1|' || seq_id || '|' || pos), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 * n) AS u FROM tok, n) SELECT seq_id, string_agg(s, ' ' ORDER BY pos) AS symbols FROM (SELECT seq_id, pos, min(c.sym) AS s FROM u JOIN c ON c.upto > u GROUP BY seq_id, pos) GROUP BY seq_id""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return st.drawn_from_frequencies(orders(spark, sf), "s1").select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_18_shuffled_letters", f"{TOK_LINES}, w AS (SELECT DISTINCT sym FROM tok WHERE lang = 'en'), k AS (SELECT sym, i, substr(sym, i + 1, 1) AS c FROM (SELECT sym, unnest(range(0, length(sym))) AS i FROM w)) SELECT sym, string_agg(c, '' ORDER BY md5('s1|' || sym || '|' || i), c) AS shuffled FROM k GROUP BY sym")
def _(spark, sf):  # noqa: ANN001, ANN202
    return st.shuffled_letters(m.symbol_counts(lines(spark, sf).where("lang = 'en'")).select("sym"), "sym", "s1")


@query("agg_22_signature", f"""{BLOCKS}, w AS (SELECT segment, max(h) FILTER (n = 1) AS h1, max(h) FILTER (n = 2) AS h2, max(h) FILTER (n = 3) AS h3 FROM b GROUP BY segment), r AS (SELECT segment, cnt, row_number() OVER (PARTITION BY segment ORDER BY cnt DESC, gram) AS rank FROM c WHERE n = 1),
z AS (SELECT segment, sum(cnt)::BIGINT AS tokens, count(*) AS types, -regr_slope(ln(cnt), ln(rank)) AS alpha, regr_r2(ln(cnt), ln(rank)) AS r2 FROM r GROUP BY segment)
SELECT segment, tokens, types, round(alpha, 6) AS alpha, round(r2, 6) AS r2, round(h1, 6) AS h1, round(greatest(0, least(1, (2 * h1 - h2) / h1)), 6) AS e2, round(greatest(0, least(1, (3 * h1 - 3 * h2 + h3) / h1)), 6) AS e3 FROM z JOIN w USING (segment)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.signature(orders(spark, sf), SEG).drop("h1_norm"), "alpha", "r2", "h1", "e2", "e3")


@query("agg_32_cross_system", f"{TOK_LINES}, c AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL), n AS (SELECT lang, count(*) AS sequences, avg(len(symbols)) AS mean_len FROM lines GROUP BY lang) SELECT lang, any_value(sequences) AS sequences, round(any_value(mean_len), 6) AS mean_len, sum(cnt)::BIGINT AS tokens, count(*) AS types, round(count(*) / sum(cnt), 6) AS ttr, count(*) FILTER (cnt = 1) AS hapax FROM c JOIN n USING (lang) GROUP BY lang")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.corpus_table(lines(spark, sf), ["lang"]), "mean_len", "ttr")


@query("pos_8_against_labels", f"{POS1}, k AS (SELECT sym, CASE WHEN sum(n_end) / sum(n) >= 0.2 THEN 'END' ELSE 'REST' END AS class, CASE WHEN right(sym, 1)::INT % 2 = 0 THEN 'END' ELSE 'REST' END AS label FROM q GROUP BY sym) SELECT label, count(*) AS n, round(avg(CASE WHEN class = label THEN 1 ELSE 0 END), 6) AS accuracy FROM k GROUP BY label")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = p.start_end_counts(orders(spark, sf), []).select("sym", F.when(F.col("end_rate") >= 0.2, "END").otherwise("REST").alias("class"))
    labels = c.select("sym", F.when(F.substring("sym", -1, 1).cast("int") % 2 == 0, "END").otherwise("REST").alias("label"))
    return _rounded(st.against_labels(c, labels), "accuracy")


@query("pos_19_label_hits", f"{TOK_ORDERS} SELECT round(i, 6) AS initial_hit, round(e, 6) AS terminal_hit, round((i + e) / 2, 6) AS score FROM (SELECT avg(CASE WHEN pos = 0 THEN 1 ELSE 0 END) AS i FROM tok WHERE sym LIKE 'Brand#1%') , (SELECT avg(CASE WHEN pos = len - 1 THEN 1 ELSE 0 END) AS e FROM tok WHERE sym LIKE 'Brand#2%')")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    v = m.symbol_counts(x).select("sym")
    return _rounded(st.label_hits(x, v.where("sym LIKE 'Brand#1%'"), v.where("sym LIKE 'Brand#2%'")), "initial_hit", "terminal_hit", "score")


@query("pos_20_cluster_profile", f"{POS1} SELECT segment, left(sym, 7) AS cluster, count(*) AS types, sum(n)::BIGINT AS n, round(sum(n_start) / sum(n), 6) AS start_rate, round(sum(n_end) / sum(n), 6) AS end_rate, round(sum(n_internal) / sum(n), 6) AS internal_rate FROM q GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return _rounded(st.cluster_profile(x, m.symbol_counts(x).select("sym", F.substring("sym", 1, 7).alias("cluster")), SEG), "start_rate", "end_rate", "internal_rate")


@query("net_4_interaction", f"""{TOK_ORDERS}, t3 AS (SELECT x.sym AS a, y.sym AS b, z.sym AS c, count(*) AS cnt FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 JOIN tok z ON z.seq_id = x.seq_id AND z.pos = x.pos + 2 GROUP BY ALL), u AS (SELECT sym, count(*) / (SELECT count(*) FROM tok) AS p FROM tok GROUP BY sym)
SELECT a, b, c, cnt, round(log2(cnt / (SELECT sum(cnt) FROM t3) / (x.p * y.p * z.p)), 6) + 0.0 AS i3 FROM t3 JOIN u x ON x.sym = a JOIN u y ON y.sym = b JOIN u z ON z.sym = c WHERE cnt >= 3""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.interaction_information(orders(spark, sf), []), "i3")


@query("net_6_trusted_collocates", f"{TOK_LINES}, u AS (SELECT sym, count(*) AS cnt FROM tok GROUP BY sym), c AS (SELECT x.sym AS a, y.sym AS b, count(*) AS cnt FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 GROUP BY ALL), pm AS (SELECT a, b, c.cnt, log2(c.cnt / (SELECT sum(cnt) FROM c) / (x.cnt / (SELECT sum(cnt) FROM u) * (y.cnt / (SELECT sum(cnt) FROM u)))) AS pmi FROM c JOIN u x ON x.sym = a JOIN u y ON y.sym = b WHERE c.cnt >= 3 AND x.cnt >= 20 AND y.cnt >= 20) SELECT a, b, cnt, round(pmi, 6) AS pmi FROM pm WHERE pmi > 1.5")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.pmi(lines(spark, sf), [], 3).where("pmi > 1.5 AND ca >= 20 AND cb >= 20").select("a", "b", "cnt", r6("pmi").alias("pmi"))


@query("net_17_context_divergence", f"""{BI_ORDERS}, v AS (SELECT segment, a AS sym, b AS ctx, count(*) AS w FROM bi GROUP BY ALL), q AS (SELECT segment, sym, ctx, w / sum(w) OVER (PARTITION BY segment, sym) AS p FROM v)
SELECT x.segment, x.sym AS x, y.sym AS y, round(1 + 0.5 * sum(x.p * log2(x.p / (x.p + y.p)) + y.p * log2(y.p / (x.p + y.p))), 6) + 0.0 AS js FROM q x JOIN q y ON x.segment = y.segment AND x.ctx = y.ctx AND x.sym < y.sym GROUP BY x.segment, x.sym, y.sym""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.context_divergence(orders(spark, sf), SEG), "js")


@query("net_18_grid", f"{POS1}, k AS (SELECT sym, left(sym, 7) AS r, CASE WHEN sum(n_end) / sum(n) >= 0.2 THEN 'END' ELSE 'REST' END AS c FROM q GROUP BY sym) SELECT r AS row, c AS col, count(*) AS n, string_agg(sym, ',' ORDER BY sym) AS symbols FROM k GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = p.start_end_counts(orders(spark, sf), [])
    return st.grid(c.select("sym", F.substring("sym", 1, 7).alias("cluster")), c.select("sym", F.when(F.col("end_rate") >= 0.2, "END").otherwise("REST").alias("cluster")))


@query("net_26_kmeans")
def _(spark, sf):  # noqa: ANN001, ANN202
    f = a.features(orders(spark, sf), []).fillna(0)
    return _rounded(st.kmeans(f, ["log_freq", "start_rate", "end_rate", "pos_entropy", "out_entropy", "in_entropy"], [2, 3, 4]), "silhouette")


@query("cmp_15_slot_shares", f"{TOK_ORDERS} SELECT nation, round(count(*) FILTER (pos = 0) / count(*), 6) AS i_share, round(count(*) FILTER (pos > 0 AND pos < len - 1) / count(*), 6) AS m_share, round(count(*) FILTER (pos = len - 1 AND len > 1) / count(*), 6) AS t_share FROM tok GROUP BY nation")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.slots_by_corpus(orders(spark, sf), ["nation"]), "i_share", "m_share", "t_share")


@query("cmp_18_correlation", f"{TOK_ORDERS}, u AS (SELECT nation, sym, count(*) AS cnt FROM tok GROUP BY ALL), h AS (SELECT nation, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h FROM u GROUP BY nation), l AS (SELECT nation, avg(len(symbols)) AS l FROM orders_seq GROUP BY nation) SELECT round(corr(h, l), 5) AS r, count(*) AS n FROM h JOIN l USING (nation)")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    h = m.entropy(m.symbol_counts(x, ["nation"]), ["nation"]).select("nation", "h").join(x.groupBy("nation").agg(F.avg(F.size("symbols")).alias("l")), "nation")
    return h.agg(F.round(F.corr("h", "l"), 5).alias("r"), F.count("*").alias("n"))


@query("sig_8_terminal_test", f"{TOK_ORDERS}, c AS (SELECT count(*) FILTER (g AND e)::DOUBLE AS a, count(*) FILTER (g AND NOT e)::DOUBLE AS b, count(*) FILTER (NOT g AND e)::DOUBLE AS c, count(*) FILTER (NOT g AND NOT e)::DOUBLE AS d FROM (SELECT sym LIKE 'Brand#1%' AS g, pos = len - 1 AS e FROM tok)), x AS (SELECT a + b + c + d AS n, (a + b + c + d) * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM c) SELECT n::BIGINT AS n, round(chi2, 6) AS chi2, round(exp(-chi2 / 2), 6) AS p FROM x")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.terminal_test(orders(spark, sf), F.col("sym").startswith("Brand#1")), "chi2", "p")


@query("sig_10_initial_by_context", f"WITH {ORDERS}, x AS (SELECT symbols[1] AS sym, nation, count(*) AS cnt FROM orders_seq GROUP BY ALL), e AS (SELECT sym, sum(cnt)::BIGINT AS n, count(*) AS contexts, (log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt)) / log2((SELECT count(DISTINCT nation) FROM orders_seq)) AS h FROM x GROUP BY sym HAVING sum(cnt) >= 5) SELECT sym, n, contexts, round(h, 6) + 0.0 AS h_norm, h < 0.5 AS restricted FROM e")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.crosstab_entropy(orders(spark, sf), "nation"), "h_norm")


@query("sig_13_binomial_z", f"{TOK_ORDERS}, g AS (SELECT sym, count(*) AS n, count(*) FILTER (pos = 0) AS hits FROM tok GROUP BY sym), b AS (SELECT sum(hits) / sum(n) AS p0 FROM g) SELECT sym, n, hits, round((hits / n - p0) / sqrt(p0 * (1 - p0) / n), 6) + 0.0 AS z FROM g, b")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = p.start_end_counts(orders(spark, sf), []).select("sym", "n", F.col("n_start").alias("hits"))
    null = c.agg((F.sum("hits") / F.sum("n")).alias("p0"))
    return _rounded(c.join(F.broadcast(null)).withColumn("z", st.binomial_z(F.col("hits"), F.col("n"), F.col("p0"))).drop("p0"), "z")


@query("sig_15_deltas", f"{TOK_ORDERS}, c AS (SELECT segment, count(DISTINCT sym) / count(*) AS v FROM tok GROUP BY segment), d AS (SELECT c.segment, c.v - b.v AS delta FROM c, (SELECT v FROM c WHERE segment = 'BUILDING') b WHERE segment <> 'BUILDING') SELECT segment, round(delta, 6) + 0.0 AS delta, row_number() OVER (ORDER BY round(abs(delta), 9) DESC, segment) AS rank, CASE WHEN delta > 0.05 THEN 'above' WHEN delta < -0.05 THEN 'below' ELSE 'same' END AS verdict FROM d")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = m.symbol_counts(orders(spark, sf), SEG).groupBy("segment").agg((F.count("*") / F.sum("cnt")).alias("v"))
    base = c.where("segment = 'BUILDING'").select(F.col("v").alias("b"))
    d = c.where("segment <> 'BUILDING'").join(F.broadcast(base)).withColumn("delta", F.col("v") - F.col("b"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("delta"), 9)), "segment"))
    return _rounded(d.select("segment", "delta", rank.alias("rank"), F.when(F.col("delta") > 0.05, "above").when(F.col("delta") < -0.05, "below").otherwise("same").alias("verdict")), "delta")


BEST = "(SELECT x, y, score FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, x, y) AS rx, row_number() OVER (PARTITION BY y ORDER BY score DESC, x, y) AS ry FROM {0}) WHERE rx = 1 AND ry = 1)"
ROUNDS = ", ".join(f"r{k} AS {BEST.format(f's{k}')}, s{k + 1} AS (SELECT * FROM s{k} WHERE x NOT IN (SELECT x FROM r{k}) AND y NOT IN (SELECT y FROM r{k}))" for k in range(1, 6))


@query("aln_9_mutual_best", f"WITH {ORDERS}, s1 AS (SELECT nation AS x, segment AS y, count(*)::DOUBLE AS score FROM orders_seq GROUP BY ALL), {ROUNDS} " + " UNION ALL ".join(f"SELECT x, y, score, {k}::BIGINT AS round FROM r{k}" for k in range(1, 6)))
def _(spark, sf):  # noqa: ANN001, ANN202
    s = orders(spark, sf).groupBy(F.col("nation").alias("x"), F.col("segment").alias("y")).agg(F.count("*").cast("double").alias("score"))
    return _rounded(st.one_to_one(s))


@query("aln_11_segment_search", "WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part), k AS (SELECT p_partkey, CASE WHEN s[1] = 'cold' THEN 2 WHEN list_contains(s, 'cold') THEN 1 ELSE 0 END + CASE WHEN s[2] = 'widget' THEN 2 WHEN list_contains(s, 'widget') THEN 1 ELSE 0 END AS score FROM s) SELECT p_partkey, score::BIGINT AS score FROM k WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 10")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.segment_search(table(spark, sf, "part"), "p_partkey", "p_name", [("cold", 0), ("widget", 1)], " "))


ITEMS = "SELECT doc_id AS id, lang AS kind, source AS topic, doc_id % 7 AS conf FROM documents"


@query("evd_3_list_items", "SELECT doc_id FROM documents WHERE lang = 'en' AND source LIKE 'src1%' ORDER BY doc_id DESC LIMIT 20 OFFSET 2")
def _(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "documents").where("lang = 'en' AND source LIKE 'src1%'").orderBy(F.desc("doc_id")).offset(2).limit(20).select("doc_id")


@query("evd_5_unsent", "SELECT doc_id FROM documents WHERE doc_id % 7 >= 3 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "documents").where("doc_id % 7 >= 3").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("evd_6_recent", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY AND event_type IN ('click', 'view', 'purchase') GROUP BY event_type")
def _(spark, sf):  # noqa: ANN001, ANN202
    ev = table(spark, sf, "events")
    now = ev.agg(F.max("ts").alias("now"))
    return ev.join(F.broadcast(now)).where("ts >= now - INTERVAL 14 DAYS AND event_type IN ('click', 'view', 'purchase')").groupBy("event_type").agg(F.count("*").alias("n"))


@query("evd_13_library", "WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]{6,}')) AS claims FROM documents) SELECT d.doc_id, coalesce(claims, 0)::BIGINT AS claims FROM documents d LEFT JOIN c USING (doc_id) WHERE contains(lower(text), 'with')")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents")
    c = e.extract(d, [("number", "[0-9]{6,}", 0.5)], 1_000_000).groupBy("doc_id").agg(F.count("*").alias("claims"))
    return d.where(F.contains(F.lower("text"), F.lit("with"))).select("doc_id").join(c, "doc_id", "left").fillna(0, ["claims"])


CLAIMS = "cl AS (SELECT d.doc_id, source, lang AS sign, CASE WHEN quality = 1 THEN 'supported' ELSE 'falsified' END AS status FROM documents d JOIN labels USING (doc_id))"


@query("evd_15_matrix", f"WITH {CLAIMS} SELECT sign, count(*) AS claims, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'falsified') AS falsified, CASE WHEN count(*) FILTER (status = 'supported') > 0 AND count(*) FILTER (status = 'falsified') > 0 THEN 'conflict' WHEN count(*) FILTER (status = 'supported') > 0 THEN 'supported' ELSE 'falsified' END AS verdict FROM cl GROUP BY sign")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = lambda v: F.sum(F.when(F.col("quality") == v, 1).otherwise(0))
    g = d.groupBy(F.col("lang").alias("sign")).agg(F.count("*").alias("claims"), n(1).alias("supported"), n(0).alias("falsified"))
    return g.withColumn("verdict", F.when((F.col("supported") > 0) & (F.col("falsified") > 0), "conflict").when(F.col("supported") > 0, "supported").otherwise("falsified"))


@query("evd_16_hypotheses", f"WITH {CLAIMS}, g AS (SELECT source, sign, status, count(*) AS n FROM cl GROUP BY ALL) SELECT a.sign, a.source AS value_source, b.source AS position_source, a.n * b.n AS pairs FROM g a JOIN g b ON a.sign = b.sign AND a.source <> b.source AND a.status = 'supported' AND b.status = 'falsified'")
def _(spark, sf):  # noqa: ANN001, ANN202
    g = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source", F.col("lang").alias("sign"), "quality").agg(F.count("*").alias("n"))
    x = g.where("quality = 1").select("sign", F.col("source").alias("value_source"), F.col("n").alias("na"))
    y = g.where("quality <> 1").select("sign", F.col("source").alias("position_source"), F.col("n").alias("nb"))
    return x.join(y, "sign").where("value_source <> position_source").select("sign", "value_source", "position_source", (F.col("na") * F.col("nb")).alias("pairs"))


@query("evd_17_claim_test", f"{POS1}, k AS (SELECT segment, sym, n_end / n AS r, avg(n_end / n) OVER (PARTITION BY segment) AS mean FROM q WHERE n >= 3) SELECT segment, sym, round(r / mean, 6) AS lift, r / mean >= 1.2 AS supported FROM k WHERE sym LIKE 'Brand#1%'")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = p.start_end_counts(orders(spark, sf), SEG).where("n >= 3").withColumn("mean", F.avg("end_rate").over(Window.partitionBy("segment")))
    lift = F.col("end_rate") / F.col("mean")
    return _rounded(c.where(F.col("sym").startswith("Brand#1")).select("segment", "sym", lift.alias("lift"), (lift >= 1.2).alias("supported")), "lift")
