"""Queries over association, transforms and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions.exprs import r6
from seqweave.functions.tables import written
from seqweave.operators import assoc as a
from seqweave.operators import evidence as e
from seqweave.operators import measures as m
from seqweave.operators import transforms as t
from seqweave.plans.counting import BI_ORDERS, SEG, TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import EVENTS, LINES, ORDERS, events, grams, lines, orders, table, tok

UNI = "u AS (SELECT segment, sym, count(*) AS cnt FROM tok GROUP BY ALL), n AS (SELECT segment, sum(cnt) AS tokens FROM u GROUP BY ALL), c AS (SELECT segment, a, b, count(*) AS cnt FROM bi GROUP BY ALL), k AS (SELECT segment, sum(cnt) AS bigrams FROM c GROUP BY ALL)"
PMI = f"{BI_ORDERS}, {UNI}, pm AS (SELECT segment, a, b, c.cnt, x.cnt AS ca, y.cnt AS cb, log2(c.cnt / bigrams / (x.cnt / tokens * (y.cnt / tokens))) AS pmi FROM c JOIN n USING (segment) JOIN k USING (segment) JOIN u x ON x.segment = c.segment AND x.sym = a JOIN u y ON y.segment = c.segment AND y.sym = b WHERE c.cnt >= 2)".replace("SELECT segment, a, b, c.cnt", "SELECT c.segment, a, b, c.cnt")


@query("net_1_pmi", f"{PMI} SELECT segment, a, b, cnt, ca, cb, round(pmi, 6) + 0.0 AS pmi FROM pm")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.pmi(orders(spark, sf), SEG).select("segment", "a", "b", "cnt", "ca", "cb", "pmi"), "pmi")


@query("net_1_followers", f"{BI_ORDERS}, {UNI} SELECT * FROM (SELECT c.segment, a, b, c.cnt, u.cnt AS ca, round(c.cnt / u.cnt, 6) AS p, row_number() OVER (PARTITION BY c.segment, a ORDER BY c.cnt DESC, b) AS i FROM c JOIN u ON c.segment = u.segment AND a = sym) WHERE i <= 10".replace("SELECT * FROM", "SELECT * EXCLUDE (i) FROM"))
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.followers(orders(spark, sf), SEG), "p")


@query("net_2_pmi_over_tokens", f"{PMI} SELECT segment, a, b, cnt, round(log2(cnt / tokens / (ca / tokens * (cb / tokens))), 6) + 0.0 AS pmi FROM pm JOIN n USING (segment) WHERE cnt >= 3")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.pmi(orders(spark, sf), SEG, 3, "tokens").select("segment", "a", "b", "cnt", "pmi"), "pmi")


@query("net_3_trigram_surplus", f"""WITH {LINES}, {tok('lines')}, t3 AS (SELECT x.sym AS a, y.sym AS b, z.sym AS c, count(*) AS c3 FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 JOIN tok z ON z.seq_id = x.seq_id AND z.pos = x.pos + 2 GROUP BY ALL),
t2 AS (SELECT x.sym AS a, y.sym AS b, count(*) AS c2 FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 GROUP BY ALL), t1 AS (SELECT sym AS c, count(*) AS c1 FROM tok GROUP BY ALL)
SELECT a, b, c, c3, c2, c1, round(ln(c3 / (SELECT sum(c3) FROM t3) / (c2 / (SELECT sum(c2) FROM t2) * (c1 / (SELECT sum(c1) FROM t1)))), 6) + 0.0 AS surplus FROM t3 JOIN t2 USING (a, b) JOIN t1 USING (c) WHERE c3 >= 3""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.trigram_surplus(lines(spark, sf), []).select("a", "b", "c", "c3", "c2", "c1", "surplus"), "surplus")


@query("net_5_centrality", f"{PMI}, d AS (SELECT segment, a AS sym, b AS nb, cnt, pmi FROM pm UNION ALL SELECT segment, b, a, cnt, pmi FROM pm) SELECT segment, sym, round(sum(abs(pmi) * cnt), 5) AS centrality, count(DISTINCT nb) AS partners, round(sum(pmi * cnt), 5) + 0.0 AS weighted FROM d GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.centrality(a.pmi(orders(spark, sf), SEG), SEG).select("segment", "sym", F.round("centrality", 5).alias("centrality"), "partners", (F.round("weighted", 5) + 0.0).alias("weighted"))


EDGES = f"{TOK_ORDERS}, w AS (SELECT x.segment, least(x.sym, y.sym) AS a, greatest(x.sym, y.sym) AS b, count(*) AS weight FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos - x.pos BETWEEN 1 AND 2 GROUP BY ALL)"


@query("net_7_windowed_edges", f"{EDGES} SELECT * FROM w")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.windowed_edges(orders(spark, sf), SEG, 2, own=True)


@query("net_7_degrees", f"{EDGES}, d AS (SELECT segment, a AS sym, weight FROM w UNION ALL SELECT segment, b, weight FROM w WHERE a <> b) SELECT segment, sym, count(*) AS degree, sum(weight)::BIGINT AS strength FROM d GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.degrees(a.windowed_edges(orders(spark, sf), SEG, 2, own=True), SEG)


@query("net_8_bidirectional", f"{BI_ORDERS} SELECT segment, least(a, b) AS x, greatest(a, b) AS y, count(*) FILTER (a < b) AS forth, count(*) FILTER (a > b) AS back FROM bi WHERE a <> b GROUP BY ALL HAVING count(*) FILTER (a < b) > 0 AND count(*) FILTER (a > b) > 0")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.bidirectional(orders(spark, sf), SEG)


@query("net_9_directed_edges", f"WITH {LINES}, {tok('lines', 'lang')}, u AS (SELECT sym FROM tok GROUP BY sym HAVING count(*) >= 5) SELECT x.sym AS a, y.sym AS b, count(*) AS weight FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 WHERE x.sym IN (FROM u) AND y.sym IN (FROM u) GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.directed_edges(lines(spark, sf), [], 5)


@query("net_10_neighbour_jaccard", f"""{BI_ORDERS}, o AS (SELECT DISTINCT nation, a, b FROM (SELECT nation, a, b FROM bi UNION ALL SELECT nation, b, a FROM bi) WHERE a <> b), d AS (SELECT nation, a, count(*) AS deg FROM o GROUP BY ALL),
s AS (SELECT p.nation, p.a AS x, q.a AS y, count(*) AS shared FROM o p JOIN o q ON p.nation = q.nation AND p.b = q.b AND p.a < q.a GROUP BY ALL)
SELECT s.nation, x, y, shared, f.deg AS dx, g.deg AS dy, round(shared / (f.deg + g.deg - shared), 6) AS jaccard FROM s JOIN d f ON f.nation = s.nation AND f.a = x JOIN d g ON g.nation = s.nation AND g.a = y WHERE shared / (f.deg + g.deg - shared) >= 0.25""")
def _(spark, sf):  # noqa: ANN001, ANN202
    by = ["nation"]
    return _rounded(a.neighbour_jaccard(a.windowed_edges(orders(spark, sf), by, 1, own=False), by), "jaccard")


@query("net_11_paradigms", f"""WITH {ORDERS}, s AS (SELECT symbols, unnest(range(1, len(symbols) + 1)) AS slot FROM orders_seq WHERE len(symbols) >= 2),
x AS (SELECT slot, len(symbols) AS len, array_to_string(list_concat(list_concat(symbols[1 : slot - 1], ['_']), symbols[slot + 1 :]), ' ') AS stem, symbols[slot] AS variant FROM s)
SELECT len::BIGINT AS len, slot, stem, count(*) AS rows, count(DISTINCT variant) AS variants FROM x GROUP BY ALL HAVING count(DISTINCT variant) >= 2""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.paradigms(orders(spark, sf), []))


@query("net_12_formulae", f"""WITH {ORDERS}, {grams('orders_seq', 'nation', most=4)}, g AS (SELECT n, gram, nation, count(*) AS here FROM grams GROUP BY ALL),
w AS (SELECT *, sum(here) OVER (PARTITION BY n, gram)::BIGINT AS cnt, count(*) OVER (PARTITION BY n, gram) AS sites, row_number() OVER (PARTITION BY n, gram ORDER BY here DESC, nation) AS r FROM g)
SELECT n, gram, cnt, sites, string_agg(nation || ':' || here, ',' ORDER BY r) FILTER (r <= 5) AS top_sites, CASE WHEN cnt >= 20 AND sites >= 3 THEN 'HIGH' WHEN cnt >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM w WHERE cnt >= 3 GROUP BY n, gram, cnt, sites""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.formulae(orders(spark, sf), "nation", 2, 4))


@query("net_14_concordance", f"""WITH {LINES}, s AS (SELECT seq_id, symbols, unnest(range(1, len(symbols) + 1)) AS i FROM lines WHERE list_contains(symbols, 'with'))
SELECT seq_id, i - 1 AS pos, array_to_string(symbols[greatest(i - 5, 1) : i - 1], ' ') AS "left", array_to_string(symbols[i + 1 : i + 5], ' ') AS "right" FROM s WHERE symbols[i] = 'with'""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.concordance(lines(spark, sf), "with")


VEC = f"{BI_ORDERS}, f AS (SELECT segment, a AS sym, 'R:' || b AS feature FROM bi UNION ALL SELECT segment, b, 'L:' || a FROM bi), v AS (SELECT segment, sym, feature, count(*) AS w FROM f GROUP BY ALL)"
COS = f"{VEC}, nn AS (SELECT segment, sym, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL), dd AS (SELECT x.segment, x.sym AS x, y.sym AS y, sum(x.w * y.w)::BIGINT AS dot FROM v x JOIN v y ON x.segment = y.segment AND x.feature = y.feature AND x.sym < y.sym GROUP BY ALL), cs AS (SELECT dd.segment, x, y, dot, dot / (p.norm * q.norm) AS cosine FROM dd JOIN nn p ON p.segment = dd.segment AND p.sym = x JOIN nn q ON q.segment = dd.segment AND q.sym = y)"


@query("net_15_cosine_pairs", f"{COS} SELECT segment, x, y, dot, round(cosine, 6) AS cosine FROM cs WHERE cosine > 0.1")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.cosine_pairs(a.context_vectors(orders(spark, sf), SEG), SEG).select("segment", "x", "y", "dot", "cosine"), "cosine")


PLACES = f"{VEC.removesuffix(', v AS (SELECT segment, sym, feature, count(*) AS w FROM f GROUP BY ALL)')}, ln AS (SELECT seq_id, len(symbols) AS n FROM orders_seq), pl AS (SELECT segment, sym, unnest(list_filter([CASE WHEN pos = 0 THEN 'P:initial' END, CASE WHEN pos = n - 1 THEN 'P:terminal' END, CASE WHEN pos > 0 AND pos < n - 1 THEN 'P:medial' END], lambda x: x IS NOT NULL)) AS feature FROM tok JOIN ln USING (seq_id)), v AS (SELECT segment, sym, feature, count(*) AS w FROM (SELECT segment, sym, feature FROM f UNION ALL SELECT segment, sym, feature FROM pl) WHERE (segment, sym) IN (SELECT (segment, sym) FROM tok GROUP BY segment, sym HAVING count(*) >= 3) GROUP BY ALL)"


@query("net_15_pairs_with_places", f"{COS.replace(VEC, PLACES)} SELECT segment, x, y, dot, round(cosine, 6) AS cosine FROM cs WHERE cosine > 0.1")
def _(spark, sf):  # noqa: ANN001, ANN202
    v = a.context_vectors(orders(spark, sf), SEG, min_freq=3, places=True)
    return _rounded(a.cosine_pairs(v, SEG).select("segment", "x", "y", "dot", "cosine"), "cosine")


@query("net_16_threshold_clusters", f"""WITH RECURSIVE {VEC.removeprefix('WITH ')}, va AS (SELECT sym, feature, sum(w) AS w FROM v GROUP BY ALL), na AS (SELECT sym, sqrt(sum(w * w)) AS norm FROM va GROUP BY ALL), ca AS (SELECT x.sym AS x, y.sym AS y, sum(x.w * y.w) / (any_value(p.norm) * any_value(q.norm)) AS cosine FROM va x JOIN va y ON x.feature = y.feature AND x.sym < y.sym JOIN na p ON p.sym = x.sym JOIN na q ON q.sym = y.sym GROUP BY x.sym, y.sym), ed AS (SELECT x, y FROM ca WHERE cosine > 0.85), eb AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed), nd AS (SELECT DISTINCT sym FROM tok),
reach(x, y) AS (SELECT sym, sym FROM nd UNION SELECT r.x, eb.y FROM reach r JOIN eb ON r.y = eb.x) SELECT x AS sym, min(y) AS cluster FROM reach GROUP BY x""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    pairs = a.cosine_pairs(a.context_vectors(x, []), [], 0.85)
    return a.components(pairs.select("x", "y"), m.symbol_counts(x).select("sym"))


@query("net_16_clusters_by_segment", f"""WITH RECURSIVE {COS.removeprefix('WITH ')}, ed AS (SELECT segment, x, y FROM cs WHERE cosine > 0.85), eb AS (SELECT segment, x, y FROM ed UNION SELECT segment, y, x FROM ed), nd AS (SELECT DISTINCT segment, sym FROM tok),
reach(segment, x, y) AS (SELECT segment, sym, sym FROM nd UNION SELECT r.segment, r.x, eb.y FROM reach r JOIN eb ON r.segment = eb.segment AND r.y = eb.x) SELECT segment, x AS sym, min(y) AS cluster FROM reach GROUP BY segment, x""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x, node = orders(spark, sf), lambda end: F.struct("segment", F.col(end).alias("sym"))
    pairs = a.cosine_pairs(a.context_vectors(x, SEG), SEG, 0.85)
    found = a.components(pairs.select(node("x").alias("x"), node("y").alias("y")), m.symbol_counts(x, SEG).select(node("sym").alias("sym")))
    return found.select("sym.segment", "sym.sym", F.col("cluster.sym").alias("cluster"))


@query("net_22_label_propagation")
def _(spark, sf):  # noqa: ANN001, ANN202
    return a.label_propagation(a.windowed_edges(orders(spark, sf), [], 2, own=False))


@query("net_23_dominant_slot", f"{BI_ORDERS}, ee AS (SELECT nation, a, b, count(*) AS weight FROM bi GROUP BY ALL), x AS (SELECT nation, a AS sym, weight AS o, 0 AS i FROM ee UNION ALL SELECT nation, b, 0, weight FROM ee), g AS (SELECT nation, sym, sum(o)::BIGINT AS out_w, sum(i)::BIGINT AS in_w FROM x GROUP BY ALL) SELECT *, round(out_w / (out_w + in_w), 6) AS share, CASE WHEN out_w / (out_w + in_w) > 0.65 THEN 'INITIAL' WHEN out_w / (out_w + in_w) < 0.35 THEN 'TERMINAL' ELSE 'MEDIAL' END AS slot FROM g")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = a.bigrams(orders(spark, sf).select("nation", "symbols")).groupBy("nation", "a", "b").agg(F.count("*").alias("weight"))
    return _rounded(a.dominant_slot(x, ["nation"]), "share")


@query("net_24_betweenness")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = a.bigrams(orders(spark, sf).select("symbols")).select("a", "b").distinct()
    return _rounded(a.betweenness(x), "betweenness")


@query("net_25_features", f"""{BI_ORDERS}, q AS (SELECT segment, sym, count(*) AS n FROM tok GROUP BY ALL), ee AS (SELECT segment, a, b, count(*) AS w FROM bi GROUP BY ALL),
o AS (SELECT segment, a AS sym, count(*) AS d, log2(sum(w)) - sum(w * log2(w)) / sum(w) AS h, sum(w)::BIGINT AS s FROM ee GROUP BY ALL), i AS (SELECT segment, b AS sym, count(*) AS d, log2(sum(w)) - sum(w * log2(w)) / sum(w) AS h, sum(w)::BIGINT AS s FROM ee GROUP BY ALL)
SELECT segment, sym, n, coalesce(o.d, 0) AS out_degree, round(coalesce(o.h, 0), 6) + 0.0 AS out_entropy, coalesce(o.s, 0) AS out_strength, coalesce(i.d, 0) AS in_degree, round(coalesce(i.h, 0), 6) + 0.0 AS in_entropy, coalesce(i.s, 0) AS in_strength, round(ln(n + 1), 6) AS log_freq FROM q LEFT JOIN o USING (segment, sym) LEFT JOIN i USING (segment, sym)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.features(orders(spark, sf), SEG).select("segment", "sym", "n", "out_degree", "out_entropy", "out_strength", "in_degree", "in_entropy", "in_strength", "log_freq"), "out_entropy", "in_entropy", "log_freq")


@query("net_27_spectral_gap")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(a.spectral_gap(orders(spark, sf), SEG), "first", "second", "gap")


@query("fil_1_length", f"WITH {ORDERS} SELECT seq_id, len(symbols)::BIGINT AS n FROM orders_seq WHERE len(symbols) BETWEEN 3 AND 5")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.by_length(orders(spark, sf), 3, 5).select("seq_id", F.size("symbols").cast("long").alias("n"))


@query("fil_2_long_tail", f"WITH {LINES} SELECT lang, count(*) AS sequences, count(*) FILTER (len(symbols) < 7) AS dropped_short, count(*) FILTER (len(symbols) > 40) AS dropped_long, coalesce(sum(len(symbols)) FILTER (len(symbols) BETWEEN 7 AND 40), 0)::BIGINT AS tokens_kept, round(count(*) FILTER (len(symbols) BETWEEN 7 AND 40) / count(*), 6) AS share_kept FROM lines GROUP BY lang")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(t.length_report(lines(spark, sf), ["lang"], 7, 40), "share_kept")


@query("fil_3_token_filter", f"""{TOK_LINES}, c AS (SELECT sym FROM tok GROUP BY sym HAVING count(*) >= 5) SELECT seq_id, string_agg(sym, ' ' ORDER BY pos) AS symbols FROM tok WHERE sym IN (FROM c) AND sym NOT IN ('the', 'of') AND unicode(sym) BETWEEN 97 AND 122 GROUP BY seq_id""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.filter_tokens(lines(spark, sf).select("seq_id", "symbols"), ["the", "of"], [(97, 122)], 5).select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_1_oriented", f"WITH {ORDERS} SELECT seq_id, array_to_string(CASE WHEN segment = 'BUILDING' THEN list_reverse(symbols) ELSE symbols END, ' ') AS symbols FROM orders_seq")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf).withColumn("direction", F.when(F.col("segment") == "BUILDING", "rtl").otherwise("ltr"))
    return t.oriented(x, "direction").select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_2_direction", f"""WITH {LINES}, f AS (SELECT lang, symbols[1] AS s, count(*) AS cnt FROM lines GROUP BY ALL), l AS (SELECT lang, symbols[-1] AS s, count(*) AS cnt FROM lines GROUP BY ALL),
g AS (SELECT x.lang, n, hf, hl FROM (SELECT lang, sum(cnt)::BIGINT AS n, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS hf FROM f GROUP BY lang) x JOIN (SELECT lang, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS hl FROM l GROUP BY lang) y ON x.lang = y.lang)
SELECT lang, n, round(hf, 6) AS h_first, round(hl, 6) AS h_last, CASE WHEN n < 5 OR abs(hf - hl) < 0.05 THEN 'unknown' WHEN hl < hf THEN 'ltr' ELSE 'rtl' END AS direction, CASE WHEN n < 5 OR abs(hf - hl) < 0.05 THEN 'low' WHEN abs(hf - hl) < 0.3 THEN 'medium' ELSE 'high' END AS confidence FROM g""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(t.direction(lines(spark, sf), ["lang"]), "h_first", "h_last")


@query("trn_2_gini", f"{TOK_LINES}, c AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL), r AS (SELECT lang, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt) AS i, count(*) OVER (PARTITION BY lang) AS n FROM c) SELECT lang, round(2 * sum(i * cnt) / (any_value(n) * sum(cnt)) - (any_value(n) + 1) / any_value(n), 6) AS gini FROM r GROUP BY lang")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(t.gini(m.symbol_counts(lines(spark, sf), ["lang"]), ["lang"]), "gini")


@query("trn_3_split", f"WITH {ORDERS}, r AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) AS i, count(*) OVER () AS n FROM orders_seq) SELECT seq_id, CASE WHEN i <= greatest(1, floor(n * 0.75)) THEN 'train' ELSE 'test' END AS part FROM r")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.split_contiguous(orders(spark, sf).select("seq_id"))


@query("trn_4_folds", f"WITH {ORDERS} SELECT seq_id, floor(('0x' || substr(md5('7|' || seq_id), 1, 8))::BIGINT * 10 / 4294967296.0)::BIGINT AS fold FROM orders_seq")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(t.folds(orders(spark, sf).select("seq_id")))


@query("trn_5_length_bins", f"WITH {ORDERS} SELECT CASE WHEN len(symbols) BETWEEN 1 AND 2 THEN 'L1-2' WHEN len(symbols) BETWEEN 3 AND 5 THEN 'L3-5' ELSE 'L6+' END AS stratum, count(*) AS n FROM orders_seq GROUP BY 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.length_bin(orders(spark, sf), [(1, 2), (3, 5), (6, None)]).groupBy("stratum").agg(F.count("*").alias("n"))


@query("trn_7_site_strata", f"WITH {ORDERS}, c AS (SELECT nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, nation) AS r FROM orders_seq GROUP BY nation) SELECT CASE WHEN n >= 30 AND r <= 10 THEN nation ELSE 'Other' END AS stratum, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.site_strata(orders(spark, sf), "nation", 30, 10).groupBy("stratum").agg(F.count("*").alias("n"))


@query("trn_8_text_bucket", "SELECT CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'Unknown' WHEN contains(lower(p_name), 'small') OR contains(lower(p_name), 'tiny') THEN 'small' WHEN contains(lower(p_name), 'large') THEN 'large' ELSE 'Other' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.text_bucket(table(spark, sf, "part"), "p_name", [("small", ["small", "tiny"]), ("large", ["large"])]).groupBy("bucket").agg(F.count("*").alias("n"))


@query("trn_9_collapse_runs", f"""WITH {EVENTS}, {tok('events_seq')}, x AS (SELECT *, CASE WHEN lag(sym) OVER (PARTITION BY seq_id ORDER BY pos) = sym THEN 0 ELSE 1 END AS new FROM tok), y AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM x),
r AS (SELECT seq_id, run, sym, count(*) AS k FROM y GROUP BY ALL) SELECT seq_id, string_agg(sym, ' ' ORDER BY run) AS collapsed, string_agg(k::VARCHAR, ' ' ORDER BY run) AS run_lengths FROM r GROUP BY seq_id""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.collapse_runs(events(spark, sf)).select("seq_id", F.array_join("collapsed", " ").alias("collapsed"), F.array_join(F.col("run_lengths").cast("array<string>"), " ").alias("run_lengths"))


@query("trn_13_bijection", f"{TOK_ORDERS}, v AS (SELECT sym, printf('C%04d', row_number() OVER (ORDER BY md5('s1|' || sym))) AS t FROM (SELECT DISTINCT sym FROM tok)) SELECT seq_id, string_agg(t, ' ' ORDER BY pos) AS symbols FROM tok JOIN v USING (sym) GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return t.recode(x, t.bijection(x, "s1")).select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_14_shuffle_within", f"WITH {ORDERS}, {tok('orders_seq')} SELECT seq_id, rep, string_agg(sym, ' ' ORDER BY md5('s1|' || rep || '|' || seq_id || '|' || pos), sym) AS symbols FROM tok, range(1, 3) r(rep) GROUP BY seq_id, rep")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.shuffle_within(orders(spark, sf), "s1", 2).select("seq_id", F.col("rep").cast("long").alias("rep"), F.array_join("symbols", " ").alias("symbols"))


@query("trn_15_relabel", f"{TOK_ORDERS}, v AS (SELECT list(DISTINCT sym ORDER BY sym) AS v FROM tok) SELECT seq_id, string_agg(v[1 + (('0x' || substr(md5('s1|' || seq_id || '|' || pos), 1, 8))::BIGINT % len(v))], ' ' ORDER BY pos) AS symbols FROM tok, v GROUP BY seq_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.relabel(orders(spark, sf), "s1").select("seq_id", F.array_join("symbols", " ").alias("symbols"))


@query("trn_17_noise", f"""{TOK_ORDERS}, v AS (SELECT list(DISTINCT sym ORDER BY sym) AS v FROM tok), h AS (SELECT *, ('0x' || substr(md5('s1|' || seq_id || '|' || pos), 1, 8))::BIGINT AS h1, ('0x' || substr(md5('s1|' || seq_id || '|' || pos), 9, 8))::BIGINT AS h2 FROM tok)
SELECT seq_id, string_agg(CASE WHEN h1 / 4294967296.0 < 0.2 THEN v[1 + (list_position(v, sym) + h2 % (len(v) - 1)) % len(v)] ELSE sym END, ' ' ORDER BY pos) AS symbols FROM h, v GROUP BY seq_id""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return t.noise(orders(spark, sf), "s1", 0.2).select("seq_id", F.array_join("symbols", " ").alias("symbols"))


URL_SQL = """SELECT page_id, head || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'mc_cid', 'mc_eid'], lower(string_split(p, '=')[1])))), '&') AS kept
FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))"""


@query("evd_1_canonical_url", URL_SQL)
def _(spark, sf):  # noqa: ANN001, ANN202
    return table(spark, sf, "pages").select("page_id", e.canonical_url(F.col("url")).alias("url"))


@query("evd_2_upsert", "WITH s AS (SELECT sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS item_id, lang AS title, source AS topic, doc_id AS f, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS o FROM documents) SELECT item_id, arg_min(title, (o, f, title)) AS title, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, max(f) AS fetched_at FROM s GROUP BY item_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Items by their whole texts, case and punctuation aside."""
    d = table(spark, sf, "documents")
    x = d.select(F.sha2(e.normal_title(F.col("text")), 256).alias("item_id"), F.col("lang").alias("title"), F.array("source").alias("topics"), F.col("doc_id").alias("fetched_at"), (F.col("doc_id") % 2).alias("part"))
    return e.upsert(x.where("part = 0").drop("part"), x.where("part <> 0").drop("part")).withColumn("topics", F.array_join("topics", ","))


@query("evd_2_upsert_whole_text", "WITH s AS (SELECT sha256(text) AS item_id, lang AS title, source AS topic, doc_id AS f, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS o FROM documents) SELECT item_id, arg_min(title, (o, f, title)) AS title, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, max(f) AS fetched_at FROM s GROUP BY item_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents")
    x = d.select(F.sha2("text", 256).alias("item_id"), F.col("lang").alias("title"), F.array("source").alias("topics"), F.col("doc_id").alias("fetched_at"), (F.col("doc_id") % 2).alias("part"))
    return e.upsert(x.where("part = 0").drop("part"), x.where("part <> 0").drop("part")).withColumn("topics", F.array_join("topics", ","))


@query("evd_4_tally", "SELECT 'lang' AS dim, coalesce(lang, '(unknown)') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, '(unknown)'), count(*) FROM documents GROUP BY 2")
def _(spark, sf):  # noqa: ANN001, ANN202
    return e.tally(table(spark, sf, "documents"), ["lang", "source"])


@query("evd_8_topics", "SELECT doc_id, topic FROM (SELECT doc_id, unnest(list_filter([CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secrets' END, CASE WHEN contains(lower(text), 'license') AND NOT contains(lower(text), '|') THEN 'legal' END], lambda x: x IS NOT NULL)) AS topic FROM documents)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return e.topic_matches(table(spark, sf, "documents"), [("secrets", ["password", "token"], []), ("legal", ["license"], ["|"])], "text").select("doc_id", "topic")


@query("evd_9_first_per_key", "WITH k AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ''), nullif(lang, ''), nullif(source, '')) AS key FROM documents), b AS (SELECT trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM benchmark WHERE text IS NOT NULL) SELECT key, min(doc_id) AS doc_id FROM k WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM b) GROUP BY key")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Items by the first of three keys that isn't empty, the whole normalised text being the first of them."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    known = table(spark, sf, "benchmark").select(e.normal_title(F.col("text")).alias("key"))
    return e.first_per_key(d, [e.normal_title(F.col("text")), F.col("lang"), F.col("source")], ["doc_id"], known).select("key", "doc_id")


@query("evd_9_first_per_whole_text", "WITH k AS (SELECT doc_id, coalesce(sha256(nullif(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), '')), nullif(source, '')) AS key FROM documents), b AS (SELECT sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS key FROM benchmark WHERE text IS NOT NULL) SELECT key, min(doc_id) AS doc_id FROM k WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM b) GROUP BY key")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.nullif(e.normal_title(F.col("text")), F.lit("")), 256).alias("title"), "source")
    known = table(spark, sf, "benchmark").select(F.sha2(e.normal_title(F.col("text")), 256).alias("key"))
    return e.first_per_key(d, [F.col("title"), F.col("source")], ["doc_id"], known).select("key", "doc_id")


@query("evd_10_intake", "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS sha256, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_id FROM documents) SELECT doc_id, sha256, doc_id > first_id AS duplicate, first_id, regexp_extract(t, '(10\\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+)', 1) AS doi, regexp_extract(t, '\\b((?:19|20)[0-9]{2})\\b', 1) AS year FROM d")
def _(spark, sf):  # noqa: ANN001, ANN202
    return e.intake(table(spark, sf, "documents")).drop("slug")


@query("evd_11_claims", "SELECT doc_id, rule, k, quote, confidence FROM (SELECT doc_id, rule, unnest(q) AS quote, generate_subscripts(q, 1) AS k, confidence FROM (SELECT doc_id, 'mail' AS rule, regexp_extract_all(text, '[a-z0-9]+@[a-z0-9.]+[a-z]')[1:3] AS q, 0.9::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 'number', regexp_extract_all(text, '[0-9]{6,}')[1:3], 0.5::DOUBLE FROM documents))")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(e.extract(table(spark, sf, "documents"), [("mail", "[a-z0-9]+@[a-z0-9.]+[a-z]", 0.9), ("number", "[0-9]{6,}", 0.5)]))


@query("evd_12_links", "SELECT doc_id, scheme, label FROM (SELECT doc_id, 'mail' AS scheme, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+@[a-z0-9.]+[a-z]'))) AS label FROM documents UNION ALL SELECT doc_id, 'ip', unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'))) FROM documents)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return e.links(table(spark, sf, "documents"), [("mail", "[a-z0-9]+@[a-z0-9.]+[a-z]"), ("ip", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}")])


@query("evd_18_chunks", "SELECT * FROM (SELECT doc_id, start, regexp_replace(substr(text, start + 1, 600), '^[ \n\t]+|[ \n\t]+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS start FROM documents)) WHERE chunk <> ''")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(e.chunks(table(spark, sf, "documents").select("doc_id", "text")))


IDX = """WITH p AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS term FROM documents) GROUP BY ALL), tf AS (SELECT *, c / sum(c) OVER (PARTITION BY doc_id) AS tf FROM p), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents), ix AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w, df FROM tf JOIN df USING (term), nd)"""


@query("evd_19_tfidf", f"{IDX} SELECT doc_id, count(*) AS terms, round(sum(w), 6) AS weight, round(max(w), 6) AS top FROM ix GROUP BY doc_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents")
    x, _ = e.tfidf(d, ["doc_id"], "text", d.count())
    return x.groupBy("doc_id").agg(F.count("*").alias("terms"), r6(F.sum("w")).alias("weight"), r6(F.max("w")).alias("top"))


@query("evd_20_search", f"""{IDX}, q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM benchmark) GROUP BY ALL), qt AS (SELECT *, c / sum(c) OVER (PARTITION BY item_id) AS tf FROM q), qw AS (SELECT item_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM qt JOIN df USING (term), nd),
s AS (SELECT item_id, doc_id, sum(ix.w * qw.w) AS dot FROM ix JOIN qw USING (term) GROUP BY ALL), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM ix GROUP BY ALL), qn AS (SELECT item_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY ALL),
r AS (SELECT item_id, doc_id, dot / (dn * qn) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(dot / (dn * qn), 9) DESC, doc_id) AS rank FROM s JOIN dn USING (doc_id) JOIN qn USING (item_id) WHERE dot / (dn * qn) >= 0.05)
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents")
    index, terms = e.tfidf(d, ["doc_id"], "text", d.count())
    q = e.postings(table(spark, sf, "benchmark"), ["item_id"], "text").join(terms, "term").select("item_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return _rounded(e.search(index, written(q, "queries")), "score")


@query("evd_22_gates", "SELECT 'rows' AS \"check\", CASE WHEN count(*) >= 10 THEN 'PASS' ELSE 'FAIL' END AS status, count(*)::VARCHAR AS detail FROM documents UNION ALL SELECT 'unique ids', CASE WHEN count(*) = count(DISTINCT doc_id) THEN 'PASS' ELSE 'FAIL' END, count(DISTINCT doc_id)::VARCHAR FROM documents UNION ALL SELECT 'lengths', CASE WHEN count(*) FILTER (length(text) <> n_chars) = 0 THEN 'PASS' ELSE 'FAIL' END, (count(*) FILTER (length(text) <> n_chars))::VARCHAR FROM documents")
def _(spark, sf):  # noqa: ANN001, ANN202
    n, ids, bad = F.count("*"), F.count_distinct("doc_id"), F.sum(F.when(F.length("text") != F.col("n_chars"), 1).otherwise(0))
    return e.gates(table(spark, sf, "documents"), [("rows", n >= 10, n), ("unique ids", n == ids, ids), ("lengths", bad == 0, bad)])
