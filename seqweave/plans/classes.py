"""Queries over class templates, affinities, allographs and tallies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions.tables import written
from seqweave.operators import assoc as a
from seqweave.operators import evidence as e
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators import strata as st
from seqweave.operators import zones as z
from seqweave.plans.counting import BI_ORDERS, POS3, TOK_LINES, TOK_ORDERS, _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import LINES, ORDERS, grams, lines, orders, table
from seqweave.sources.corpora import union

CLASSED = f"{POS3.replace(TOK_ORDERS, TOK_LINES).replace('nation, sym', 'sym')}, cl AS (SELECT t.seq_id, list(class ORDER BY pos) AS symbols FROM tok t JOIN q USING (sym) WHERE class <> 'MIXED' GROUP BY t.seq_id), {grams('cl', most=5)}"


@query("net_13_class_templates", f"{CLASSED} SELECT n, gram, count(*) AS cnt FROM grams GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Recurrent templates of two to five classes; symbols without a class of their own are left out before."""
    x = written(lines(spark, sf).select("seq_id", "symbols"), "lines")
    kinds = p.rates(x, []).where("class <> 'MIXED'").select("sym", "class")
    t = p.tokens(x).select("seq_id", "pos", "sym").join(kinds, "sym").groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "class"))).alias("x")).select("seq_id", F.col("x.class").alias("symbols"))
    return _rounded(m.ngram_counts(t, 2, 5).where("cnt >= 3"))


AFFINE = f"{BI_ORDERS}, b2 AS (SELECT x.sym AS a, y.sym AS b FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos IN (x.pos + 1, x.pos + 2)), f AS (SELECT a AS sym, 'R:' || b AS feature FROM b2 UNION ALL SELECT b, 'L:' || a FROM b2), v AS (SELECT sym, feature, count(*) AS w FROM f GROUP BY ALL), nn AS (SELECT sym, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL), cs AS (SELECT x.sym AS x, y.sym AS y, sum(x.w * y.w) / (any_value(p.norm) * any_value(q.norm)) AS cosine FROM v x JOIN v y ON x.feature = y.feature AND x.sym < y.sym JOIN nn p ON p.sym = x.sym JOIN nn q ON q.sym = y.sym GROUP BY x.sym, y.sym)"


@query("net_19_affinity", f"{AFFINE} SELECT x, y, round(cosine, 6) AS cosine FROM cs WHERE cosine > 0.1 ORDER BY round(cosine, 9) DESC, x, y LIMIT 50")
def _(spark, sf):  # noqa: ANN001, ANN202
    """The fifty pairs of symbols whose contexts within two places are most alike."""
    c = a.cosine_pairs(a.context_vectors(orders(spark, sf), [], 2), []).select("x", "y", "cosine")
    return _rounded(c.orderBy(F.desc(F.round("cosine", 9)), "x", "y").limit(50), "cosine")


ALLOGRAPHS = f"""{BI_ORDERS}, v AS (SELECT a AS sym, b AS feature, count(*) AS w FROM bi GROUP BY ALL), nn AS (SELECT sym, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL), cs AS (SELECT x.sym AS x, y.sym AS y, sum(x.w * y.w) / (any_value(p.norm) * any_value(q.norm)) AS cosine FROM v x JOIN v y ON x.feature = y.feature AND x.sym < y.sym JOIN nn p ON p.sym = x.sym JOIN nn q ON q.sym = y.sym GROUP BY x.sym, y.sym),
r AS (SELECT sym, count(*) AS n, count(*) FILTER (pos = 0) / count(*) AS s, count(*) FILTER (pos = len - 1 AND pos > 0) / count(*) AS e, count(*) FILTER (pos > 0 AND pos < len - 1) / count(*) AS i FROM tok GROUP BY sym), h AS (SELECT DISTINCT seq_id, sym FROM tok), sz AS (SELECT sym, count(*) AS k FROM h GROUP BY sym), bo AS (SELECT x.sym AS x, y.sym AS y, count(*) AS "both" FROM h x JOIN h y ON x.seq_id = y.seq_id AND x.sym < y.sym GROUP BY ALL),
al AS (SELECT cs.x, cs.y, cosine, abs(a.s - b.s) + abs(a.e - b.e) + abs(a.i - b.i) AS shift, coalesce("both", 0) AS "both", a.n AS nx, b.n AS ny, c.k AS kx, d.k AS ky FROM cs JOIN r a ON a.sym = cs.x JOIN r b ON b.sym = cs.y JOIN sz c ON c.sym = cs.x JOIN sz d ON d.sym = cs.y LEFT JOIN bo ON bo.x = cs.x AND bo.y = cs.y WHERE cosine > 0.55),
ag AS (SELECT x, y, round(cosine, 6) AS cosine, round(shift, 6) AS shift, "both", round(0.4 * (1 - shift / 2) + 0.4 * (1 - "both" / least(kx, ky)) + 0.2 * least(nx, ny) / greatest(nx, ny), 6) AS score FROM al WHERE shift <= 0.5)"""


@query("net_20_allographs", f"{ALLOGRAPHS} SELECT * FROM ag")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(z.allographs(orders(spark, sf)), "cosine", "shift", "score")


@query("net_20_allograph_groups", f"WITH RECURSIVE {ALLOGRAPHS.removeprefix('WITH ')}, eb AS (SELECT x, y FROM ag WHERE cosine > 0.9 UNION SELECT y, x FROM ag WHERE cosine > 0.9), reach(x, y) AS (SELECT DISTINCT sym, sym FROM tok UNION SELECT rc.x, eb.y FROM reach rc JOIN eb ON rc.y = eb.x) SELECT x AS sym, min(y) AS grp FROM reach GROUP BY x")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    pairs = z.allographs(x).select("x", "y", F.round("cosine", 6).alias("cosine")).where("cosine > 0.9")
    return z.allograph_groups(pairs, m.symbol_counts(x))


@query("net_21_allograph_score", f"{ALLOGRAPHS} SELECT x, y, score FROM ag WHERE score >= 0.5")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(z.allographs(orders(spark, sf)).select("x", "y", "score"), "score").where("score >= 0.5")


@query("cmp_21_side_by_side", f"WITH {LINES}, {ORDERS}, al AS (SELECT 'lines' AS corpus_id, symbols FROM lines UNION ALL SELECT 'orders', symbols FROM orders_seq), s AS (SELECT corpus_id, list_filter(symbols, lambda x: x <> 'the' AND x <> 'Brand#11') AS symbols FROM al), k AS (SELECT * FROM s WHERE len(symbols) > 0) SELECT corpus_id, count(*) AS sequences, round(avg(len(symbols)), 6) AS mean_len, sum(len(symbols))::BIGINT AS tokens, (SELECT count(DISTINCT u) FROM (SELECT unnest(symbols) AS u FROM k y WHERE y.corpus_id = k.corpus_id)) AS types FROM k GROUP BY corpus_id")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Two corpora beside each other, their most common symbols dropped as placeholders are."""
    both = union({"lines": lines(spark, sf).select(F.array_remove("symbols", "the").alias("symbols")), "orders": orders(spark, sf).select(F.array_remove("symbols", "Brand#11").alias("symbols"))})
    return _rounded(st.corpus_table(both, ["corpus_id"]).select("corpus_id", "sequences", "mean_len", "tokens", "types"), "mean_len")


@query("evd_7_tally_topics", "WITH d AS (SELECT lang, source, list_filter(['numbers', 'links'], lambda t: CASE WHEN t = 'numbers' THEN regexp_matches(text, '[0-9]{4}') ELSE contains(text, 'http') END) AS topics FROM documents), x AS (SELECT 'lang' AS dim, coalesce(lang, '(unknown)') AS value FROM d UNION ALL SELECT 'source', coalesce(source, '(unknown)') FROM d UNION ALL SELECT 'topics', unnest(CASE WHEN len(topics) > 0 THEN topics ELSE ['(unknown)'] END) FROM d) SELECT dim, value, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").select("lang", "source", F.array_compact(F.array(F.when(F.col("text").rlike("[0-9]{4}"), "numbers"), F.when(F.contains("text", F.lit("http")), "links"))).alias("topics"))
    return e.tally_listed(d, ["lang", "source"], "topics")


@query("trn_19_merged", f"{TOK_ORDERS}, l AS (SELECT count(*) AS sequences FROM orders_seq), t AS (SELECT count(*) AS tokens, count(DISTINCT sym) AS types FROM tok) SELECT sequences AS a_sequences, tokens AS b_tokens, types AS b_types FROM l, t")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Results of one row each beside one another, their columns under prefixes."""
    x = orders(spark, sf)
    return st.merged({"a": x.agg(F.count("*").alias("sequences")), "b": m.symbol_counts(x).agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"))})


_BINS = ", ".join(f"count(*) FILTER (bin = {i}) / count(*)" for i in range(10))
MODES = f"""{TOK_LINES}, bn AS (SELECT lang, sym, least(9, floor(CASE WHEN len = 1 THEN 0.5::DOUBLE ELSE pos / (len - 1) END * 10)) AS bin FROM tok), hs AS (SELECT lang, sym, count(*) AS n, [{_BINS}] AS h FROM bn GROUP BY ALL),
md0 AS (SELECT *, list_filter(range(0, 10), lambda i: h[i + 1] - greatest(CASE WHEN i > 0 THEN h[i] ELSE 0 END, CASE WHEN i < 9 THEN h[i + 2] ELSE 0 END) >= 0.05) AS pk FROM hs), md AS (SELECT lang, sym, n, len(pk) AS n_peaks, coalesce(list_sum(list_transform(pk, lambda i: h[i + 1])), 0) * CASE WHEN len(pk) > 1 THEN (list_max(pk) - list_min(pk)) / 9 ELSE 0 END AS score, list_sum(list_transform(h, lambda v: CASE WHEN v > 0 THEN -v * log2(v) ELSE 0 END)) / log2(10) AS entropy FROM md0)"""


@query("pos_9_multimodality", f"{MODES} SELECT lang, sym, n, n_peaks, round(score, 6) AS score, round(entropy, 6) + 0.0 AS entropy FROM md")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.multimodality(lines(spark, sf), ["lang"]), "score", "entropy")


@query("pos_14_roles", f"""{TOK_LINES}, x AS (SELECT *, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM tok), g AS (SELECT lang, sym, count(*) AS n, count(*) FILTER (pos = 0) / count(*) AS i, count(*) FILTER (pos = len - 1) / count(*) AS t, count(*) FILTER (len = 1) / count(*) AS solo, count(*) FILTER (nxt = sym) / count(*) AS rep FROM x GROUP BY ALL),
pr AS (SELECT lang, sym AS a, nxt AS b, count(*) AS cnt FROM x WHERE nxt IS NOT NULL GROUP BY ALL), tt AS (SELECT lang, count(*) AS tokens FROM tok GROUP BY lang), bb AS (SELECT lang, sum(cnt) AS bigrams FROM pr GROUP BY lang), pm AS (SELECT pr.lang, a, b FROM pr JOIN g x ON x.lang = pr.lang AND x.sym = a JOIN g y ON y.lang = pr.lang AND y.sym = b JOIN tt ON tt.lang = pr.lang JOIN bb ON bb.lang = pr.lang WHERE cnt >= 5 AND log2(cnt / bigrams / (x.n / tokens * (y.n / tokens))) >= 4),
en AS (SELECT DISTINCT lang, unnest([a, b]) AS sym FROM pm), r AS (SELECT g.*, list_filter([CASE WHEN t >= 0.5 THEN 'suffix' END, CASE WHEN i >= 0.5 THEN 'determinative' END, CASE WHEN rep >= 0.1 THEN 'numeral' END, CASE WHEN solo >= 0.3 THEN 'logogram' END, CASE WHEN en.sym IS NOT NULL THEN 'compound' END], lambda v: v IS NOT NULL) AS l FROM g LEFT JOIN en ON en.lang = g.lang AND en.sym = g.sym)
SELECT lang, sym, n, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'phonetic' END AS roles FROM r""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return st.roles(lines(spark, sf), ["lang"])


O_MODES = MODES.replace(TOK_LINES, TOK_ORDERS).replace("lang", "segment")
SUMMARY = f"""{O_MODES}, u AS (SELECT segment, sym, count(*) AS cnt FROM tok GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY cnt DESC, sym) AS rank FROM u), one AS (SELECT segment, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h1, count(*) AS types, count(*) / sum(cnt) AS ttr, count(*) FILTER (cnt = 1) / count(*) AS hapax_share, -regr_slope(ln(cnt), ln(rank)) AS alpha FROM rk GROUP BY segment),
bg AS (SELECT x.segment, x.sym AS a, y.sym AS b, count(*) AS cnt FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1 GROUP BY ALL), two AS (SELECT segment, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h2 FROM bg GROUP BY segment),
pe AS (SELECT segment, avg(entropy) AS pos_entropy, avg(CASE WHEN n_peaks >= 2 AND round(score, 9) >= 0.15 THEN 1 ELSE 0 END) AS polyvalent_share FROM md WHERE n >= 3 GROUP BY segment), bv AS (SELECT segment, var_pop(b) AS bias_var FROM (SELECT segment, sym, count(*) FILTER (len > 1 AND (pos = 0 OR pos = len - 1)) / count(*) AS b FROM tok GROUP BY ALL HAVING count(*) >= 3) GROUP BY segment), ml AS (SELECT segment, avg(len(symbols)) AS mean_len FROM orders_seq GROUP BY segment),
sx AS (SELECT segment, symbols, unnest(range(1, len(symbols) + 1)) AS slot FROM orders_seq WHERE len(symbols) >= 2), ss AS (SELECT segment, slot, array_to_string(list_concat(list_concat(symbols[1 : slot - 1], ['_']), symbols[slot + 1 :]), ' ') AS stem, symbols[slot] AS v, count(*) AS n FROM sx GROUP BY ALL), sp AS (SELECT segment, sum(n * n - nn) / 2 AS pairs FROM (SELECT segment, slot, stem, sum(n) AS n, sum(n * n) AS nn FROM ss GROUP BY ALL) GROUP BY segment), sc AS (SELECT segment, sum(n * (n - 1)) / 2 AS comparable FROM (SELECT segment, len(symbols) AS len, count(*) AS n FROM orders_seq WHERE len(symbols) >= 2 GROUP BY ALL) GROUP BY segment)"""


@query("agg_29_fingerprint", f"{SUMMARY} SELECT segment, round(h1 / log2(types), 6) AS h1_norm, round(h2 / 2 / h1, 6) AS h2_ratio, round(alpha, 6) AS alpha, round(ttr, 6) AS ttr, round(hapax_share, 6)::DOUBLE AS hapax_share, round(pos_entropy, 6) AS pos_entropy, round(polyvalent_share, 6)::DOUBLE AS polyvalent_share, round(mean_len, 6) AS mean_len, round(bias_var, 6) AS bias_var, round(pairs / greatest(comparable, 1), 6)::DOUBLE AS substitution_rate FROM one JOIN two USING (segment) JOIN pe USING (segment) JOIN bv USING (segment) JOIN ml USING (segment) JOIN sp USING (segment) JOIN sc USING (segment)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.fingerprint(orders(spark, sf), ["segment"]), "h1_norm", "h2_ratio", "alpha", "ttr", "hapax_share", "pos_entropy", "polyvalent_share", "mean_len", "bias_var", "substitution_rate")


@query("agg_32_polyvalence", f"{MODES} SELECT lang, count(*) AS symbols, count(*) FILTER (n_peaks >= 2 AND round(score, 9) >= 0.15) AS polyvalent, round(avg(CASE WHEN n_peaks >= 2 AND round(score, 9) >= 0.15 THEN 1 ELSE 0 END), 6) AS share FROM md WHERE n >= 3 GROUP BY lang")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(st.polyvalent(lines(spark, sf), ["lang"]), "share")
