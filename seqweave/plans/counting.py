"""Queries over counts, measures and positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.functions.exprs import r6
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.plans.registry import query
from seqweave.sources.adapters import EVENTS, LINES, ORDERS, ROLES, events, grams, lines, orders, roles, tok

SEG = ["segment"]
TOK_ORDERS = f"WITH {ORDERS}, {tok('orders_seq', 'segment', 'nation')}"
TOK_LINES = f"WITH {LINES}, {tok('lines', 'lang', 'source')}"
BI_ORDERS = f"{TOK_ORDERS}, bi AS (SELECT x.segment, x.nation, x.seq_id, x.sym AS a, y.sym AS b FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1)"


def _rounded(df, *cols):  # noqa: ANN001, ANN002, ANN202
    return df.select([r6(c).alias(c) if c in cols else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


@query("src_1_corpus_totals", f"WITH {LINES} SELECT count(*) AS sequences, sum(len(symbols))::BIGINT AS tokens, (SELECT count(DISTINCT s) FROM (SELECT unnest(symbols) AS s FROM lines)) AS types FROM lines")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = lines(spark, sf)
    return x.agg(F.count("*").alias("sequences"), F.sum(F.size("symbols")).alias("tokens")).join(m.symbol_counts(x).agg(F.count("*").alias("types")))


@query("src_7_register_corpus", f"WITH {ORDERS}, t AS (SELECT segment, unnest(symbols) AS s FROM orders_seq) SELECT segment, count(DISTINCT s) AS alphabet_size, string_agg(DISTINCT s, ',' ORDER BY s) AS symbol_set FROM t GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = m.symbol_counts(orders(spark, sf), SEG)
    return x.groupBy("segment").agg(F.count("*").alias("alphabet_size"), F.array_join(F.array_sort(F.collect_set("sym")), ",").alias("symbol_set"))


@query("agg_1_frequency", f"{TOK_ORDERS}, c AS (SELECT segment, sym, count(*) AS cnt FROM tok GROUP BY ALL) SELECT * FROM (SELECT segment, sym, cnt, sum(cnt) OVER (PARTITION BY segment)::BIGINT AS total_tokens FROM c) WHERE cnt >= 100")
def _(spark, sf):  # noqa: ANN001, ANN202
    return m.frequency(orders(spark, sf), SEG, 100)


@query("agg_2_rank_frequency", f"{TOK_LINES}, c AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL) SELECT lang, sym, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, sym) AS rank, sum(cnt) OVER (PARTITION BY lang)::BIGINT AS total, round(cnt / sum(cnt) OVER (PARTITION BY lang), 6) AS freq FROM c")
def _(spark, sf):  # noqa: ANN001, ANN202
    return m.rank_frequency(lines(spark, sf), ["lang"]).select("lang", "sym", "cnt", "rank", "total", r6("freq").alias("freq"))


@query("agg_3_bigram_counts", f"WITH {LINES}, {grams('lines')} SELECT n, gram, count(*) AS cnt FROM grams GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf):  # noqa: ANN001, ANN202
    return m.ngram_counts(lines(spark, sf), 2).where("cnt >= 3").withColumn("n", F.col("n").cast("long"))


@query("agg_4_stream_ngrams", f"""WITH {ORDERS}, {tok('orders_seq', 'segment')},
s AS (SELECT segment, sym, row_number() OVER (PARTITION BY segment ORDER BY seq_id, pos) AS i FROM tok),
g AS (SELECT segment, 2 AS n, sym || ' ' || lead(sym) OVER w AS gram FROM s WINDOW w AS (PARTITION BY segment ORDER BY i)
UNION ALL SELECT segment, 3, sym || ' ' || lead(sym) OVER w || ' ' || lead(sym, 2) OVER w FROM s WINDOW w AS (PARTITION BY segment ORDER BY i))
SELECT segment, n::BIGINT AS n, gram, count(*) AS cnt FROM g WHERE gram IS NOT NULL GROUP BY ALL""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return m.stream_ngram_counts(orders(spark, sf), 2, 3, SEG).withColumn("n", F.col("n").cast("long"))


@query("agg_5_by_dimension", f"""{TOK_LINES},
g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE '(all)' END AS dim,
 coalesce(CASE WHEN grouping(lang) = 0 THEN coalesce(lang, '(unknown)') END, CASE WHEN grouping(source) = 0 THEN coalesce(source, '(unknown)') END, '(all)') AS value, sym, count(*) AS cnt
 FROM tok GROUP BY GROUPING SETS ((sym), (lang, sym), (source, sym)))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim, value ORDER BY cnt DESC, sym) AS rank FROM g) WHERE rank <= 20""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return m.by_dimension(lines(spark, sf), ["lang", "source"], 20).withColumn("rank", F.col("rank").cast("long"))


H = "round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6)"
LN = "ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt)"


@query("agg_6_entropy", f"{TOK_LINES}, c AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL) SELECT lang, {H} AS h, sum(cnt)::BIGINT AS n, count(*) AS types, round((log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt)) / log2(count(*)), 6) AS h_norm FROM c GROUP BY lang")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.unigram_entropy(lines(spark, sf), ["lang"]), "h", "h_norm")


def _blocks(spark, sf, most=4):  # noqa: ANN001, ANN202
    return m.ngram_counts(orders(spark, sf), 1, most, SEG)


BLOCKS = f"WITH {ORDERS}, {grams('orders_seq', 'segment', least=1, most=4)}, c AS (SELECT segment, n, gram, count(*) AS cnt FROM grams GROUP BY ALL), e AS (SELECT segment, n, {LN} AS h, sum(cnt)::BIGINT AS total, count(*) AS types, count(*) FILTER (cnt = 1) AS f1 FROM c GROUP BY segment, n), b AS (SELECT e.*, v.types AS v, h / ln(v.types) AS h_norm FROM e JOIN (SELECT segment, types FROM e WHERE n = 1) v USING (segment))"


@query("agg_8_block_entropy_within", f"{BLOCKS} SELECT segment, n, round(h, 6) AS h, total, types, round(h_norm, 6) AS h_norm FROM b")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.block_entropy(_blocks(spark, sf), SEG).select("segment", "n", "h", "total", "types", "h_norm"), "h", "h_norm")


@query("agg_7_block_entropy_stream", f"""WITH {ORDERS}, {tok('orders_seq', 'segment')},
s AS (SELECT segment, sym, row_number() OVER (PARTITION BY segment ORDER BY seq_id, pos) AS i FROM tok),
g AS (SELECT segment, 1 AS n, sym AS gram FROM s UNION ALL SELECT segment, 2, sym || ' ' || lead(sym) OVER w FROM s WINDOW w AS (PARTITION BY segment ORDER BY i)
UNION ALL SELECT segment, 3, sym || ' ' || lead(sym) OVER w || ' ' || lead(sym, 2) OVER w FROM s WINDOW w AS (PARTITION BY segment ORDER BY i)),
c AS (SELECT segment, n, gram, count(*) AS cnt FROM g WHERE gram IS NOT NULL GROUP BY ALL)
SELECT segment, n::BIGINT AS n, round({LN}, 6) AS h, sum(cnt)::BIGINT AS total, count(*) AS types FROM c GROUP BY segment, n""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.block_entropy(m.stream_ngram_counts(orders(spark, sf), 1, 3, SEG), SEG).select("segment", "n", "h", "total", "types"), "h")


@query("agg_9_11_estimators", f"""{BLOCKS}, x AS (SELECT c.segment, c.n, greatest(1 - f1 / total, 1e-8) * cnt / total AS cp, total FROM c JOIN e USING (segment, n)),
s AS (SELECT segment, n, sum(-cp * ln(cp) / (1 - pow(1 - cp, total))) AS chao FROM x GROUP BY ALL)
SELECT segment, n, round(h, 6) AS h, round(h + (types - 1) / (2 * total), 6) AS miller_madow, round(chao, 6) AS chao_shen FROM e JOIN s USING (segment, n)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.estimators(_blocks(spark, sf), SEG).select("segment", "n", "h", "miller_madow", "chao_shen"), "h", "miller_madow", "chao_shen")


@query("agg_12_conditional_profile", f"""{BLOCKS}, d AS (SELECT segment, n, h - coalesce(lag(h) OVER (PARTITION BY segment ORDER BY n), 0) AS hc FROM b),
l AS (SELECT *, lag(hc) OVER (PARTITION BY segment ORDER BY n) AS prev, row_number() OVER (PARTITION BY segment ORDER BY n DESC) AS back FROM d)
SELECT segment, n, round(hc, 6) AS h_cond, coalesce(bool_or(back = 1 AND abs(hc - prev) <= 0.1 * abs(prev)) OVER (PARTITION BY segment), false) AS plateau FROM l""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.conditional_by_difference(m.block_entropy(_blocks(spark, sf), SEG), SEG).select("segment", "n", "h_cond", "plateau"), "h_cond")


@query("agg_13_conditional_by_rows", f"""{BI_ORDERS}, c AS (SELECT segment, a, b, count(*) AS cnt FROM bi GROUP BY ALL), h AS (SELECT segment, a, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h FROM c GROUP BY ALL),
u AS (SELECT segment, sym, count(*) AS cnt FROM tok GROUP BY ALL), w AS (SELECT *, sum(cnt) OVER (PARTITION BY segment) AS total FROM u)
SELECT segment, round(sum(cnt / total * h), 6) AS h_cond FROM h JOIN w ON h.segment = w.segment AND a = sym GROUP BY h.segment""".replace("SELECT segment, round(sum(cnt / total", "SELECT h.segment, round(sum(cnt / total"))
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.conditional_by_rows(orders(spark, sf), SEG), "h_cond")


@query("agg_14_conditional_by_joint", f"""{BI_ORDERS}, c AS (SELECT segment, a, b, count(*) AS cnt FROM bi GROUP BY ALL), f AS (SELECT segment, a, sum(cnt) AS cnt FROM c GROUP BY ALL),
j AS (SELECT segment, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS hj, sum(cnt)::BIGINT AS n FROM c GROUP BY ALL), x AS (SELECT segment, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS hf FROM f GROUP BY ALL)
SELECT segment, n, round(hj, 6) AS h_joint, round(hf, 6) AS h_first, round(greatest(0, hj - hf), 6) AS h_cond FROM j JOIN x USING (segment)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.conditional_by_joint(orders(spark, sf), SEG).select("segment", "n", "h_joint", "h_first", "h_cond"), "h_joint", "h_first", "h_cond")


SUMMARY = f"""{TOK_LINES}, c AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, sym) AS rank FROM c),
bi AS (SELECT x.lang, x.sym AS a, y.sym AS b FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos = x.pos + 1), c2 AS (SELECT lang, a, b, count(*) AS cnt FROM bi GROUP BY ALL),
h2 AS (SELECT lang, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h2 FROM c2 GROUP BY lang),
s AS (SELECT lang, sum(cnt)::BIGINT AS tokens, count(*) AS types, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS h1, count(*) FILTER (cnt = 1) AS hapax, corr(rank, log2(cnt)) AS zc FROM r GROUP BY lang)"""


@query("agg_15_corpus_summary", f"{SUMMARY} SELECT lang, tokens, types, round(h1, 6) AS h1, round(h2, 6) AS h2, round(greatest(h2 - h1, 0), 6) AS h_cond, round(h2 / h1, 6) AS h_ratio, round(types / tokens, 6) AS ttr, round(hapax / types, 6) AS hapax_share, round(zc, 6) AS zipf_corr FROM s JOIN h2 USING (lang)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.corpus_summary(lines(spark, sf), ["lang"]), "h1", "h2", "h_cond", "h_ratio", "ttr", "hapax_share", "zipf_corr")


@query("agg_16_zipf", f"{TOK_LINES}, c AS (SELECT lang, sym, count(*) AS cnt FROM tok GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, sym) AS rank FROM c) SELECT lang, count(*) AS types, round(-regr_slope(ln(cnt), ln(rank)), 6) AS alpha, round(regr_r2(ln(cnt), ln(rank)), 6) AS r2 FROM r GROUP BY lang HAVING count(*) >= 3")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.zipf(lines(spark, sf), ["lang"]), "alpha", "r2")


@query("agg_17_zipf_mandelbrot", f"""{TOK_ORDERS}, c AS (SELECT segment, sym, count(*) AS cnt FROM tok GROUP BY ALL), r AS (SELECT segment, ln(cnt) AS y, row_number() OVER (PARTITION BY segment ORDER BY cnt DESC, sym) AS rank FROM c),
g AS (SELECT a / 10 AS alpha, b::DOUBLE AS beta FROM range(1, 25) x(a), range(0, 16) z(b)),
f AS (SELECT segment, alpha, beta, var_pop(y + alpha * ln(rank + beta)) AS mse, var_pop(y) AS vy FROM r, g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(mse, 9), alpha, beta) AS i FROM f)
SELECT segment, alpha, beta, round(mse, 6) AS mse, round(1 - round(mse, 9) / vy, 6) AS r2 FROM k WHERE i = 1""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.zipf_mandelbrot(orders(spark, sf), SEG), "mse", "r2")


MI = f"""{TOK_ORDERS}, p AS (SELECT x.segment, y.pos - x.pos AS k, x.sym AS a, y.sym AS b FROM tok x JOIN tok y ON x.seq_id = y.seq_id AND y.pos - x.pos BETWEEN 1 AND 5),
j AS (SELECT segment, k, a, b, count(*) AS cnt FROM p GROUP BY ALL), fa AS (SELECT segment, k, a, sum(cnt) AS cnt FROM j GROUP BY ALL), fb AS (SELECT segment, k, b, sum(cnt) AS cnt FROM j GROUP BY ALL),
hj AS (SELECT segment, k, {LN} AS hab, sum(cnt)::BIGINT AS pairs FROM j GROUP BY ALL), ha AS (SELECT segment, k, {LN} AS ha FROM fa GROUP BY ALL), hb AS (SELECT segment, k, {LN} AS hb FROM fb GROUP BY ALL),
mi AS (SELECT segment, k, pairs, CASE WHEN pairs >= 10 THEN greatest(0, ha + hb - hab) ELSE 0 END AS mi FROM hj JOIN ha USING (segment, k) JOIN hb USING (segment, k))"""


@query("agg_18_mutual_information", f"{MI} SELECT segment, k::BIGINT AS k, pairs, round(mi, 6) AS mi FROM mi")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.mutual_information(orders(spark, sf), SEG, [1, 2, 3, 4, 5]), "mi")


@query("agg_19_information_decay", f"""{MI}, d AS (SELECT segment, -regr_slope(ln(mi), ln(k)) AS gamma, regr_r2(ln(mi), ln(k)) AS p2, regr_r2(ln(mi), k) AS e2 FROM mi WHERE mi > 1e-9 GROUP BY segment)
SELECT segment, round(gamma, 5) AS gamma, round(p2, 5) AS power_r2, round(e2, 5) AS exp_r2, CASE WHEN p2 > e2 THEN 'power' ELSE 'exponential' END AS regime FROM d""")
def _(spark, sf):  # noqa: ANN001, ANN202
    d = m.decay(m.mutual_information(orders(spark, sf), SEG, [1, 2, 3, 4, 5]), SEG)
    return d.select("segment", *[F.round(c, 5).alias(c) for c in ("gamma", "power_r2", "exp_r2")], "regime")


@query("agg_20_order_profile", f"""{BLOCKS}, i AS (SELECT segment, n, CASE WHEN n = 1 THEN ln(v) - h ELSE greatest(0, lag(h / n) OVER (PARTITION BY segment ORDER BY n) - h / n) END AS info FROM b)
SELECT segment, n, round(info, 6) AS info, round(info / sum(info) OVER (PARTITION BY segment), 6) AS share FROM i""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.order_profile(m.block_entropy(_blocks(spark, sf), SEG), SEG).select("segment", "n", "info", "share"), "info", "share")


@query("agg_21_higher_orders", f"""{BLOCKS}, w AS (SELECT segment, max(h) FILTER (n = 1) AS h1, max(h) FILTER (n = 2) AS h2, max(h) FILTER (n = 3) AS h3 FROM b GROUP BY segment)
SELECT segment, round(h1, 6) AS h1, round(greatest(0, least(1, (2 * h1 - h2) / h1)), 6) AS e2, round(greatest(0, least(1, (3 * h1 - 3 * h2 + h3) / h1)), 6) AS e3 FROM w""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.higher_orders(m.block_entropy(_blocks(spark, sf), SEG), SEG), "h1", "e2", "e3")


@query("agg_23_sequence_signature", f"""WITH {EVENTS}, {tok('events_seq')}, c AS (SELECT seq_id, sym, count(*) AS cnt FROM tok WHERE len >= 4 GROUP BY ALL)
SELECT seq_id, round(ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt), 6) + 0.0 AS h, sum(cnt)::BIGINT AS n, count(*) AS types FROM c GROUP BY seq_id""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.signature_by_sequence(events(spark, sf)), "h")


@query("agg_24_lengths", f"""WITH {LINES}, l AS (SELECT lang, len(symbols) AS n, row_number() OVER (PARTITION BY lang ORDER BY len(symbols)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM lines)
SELECT lang, count(*) AS sequences, round(avg(n), 6) AS mean_len, min(n) AS min_len, max(n) AS max_len, max(n) FILTER (i = c // 2) AS median_len FROM l GROUP BY lang""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.length_stats(lines(spark, sf), ["lang"]), "mean_len")


@query("agg_25_template_coverage", f"""WITH {ORDERS}, {grams('orders_seq', 'segment', most=4)}, c AS (SELECT segment, n, gram FROM grams GROUP BY ALL HAVING count(*) >= 3),
h AS (SELECT segment, count(DISTINCT seq_id) AS covered FROM grams JOIN c USING (segment, n, gram) GROUP BY segment), t AS (SELECT segment, count(*) AS templates FROM c GROUP BY segment), s AS (SELECT segment, count(*) AS sequences FROM orders_seq GROUP BY segment)
SELECT segment, sequences, coalesce(templates, 0) AS templates, round(coalesce(covered, 0) / sequences, 6) AS coverage FROM s LEFT JOIN t USING (segment) LEFT JOIN h USING (segment)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.template_coverage(orders(spark, sf), SEG), "coverage")


@query("agg_26_hapax_rate", f"{TOK_LINES}, c AS (SELECT source, sym, count(*) AS cnt FROM tok GROUP BY ALL) SELECT source, count(*) AS types, count(*) FILTER (cnt = 1) AS hapax, round(count(*) FILTER (cnt = 1) / count(*), 6) AS rate FROM c GROUP BY source")
def _(spark, sf):  # noqa: ANN001, ANN202
    c = m.symbol_counts(lines(spark, sf), ["source"]).groupBy("source").agg(F.count("*").alias("types"), F.sum(F.when(F.col("cnt") == 1, 1).otherwise(0)).alias("hapax"))
    return c.withColumn("rate", r6(F.col("hapax") / F.col("types")))


POS1 = f"{TOK_ORDERS}, q AS (SELECT segment, sym, count(*) AS n, count(*) FILTER (pos = 0) AS n_start, count(*) FILTER (pos = len - 1 AND pos > 0) AS n_end, count(*) FILTER (pos > 0 AND pos < len - 1) AS n_internal FROM tok GROUP BY ALL)"


@query("agg_27_positional_rigidity", f"{POS1} SELECT segment, round(avg(greatest(n_start, n_end, n_internal) / n), 6) AS rigidity, round(sum(greatest(n_start, n_end, n_internal)) / sum(n), 6) AS weighted FROM q GROUP BY segment")
def _(spark, sf):  # noqa: ANN001, ANN202
    top = F.greatest("n_start", "n_end", "n_internal")
    return p.start_end_counts(orders(spark, sf), SEG).groupBy("segment").agg(r6(F.avg(top / F.col("n"))).alias("rigidity"), r6(F.sum(top) / F.sum("n")).alias("weighted"))


@query("agg_28_repetition", f"""WITH {EVENTS}, {tok('events_seq', 'day')}, x AS (SELECT *, lag(sym) OVER w AS before, lead(sym) OVER w AS after, count(*) OVER (PARTITION BY seq_id, sym) AS here FROM tok WHERE len >= 2 WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
SELECT day, count(*) FILTER (coalesce(sym = before, false) OR coalesce(sym = after, false)) AS adjacent, count(*) FILTER (here > 1) AS recurring, round(CASE WHEN count(*) FILTER (here > 1) = 0 THEN 0 ELSE count(*) FILTER (coalesce(sym = before, false) OR coalesce(sym = after, false)) / count(*) FILTER (here > 1) END, 6) AS r FROM x GROUP BY day""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.repetition(events(spark, sf), ["day"]), "r")


@query("agg_30_word_structure", f"""WITH {LINES}, f AS (SELECT lang, symbols[1] AS s, count(*) AS cnt FROM lines GROUP BY ALL), l AS (SELECT lang, symbols[-1] AS s, count(*) AS cnt FROM lines GROUP BY ALL), u AS (SELECT lang, array_to_string(symbols, ' ') AS s, count(*) AS cnt FROM lines GROUP BY ALL)
SELECT a.lang, first_h, last_h, unique_share FROM (SELECT lang, round({LN}, 6) AS first_h FROM f GROUP BY lang) a JOIN (SELECT lang, round({LN}, 6) AS last_h FROM l GROUP BY lang) b ON a.lang = b.lang JOIN (SELECT lang, round(count(*) / sum(cnt), 6) AS unique_share FROM u GROUP BY lang) c ON a.lang = c.lang""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = lines(spark, sf)
    end = lambda i, name: m._entropy_of(x.groupBy("lang", F.element_at("symbols", i).alias("s")).agg(F.count("*").alias("cnt")), ["lang"], name)
    whole = x.groupBy("lang", "symbols").agg(F.count("*").alias("cnt")).groupBy("lang").agg((F.count("*") / F.sum("cnt")).alias("unique_share"))
    return _rounded(end(1, "first_h").join(end(-1, "last_h"), "lang").join(whole, "lang"), "first_h", "last_h", "unique_share")


@query("agg_31_affix_bias", f"{TOK_ORDERS} SELECT segment, sym, round(1 - count(*) FILTER (pos > 0) / count(*), 6) AS prefix_bias, round(1 - count(*) FILTER (pos < len - 1) / count(*), 6) AS suffix_bias FROM tok GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    t = p.tokens(orders(spark, sf)).groupBy("segment", "sym")
    return t.agg(r6(1 - F.sum(F.when(F.col("pos") > 0, 1).otherwise(0)) / F.count("*")).alias("prefix_bias"), r6(1 - F.sum(F.when(F.col("pos") < F.col("len") - 1, 1).otherwise(0)) / F.count("*")).alias("suffix_bias"))


@query("agg_33_sequence_entropy", f"WITH {EVENTS}, c AS (SELECT day, array_to_string(symbols, ' ') AS s, count(*) AS cnt FROM events_seq GROUP BY ALL) SELECT day, {H} + 0.0 AS h, sum(cnt)::BIGINT AS n, count(*) AS types FROM c GROUP BY day")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(m.entropy(events(spark, sf).groupBy("day", "symbols").agg(F.count("*").alias("cnt")), ["day"]), "h")


@query("agg_34_granularity", f"{TOK_LINES} SELECT lang, CASE WHEN length(sym) = 1 THEN 'character' WHEN length(sym) = 2 THEN 'syllabic' WHEN length(sym) = 3 THEN 'word' ELSE 'mixed' END AS grain, count(*) AS tokens, count(DISTINCT sym) AS types FROM tok GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    n = F.length("sym")
    c = m.symbol_counts(lines(spark, sf), ["lang"]).withColumn("grain", F.when(n == 1, "character").when(n == 2, "syllabic").when(n == 3, "word").otherwise("mixed"))
    return c.groupBy("lang", "grain").agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"))


@query("pos_1_start_end", f"{POS1} SELECT segment, sym, n, n_start, n_end, n_internal, round(n_start / n, 6) AS start_rate, round(n_end / n, 6) AS end_rate, round(n_internal / n, 6) AS internal_rate FROM q")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.start_end_counts(orders(spark, sf), SEG), "start_rate", "end_rate", "internal_rate")


POS2 = f"{TOK_LINES}, q AS (SELECT lang, sym, count(*) AS n, count(*) FILTER (pos = 0 AND len > 1) AS initial, count(*) FILTER (pos > 0 AND pos < len - 1) AS medial, count(*) FILTER (pos = len - 1 AND len > 1) AS terminal, count(*) FILTER (len = 1) AS singleton FROM tok GROUP BY ALL)"


@query("pos_2_four_way", f"""{POS2} SELECT *, CASE WHEN initial = greatest(initial, medial, terminal) THEN 'initial' WHEN medial = greatest(initial, medial, terminal) THEN 'medial' ELSE 'terminal' END AS dominant,
round(greatest(initial, medial, terminal) / n, 6) AS dominant_share, n >= 3 AND (initial = n OR medial = n OR terminal = n) AS exclusive FROM q""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.four_way_counts(lines(spark, sf), ["lang"]), "dominant_share")


POS3 = f"{TOK_ORDERS}, q0 AS (SELECT nation, sym, count(*) AS n, count(*) FILTER (pos = 0 AND len > 1) / count(*) AS i_rate, count(*) FILTER (pos = len - 1 AND len > 1) / count(*) AS t_rate FROM tok GROUP BY ALL HAVING count(*) >= 3), q AS (SELECT *, 1 - i_rate - t_rate AS m_rate, CASE WHEN t_rate >= 0.6 THEN 'TERMINAL' WHEN i_rate >= 0.5 THEN 'INITIAL' WHEN round(1 - i_rate - t_rate, 12) >= 0.65 THEN 'MEDIAL' ELSE 'MIXED' END AS class FROM q0)"


@query("pos_3_rates_and_classes", f"{POS3} SELECT nation, sym, n, round(t_rate, 6) AS t_rate, round(i_rate, 6) AS i_rate, round(m_rate, 6) + 0.0 AS m_rate, class FROM q")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.rates(orders(spark, sf), ["nation"]), "t_rate", "i_rate", "m_rate")


@query("pos_4_candidates", f"""{TOK_LINES}, q AS (SELECT lang, sym, count(*) AS n, count(*) FILTER (pos = 0) AS n_start, count(*) FILTER (pos = len - 1 AND pos > 0) AS n_end FROM tok GROUP BY ALL),
c AS (SELECT *, n_end / n >= 0.5 AND n_end >= 5 AS t, n_start / n >= 0.5 AND n_start >= 3 AS i FROM q), s AS (SELECT lang, count(*) AS k FROM lines GROUP BY lang)
SELECT lang, count(*) FILTER (t) AS terminals, count(*) FILTER (i) AS initials, round(coalesce(sum(n_end) FILTER (t), 0) / any_value(k), 6) AS end_share, round(coalesce(sum(n_start) FILTER (i), 0) / any_value(k), 6) AS start_share FROM c JOIN s USING (lang) GROUP BY lang""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.candidates(lines(spark, sf), ["lang"]), "end_share", "start_share")


POS5 = f"""{POS2.replace('count(*) FILTER (pos = 0 AND len > 1) AS initial, count(*) FILTER (pos > 0 AND pos < len - 1) AS medial, count(*) FILTER (pos = len - 1 AND len > 1) AS terminal, count(*) FILTER (len = 1) AS singleton', 'count(*) FILTER (pos = 0) / count(*) AS s, count(*) FILTER (pos = len - 1 AND pos > 0) / count(*) AS e, count(*) FILTER (pos > 0 AND pos < len - 1) / count(*) AS i')},
k AS (SELECT *, CASE WHEN n = 1 THEN 'HAPAX' WHEN n < 5 THEN 'LOW_FREQUENCY' WHEN e >= 0.6 THEN 'TERMINAL_STRONG' WHEN s >= 0.6 THEN 'INITIAL_STRONG' WHEN i >= 0.7 THEN 'MEDIAL_STRONG' WHEN s >= 0.25 AND e >= 0.25 THEN 'BIMODAL' ELSE 'MIXED' END AS class FROM q)"""


@query("pos_5_structural_classes", f"{POS5} SELECT lang, class, count(*) AS types, sum(n)::BIGINT AS tokens, round(avg(s), 6) AS mean_start, round(avg(e), 6) AS mean_end, round(var_pop(s), 6) AS var_start FROM k GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    k = p.structural_class(p.start_end_counts(lines(spark, sf), ["lang"]))
    return k.groupBy("lang", "class").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), r6(F.avg("start_rate")).alias("mean_start"), r6(F.avg("end_rate")).alias("mean_end"), r6(F.var_pop("start_rate")).alias("var_start"))


@query("pos_6_position_entropy", f"{POS1}, e AS (SELECT segment, sym, unnest([n_start / n, n_end / n, n_internal / n]) AS r FROM q) SELECT segment, sym, round(sum(CASE WHEN r > 0 THEN -r * log2(r) ELSE 0 END), 6) + 0.0 AS pos_entropy FROM e GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return p.position_entropy(p.start_end_counts(orders(spark, sf), SEG)).select("segment", "sym", r6("pos_entropy").alias("pos_entropy"))


BINS = ", ".join(f"round(sum(CASE WHEN bin = {i} THEN len ELSE 0 END) / sum(len), 6) AS b{i}" for i in range(1, 11))


@query("pos_7_weighted_histogram", f"""{TOK_ORDERS}, x AS (SELECT segment, sym, len, CASE WHEN len = 1 THEN 5.5::DOUBLE ELSE 1 + 9 * pos / (len - 1) END AS x FROM tok), y AS (SELECT *, least(10, floor(x)) AS bin FROM x)
SELECT segment, sym, count(*) AS n, round(sum(len)::DOUBLE, 6) AS w, {BINS}, round(sum(len * x) / sum(len), 6) AS mean, round(greatest(sum(len * x * x) / sum(len) - pow(sum(len * x) / sum(len), 2), 0), 6) AS variance FROM y GROUP BY ALL""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.weighted_histogram(orders(spark, sf), SEG), "w", "mean", "variance", *[f"b{i}" for i in range(1, 11)])


@query("pos_12_numerals", f"""{BI_ORDERS}, q AS (SELECT segment, sym, count(*) AS n, stddev_pop(CASE WHEN len > 1 THEN pos / (len - 1) ELSE 0 END) AS spread FROM tok GROUP BY ALL HAVING count(*) >= 3),
o AS (SELECT segment, a AS sym, count(*) AS self FROM bi WHERE a = b GROUP BY ALL), nb AS (SELECT segment, sym, count(DISTINCT nb) AS neighbours FROM (SELECT segment, a AS sym, b AS nb FROM bi UNION ALL SELECT segment, b, a FROM bi) GROUP BY ALL),
j AS (SELECT q.*, coalesce(self, 0) AS self, coalesce(neighbours, 0) AS neighbours FROM q LEFT JOIN o USING (segment, sym) LEFT JOIN nb USING (segment, sym))
SELECT segment, sym, n, round(spread, 6) AS spread, self, neighbours, round(CASE WHEN spread < 0.25 THEN 0.3 ELSE 0 END + CASE WHEN self > 0.1 * n THEN 0.3 ELSE 0 END + CASE WHEN neighbours < 10 AND n > 10 THEN 0.2 ELSE 0 END + CASE WHEN neighbours < 0.3 * n THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM j""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.numerals(orders(spark, sf), SEG), "spread", "score")


@query("pos_13_five_way", f"""WITH {EVENTS}, {tok('events_seq', 'day')}, x AS (SELECT *, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS nxt FROM tok),
g AS (SELECT day, sym, count(*) AS n, count(*) FILTER (pos = 0) / count(*) AS i, count(*) FILTER (pos = len - 1) / count(*) AS t, count(*) FILTER (pos > 0 AND pos < len - 1) / count(*) AS m, count(*) FILTER (nxt = sym) / count(*) AS r FROM x GROUP BY ALL)
SELECT day, sym, n, round(i, 6) AS i_rate, round(t, 6) AS t_rate, round(m, 6) AS m_rate, round(r, 6) AS rep_rate, CASE WHEN r >= 0.2 THEN 'NUMERICAL' WHEN i >= 0.55 AND t < 0.3 AND m < 0.3 THEN 'INITIAL' WHEN t >= 0.55 AND i < 0.3 AND m < 0.3 THEN 'TERMINAL' WHEN m >= 0.55 AND i < 0.3 AND t < 0.3 THEN 'MEDIAL' ELSE 'MIXED' END AS class FROM g""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.five_way(events(spark, sf), ["day"]), "i_rate", "t_rate", "m_rate", "rep_rate")


@query("pos_11_logo_syllabic", f"""{TOK_LINES}, g AS (SELECT lang, sym, count(*) AS n, count(*) FILTER (len = 1) / count(*) AS alone, count(*) FILTER (pos = 0) / count(*) AS initial, count(*) FILTER (pos = len - 1) / count(*) AS terminal FROM tok GROUP BY ALL)
SELECT lang, sym, n, round(alone, 6) AS alone, round(initial, 6) AS initial, round(terminal, 6) AS terminal, CASE WHEN alone >= 0.4 THEN 'logogram' WHEN initial >= 0.8 OR terminal >= 0.8 THEN 'determinative' ELSE 'syllabogram' END AS class FROM g""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.logo_syllabic(lines(spark, sf), ["lang"]), "alone", "initial", "terminal")


@query("pos_15_run_lengths", f"""WITH {EVENTS}, {tok('events_seq', 'day')}, x AS (SELECT *, CASE WHEN lag(sym) OVER (PARTITION BY seq_id ORDER BY pos) = sym THEN 0 ELSE 1 END AS new FROM tok), y AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM x),
r AS (SELECT sym, count(*) AS k FROM y GROUP BY seq_id, sym, run HAVING count(*) >= 2), g AS (SELECT sym, count(*) AS runs, avg(k) AS mean, stddev_pop(k) AS sd, max(k) AS longest FROM r GROUP BY sym)
SELECT sym, runs, round(mean, 6) AS mean, round(sd, 6) AS sd, longest, round(sd / mean, 6) AS cv, CASE WHEN sd / mean < 0.2 THEN 'fixed' WHEN sd / mean < 0.5 THEN 'variable' ELSE 'free' END AS regime FROM g""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.run_stats(events(spark, sf), []), "mean", "sd", "cv")


@query("pos_16_class_patterns", f"{POS3.replace('nation, sym', 'sym')}, s AS (SELECT t.seq_id, string_agg(coalesce(class, '?'), '-' ORDER BY pos) AS pattern FROM tok t LEFT JOIN q USING (sym) GROUP BY t.seq_id) SELECT pattern, count(*) AS cnt FROM s GROUP BY pattern")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = orders(spark, sf)
    return p.slot_templates(x, p.rates(x, []).select("sym", "class"), [])


@query("pos_17_slot_neighbours", f"""WITH {ORDERS}, s AS (SELECT * FROM orders_seq WHERE len(symbols) > 1), r AS (SELECT symbols[1] AS sym, symbols[2] AS nb, count(*) AS cnt FROM s GROUP BY ALL), l AS (SELECT symbols[-1] AS sym, symbols[-2] AS nb, count(*) AS cnt FROM s GROUP BY ALL),
rt AS (SELECT sym, list(nb ORDER BY nb) AS r FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY cnt DESC, nb) AS k FROM r) WHERE k <= 3 GROUP BY sym), lt AS (SELECT sym, list(nb ORDER BY nb) AS l FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY cnt DESC, nb) AS k FROM l) WHERE k <= 3 GROUP BY sym)
SELECT sym, array_to_string(r, ',') AS right_top, array_to_string(l, ',') AS left_top, round(1 - len(list_intersect(r, l)) / len(list_distinct(list_concat(r, l))), 6) AS divergence FROM rt JOIN lt USING (sym)""")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.slot_neighbours(orders(spark, sf), []), "divergence")


@query("pos_18_grammar_r2", f"{POS3}, w AS (SELECT nation, sum(k * (vi + vt)) AS within FROM (SELECT nation, class, count(*) AS k, var_pop(i_rate) AS vi, var_pop(t_rate) AS vt FROM q GROUP BY ALL) GROUP BY nation), t AS (SELECT nation, count(*) * (var_pop(i_rate) + var_pop(t_rate)) AS total FROM q GROUP BY nation) SELECT nation, round(CASE WHEN total > 0 THEN 1 - within / total ELSE 0 END, 6) + 0.0 AS r2 FROM w JOIN t USING (nation)")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(p.grammar_r2(p.rates(orders(spark, sf), ["nation"]), ["nation"]), "r2")


@query("roles_bigrams", f"WITH {ROLES}, {grams('roles_seq')} SELECT n, gram, count(*) AS cnt FROM grams GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return m.ngram_counts(roles(spark, sf), 2).withColumn("n", F.col("n").cast("long"))
