"""Queries over similarity joins, weighted paths and chunk retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import evidence as e
from seqweave.operators import graphs, retrieval
from seqweave.operators import strata as st
from seqweave.plans.counting import BI_ORDERS, SEG, _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import orders, table


@query("net_17_context_groups", f"""WITH RECURSIVE {BI_ORDERS.removeprefix('WITH ')}, v AS (SELECT segment, a AS sym, b AS ctx, count(*) AS w FROM bi GROUP BY ALL), q AS (SELECT segment, sym, ctx, w / sum(w) OVER (PARTITION BY segment, sym) AS p FROM v),
js AS (SELECT x.segment, x.sym AS x, y.sym AS y, 1 + 0.5 * sum(x.p * log2(x.p / (x.p + y.p)) + y.p * log2(y.p / (x.p + y.p))) AS js FROM q x JOIN q y ON x.segment = y.segment AND x.ctx = y.ctx AND x.sym < y.sym GROUP BY x.segment, x.sym, y.sym), eb AS (SELECT segment, x, y FROM js WHERE js <= 0.12 UNION SELECT segment, y, x FROM js WHERE js <= 0.12),
reach(segment, x, y) AS (SELECT DISTINCT segment, sym, sym FROM tok UNION SELECT r.segment, r.x, eb.y FROM reach r JOIN eb ON r.segment = eb.segment AND r.y = eb.x) SELECT segment, x AS sym, min(y) AS cluster FROM reach GROUP BY segment, x""")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Symbols whose right contexts diverge by at most 0.12 bits, linked."""
    return st.context_groups(orders(spark, sf), SEG, 0.12)


@query("net_24_weighted_betweenness")
def _(spark, sf):  # noqa: ANN001, ANN202
    """Over the directed graph of neighbours, whose lengths are their counts; scaled by the pairs of other nodes."""
    x = orders(spark, sf).select("symbols")
    edges = st.bigrams(x).groupBy("a", "b").agg(F.count("*").alias("length"))
    return _rounded(graphs.betweenness(edges, directed=True, normalized=True), "betweenness")


CHUNKS = "ch AS (SELECT * FROM (SELECT doc_id, start, regexp_replace(substr(text, start + 1, 600), '^[ \n\t]+|[ \n\t]+$', '', 'g') AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS start FROM documents)) WHERE chunk <> '')"
CHUNK_SQL = f"""WITH {CHUNKS}, nd AS (SELECT count(*) AS n FROM ch), p AS (SELECT doc_id, start, term, count(*) AS c FROM (SELECT doc_id, start, unnest(regexp_extract_all(lower(chunk), '[a-z0-9]{{3,}}')) AS term FROM ch) GROUP BY ALL), tf AS (SELECT *, c / sum(c) OVER (PARTITION BY doc_id, start) AS tf FROM p),
df AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM p, nd GROUP BY term, n), ix AS (SELECT doc_id, start, term, tf * idf AS w FROM tf JOIN df USING (term)), dn AS (SELECT doc_id, start, sqrt(sum(w * w)) AS dn FROM ix GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS term FROM benchmark) GROUP BY ALL), qt AS (SELECT *, c / sum(c) OVER (PARTITION BY item_id) AS tf FROM q), qw AS (SELECT item_id, term, tf * coalesce(idf, 1) AS w FROM qt LEFT JOIN df USING (term)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY ALL),
s AS (SELECT item_id, doc_id, start, sum(ix.w * qw.w) AS dot FROM ix JOIN qw USING (term) GROUP BY ALL), r AS (SELECT item_id, doc_id, start, dot / (dn * qn) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(dot / (dn * qn), 9) DESC, doc_id, start) AS rank FROM s JOIN dn USING (doc_id, start) JOIN qn USING (item_id) WHERE dot / (dn * qn) >= 0.05),
t AS (SELECT r.*, row_number() OVER (PARTITION BY item_id, left(chunk, 80) ORDER BY rank) AS again FROM r JOIN ch USING (doc_id, start) WHERE rank <= 5)"""


@query("evd_20_chunk_search", f"{CHUNK_SQL} SELECT item_id, rank, doc_id, start, round(score, 6) AS score FROM t WHERE again = 1")
def _(spark, sf):  # noqa: ANN001, ANN202
    """The five best chunks of all documents for each benchmark passage, of those that begin alike the best."""
    chunks = e.chunks(table(spark, sf, "documents").select("doc_id", "text"))
    key = ["doc_id", "start"]
    index = retrieval.build(chunks, key, "chunk")
    found = retrieval.search(index, retrieval.weighted(index, table(spark, sf, "benchmark"), "item_id", "text"), "item_id")
    return _rounded(retrieval.without_repeats(found, chunks, "item_id", key, "chunk").select("item_id", "rank", *key, "score"), "score")
