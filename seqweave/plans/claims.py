"""Queries over listings, links and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqweave.operators import claims as c
from seqweave.plans.counting import _rounded
from seqweave.plans.registry import query
from seqweave.sources.adapters import table


@query("evd_3_listing", "SELECT event_id AS item_id, event_type AS kind FROM events WHERE event_type IN ('click', 'purchase') AND event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, sf):  # noqa: ANN001, ANN202
    ev = table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.col("event_type").alias("kind"), F.when(F.col("event_type").isin("click", "purchase"), "shop, all").otherwise("shopping").alias("topics"), F.col("ts").alias("fetched_at"))
    return c.listing(ev, "shop", "purchase", since="2024-01-10 00:00:00").select("item_id", "kind")


FAMILIES = [("mail", "address", "([A-Za-z0-9]+@[A-Za-z0-9.]+[a-z])"), ("net", "ip", "([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})"), ("number", "long", r"\b([0-9]{6,})\b"), ("key", "access", r"\b(AKIA[A-Z0-9]+)\b")]
FOUND = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, '{scheme}' AS scheme, unnest(regexp_extract_all(text, '{rx}', 1)) AS label FROM documents" for kind, scheme, rx in [*FAMILIES, *c.ENTITIES])


@query("evd_12_entities", f"SELECT doc_id, kind, scheme, CASE WHEN kind = 'site' THEN replace(lower(label), ' ', '-') ELSE lower(label) END AS target, count(*) AS mentions FROM ({FOUND}) GROUP BY ALL")
def _(spark, sf):  # noqa: ANN001, ANN202
    return c.entity_links(table(spark, sf, "documents"), [*FAMILIES, *c.ENTITIES]).drop("label")


CLAIMS = """cl AS (SELECT d.doc_id, source, lang, text,
CASE WHEN quality = 1 AND toxic = 0 THEN 'strongly_supported' WHEN quality = 1 THEN 'partially_supported' WHEN toxic = 1 THEN 'contradicted' WHEN quality = 0 THEN 'falsified_here' ELSE 'untested' END AS status FROM documents d LEFT JOIN labels USING (doc_id))"""
COUNTS = "count(*) AS claims, count(DISTINCT nullif(source, '')) AS sources, count(*) FILTER (status LIKE '%supported') AS supported, count(*) FILTER (status LIKE '%falsified%' OR status = 'contradicted') AS falsified, count(*) FILTER (status = 'untested') AS untested"
VERDICT = f"SELECT *, CASE WHEN supported > 0 AND falsified > 0 THEN 'conflict' WHEN supported > 0 THEN 'supported' WHEN falsified > 0 THEN 'falsified' ELSE 'untested' END AS verdict FROM (SELECT key, {COUNTS} FROM k GROUP BY key)"


def _claims(spark, sf):  # noqa: ANN001, ANN202
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    status = F.when((q == 1) & (t == 0), "strongly_supported").when(q == 1, "partially_supported").when(t == 1, "contradicted").when(q == 0, "falsified_here")
    kind = F.when(F.col("doc_id") % 2 == 0, "sign_value").otherwise("position")
    return d.select("doc_id", "source", F.when(F.col("lang").isNotNull() & (F.col("doc_id") % 3 > 0), F.array("lang", F.concat("lang", F.lit("/"), F.coalesce("source", F.lit("-"))))).alias("signs"), kind.alias("claim_type"), status.alias("status"), "text", F.concat(F.lit("v"), (F.col("doc_id") % 5).cast("string")).alias("value"))


@query("evd_15_sign_matrix", f"WITH {CLAIMS}, k AS (SELECT source, status, unnest([lang, lang || '/' || coalesce(source, '-')]) AS key FROM cl WHERE lang IS NOT NULL AND doc_id % 3 > 0 UNION ALL SELECT source, status, coalesce(nullif(lower(regexp_extract(text, '{c.SIGN_WORDS}', 1)), ''), 'unclassified') FROM cl WHERE lang IS NULL OR doc_id % 3 = 0) {VERDICT}")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.matrix(_claims(spark, sf)))


@query("evd_15_type_matrix", f"WITH {CLAIMS}, k AS (SELECT source, status, CASE WHEN doc_id % 2 = 0 THEN 'sign_value' ELSE 'position' END AS key FROM cl) {VERDICT}")
def _(spark, sf):  # noqa: ANN001, ANN202
    return _rounded(c.matrix(_claims(spark, sf), "type"))


@query("evd_16_compound_hypotheses", """WITH v AS (SELECT DISTINCT source, unnest([lang, lang || '/' || source]) AS sign, 'v' || (doc_id % 5) AS value FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 3 > 0 AND doc_id % 2 = 0),
p AS (SELECT DISTINCT source AS other_source, CASE WHEN n_chars % 2 = 0 THEN 'initial' ELSE 'terminal' END AS position FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 1),
h AS (SELECT 'sign_position' AS kind, sign, position, source AS value_source, other_source, printf('If %s means %s [%s] and %s signs have a function of their own [%s], then %s is frequent in %s position.', sign, value, source, position, other_source, sign, position) AS statement FROM v JOIN p ON source <> other_source)
SELECT left(sha256(statement), 16) AS hypothesis_id, * FROM h""")
def _(spark, sf):  # noqa: ANN001, ANN202
    x = _claims(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return c.compound_hypotheses(x.withColumn("text", F.when(F.col("n_chars") % 2 == 0, "Initial signs").otherwise("TERMINAL signs")))
