"""Listings of items, links to known entities, and claims set against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of entities as (kind, scheme, pattern); the first group is the entity's id.
ENTITIES = [
    ("sign", "generic", r"(?i)\bsign\s+(\d{1,4})\b"),
    ("sign", "mahadevan", r"\bM-?(\d{2,4})\b"),
    ("sign", "parpola", r"(?i)\bParpola\s+(?:No\.|#)\s*(\d{1,4})\b"),
    ("sign", "fuls", r"(?i)\bFuls\s+(?:No\.|#)?\s*(\d{1,4})\b"),
    ("dedr", "", r"(?i)\bDEDR\s*#?\s*(\d{1,5})[a-z]?\b"),
    ("site", "", r"(?i)\b(Mohenjo-daro|Mohenjo daro|Harappa|Rakhigarhi|Dholavira|Banawali|Lothal|Kalibangan|Ganweriwala|Sanauli|Chanhu-daro|Chanhudaro)\b"),
]
#: Words that name a claim's sign where it lists none.
SIGN_WORDS = r"(?i)\b(fish|arrow|unicorn|jar|cattle|boat|buffalo)\b"
SUPPORTED, CONTRADICTED = ["strongly_supported", "partially_supported"], "contradicted"


def listing(items: DataFrame, topic: str | None = None, kind: str | None = None, status: str | None = None, since: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Items (item_id, topics, kind, status, fetched_at and more) that pass all filters given, newest first, ties by id; a page of them with limit and offset.

    topics is an array or a list joined by commas, in which a topic is a whole
    member. A null fails each filter that looks at it; items without a time come last.
    """
    x = items
    if topic is not None:
        named = F.col("topics") if dict(items.dtypes)["topics"].startswith("array") else F.transform(F.split("topics", ","), lambda v: F.trim(v))
        x = x.where(F.array_contains(named, topic))
    for column, wanted in (("kind", kind), ("status", status)):
        x = x if wanted is None else x.where(F.col(column) == wanted)
    x = x if since is None else x.where(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    x = x.orderBy(F.desc_nulls_last("fetched_at"), F.asc("item_id"))
    x = x.offset(offset) if offset else x
    return x if limit is None else x.limit(limit)


def entity_links(docs: DataFrame, families: list[tuple[str, str, str]] = ENTITIES) -> DataFrame:
    """(doc_id, kind, scheme, target, label, mentions): entities that whole texts name, once for each document.

    target is the id in lower case, for sites with hyphens for spaces; label is its
    first spelling. Texts of null have none; rows of one doc_id count together.
    """
    def of(kind: str, scheme: str, rx: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(rx), 1), lambda q, i: F.struct(F.lit(kind).alias("kind"), F.lit(scheme).alias("scheme"), q.alias("label"), i.alias("at")))

    x = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.concat(*[of(*f) for f in families])).alias("c")).select("doc_id", "c.*")
    target = F.when(F.col("kind") == "site", F.replace(F.lower("label"), F.lit(" "), F.lit("-"))).otherwise(F.lower("label"))
    g = x.withColumn("target", target).groupBy("doc_id", "kind", "scheme", "target")
    return g.agg(F.min_by("label", F.struct("at", "label")).alias("label"), F.count("*").alias("mentions"))


def matrix(claims: DataFrame, group_by: str = "sign") -> DataFrame:
    """(key, claims, sources, supported, falsified, untested, verdict) of claims (source, signs, claim_type, status, text).

    By sign, a claim counts for each sign it lists; where it lists none, for the
    first of SIGN_WORDS in its text, else for `unclassified`. By any other word it
    counts for its claim_type (`unknown` if null). A status of null is `untested`.
    verdict: `conflict` with claims both supported and falsified, else what there is.
    """
    word = F.regexp_extract(F.coalesce("text", F.lit("")), SIGN_WORDS, 1)
    named = F.array_compact(F.coalesce("signs", F.array().cast("array<string>")))
    keys = F.when(F.size(named) > 0, named).otherwise(F.array(F.when(word != "", F.lower(word)).otherwise("unclassified"))) if group_by == "sign" else F.array(F.coalesce("claim_type", F.lit("unknown")))
    x = claims.select("source", F.coalesce("status", F.lit("untested")).alias("status"), F.explode(keys).alias("key"))
    bad = F.contains("status", F.lit("falsified")) | (F.col("status") == CONTRADICTED)
    # claims of one key, source and status are counted first: sources are then few rows
    g = x.groupBy("key", "source", "status").agg(F.count("*").alias("c"))
    s = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    g = g.groupBy("key").agg(F.sum("c").alias("claims"), F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"), s(F.col("status").isin(SUPPORTED)).alias("supported"), s(bad).alias("falsified"), s(F.col("status") == "untested").alias("untested"))
    good, wrong = F.col("supported") > 0, F.col("falsified") > 0
    return g.withColumn("verdict", F.when(good & wrong, "conflict").when(good, "supported").when(wrong, "falsified").otherwise("untested"))


def compound_hypotheses(claims: DataFrame) -> DataFrame:
    """(hypothesis_id, kind, sign, position, value_source, other_source, statement): predictions that follow from claims of two different sources.

    claims has claim_type, source, signs, value and text. A value (or function) claim
    on a sign and a positional claim on initial or terminal signs predict that the
    sign is frequent there; an archaeological and a language claim predict that
    sites differ. Equal claims of one source count once, claims without a source go.
    The positional side is brought down to its sources and positions before the join,
    so a value claim meets each of those once: the result is as large as that.
    """
    c = claims.where("source IS NOT NULL AND claim_type IS NOT NULL")
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("claim_type"), w))
    text = F.lower(F.coalesce("text", F.lit("")))
    value = c.where(has("sign_value", "sign_function")).select("source", F.explode(F.array_compact("signs")).alias("sign"), F.coalesce("value", "text", F.lit("")).alias("value")).distinct()
    place = F.when(F.contains(text, F.lit("initial")), "initial").when(F.contains(text, F.lit("terminal")), "terminal")
    positional = c.where(has("position")).select(F.col("source").alias("other_source"), place.alias("position")).where("position IS NOT NULL").distinct()
    first = value.join(positional, F.col("source") != F.col("other_source")).select(
        F.lit("sign_position").alias("kind"), "sign", "position", F.col("source").alias("value_source"), "other_source",
        F.format_string("If %s means %s [%s] and %s signs have a function of their own [%s], then %s is frequent in %s position.", "sign", "value", "source", "position", "other_source", "sign", "position").alias("statement"),
    )
    dig = c.where(has("archaeological")).select("source", F.coalesce("text", F.lit("")).alias("found")).distinct()
    tongue = c.where(has("language")).select(F.col("source").alias("other_source"), F.coalesce("text", F.lit("")).alias("said")).distinct()
    second = dig.join(tongue, F.col("source") != F.col("other_source")).select(
        F.lit("site_language").alias("kind"), F.lit(None).cast("string").alias("sign"), F.lit(None).cast("string").alias("position"), F.col("source").alias("value_source"), "other_source",
        F.format_string("If %s [%s] and %s [%s], then the distributions of signs differ by site.", "found", "source", "said", "other_source").alias("statement"),
    )
    both = first.unionByName(second)
    return both.select(F.substring(F.sha2("statement", 256), 1, 16).alias("hypothesis_id"), *both.columns)
