"""Literature and evidence tables: URLs, upserts, claims, retrieval, integrity gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.tables import written

#: Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "mc_cid", "mc_eid"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, sorted query, no slash at the end of the path."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(TRACKING))), "&")
    return F.concat(head, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def item_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(canonical_url(url), F.lit("|"), F.lower(F.trim(title))), 256)


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Items (item_id, title, topics, fetched_at): new ones are added; for known ones topics are merged and fetched_at is raised, the rest keeps its first value."""
    both = stored.withColumn("_o", F.lit(0)).unionByName(batch.withColumn("_o", F.lit(1)))
    first = F.min_by("title", F.struct("_o", "fetched_at", "title"))
    return both.groupBy("item_id").agg(first.alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"), F.max("fetched_at").alias("fetched_at"))


def tally(items: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, n) for each dimension, in one pass."""
    x = items.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("(unknown)")).alias("value")) for d in dims])).alias("d"))
    return x.groupBy("d.dim", "d.value").agg(F.count("*").alias("n"))


def tally_listed(items: DataFrame, dims: list[str], listed: str) -> DataFrame:
    """The tally with one more dimension, an array whose values count one by one; items without any count as '(unknown)'."""
    each = lambda d: F.array(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("(unknown)")).alias("value")))
    named = F.when(F.size(F.coalesce(listed, F.array())) > 0, F.col(listed)).otherwise(F.array(F.lit("(unknown)")))
    several = F.transform(named, lambda v: F.struct(F.lit(listed).alias("dim"), F.coalesce(v, F.lit("(unknown)")).alias("value")))
    return items.select(F.explode(F.concat(*[each(d) for d in dims], several)).alias("d")).groupBy("d.dim", "d.value").agg(F.count("*").alias("n"))


def topic_matches(items: DataFrame, topics: list[tuple[str, list[str], list[str]]], text: str) -> DataFrame:
    """(item columns, topic): any keyword and no exclusion, in the lower-cased text."""
    low = F.lower(F.col(text))
    any_of = lambda words: reduce(lambda c, w: c | F.contains(low, F.lit(w)), words, F.lit(False))
    found = F.array_compact(F.array(*[F.when(any_of(yes) & ~any_of(no), F.lit(name)) for name, yes, no in topics]))
    return items.withColumn("topic", F.explode(found))


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def first_per_key(batch: DataFrame, keys: list[Column], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Batch without repeats: the key is the first that isn't empty, the first row wins; known (key) rows go."""
    key = F.coalesce(*[F.nullif(k, F.lit("")) for k in keys])
    x = batch.withColumn("key", key).where("key IS NOT NULL")
    least = x.groupBy("key").agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("key", "r.*")
    return least if known is None else least.join(known, "key", "left_anti")


def intake(docs: DataFrame) -> DataFrame:
    """sha256, whether it is the first with this text, DOI and year found, slug."""
    first = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    low = first.groupBy("sha256").agg(F.min("doc_id").alias("first_id"))
    x = first.join(low, "sha256").withColumn("duplicate", F.col("doc_id") > F.col("first_id"))
    doi = F.regexp_extract(F.coalesce("text", F.lit("")), r"(10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+)", 1)
    year = F.regexp_extract(F.coalesce("text", F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1)
    slug = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 40)), "[^a-z0-9]+", "-"))
    return x.select("doc_id", "sha256", "duplicate", "first_id", doi.alias("doi"), year.alias("year"), slug.alias("slug"))


def extract(docs: DataFrame, rules: list[tuple[str, str, float]], cap: int = 3) -> DataFrame:
    """Claims by patterns: (doc_id, rule, k, quote, confidence); at most cap for each rule and document, which is the feature."""
    def of(rule: str, rx: str, conf: float) -> Column:
        found = F.slice(F.regexp_extract_all("text", F.lit(rx), 0), 1, cap)
        return F.transform(found, lambda q, i: F.struct(F.lit(rule).alias("rule"), (i + 1).alias("k"), q.alias("quote"), F.lit(conf).alias("confidence")))

    each = [of(*r) for r in rules]
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(F.concat(*each)).alias("c")).select("doc_id", "c.*")


def links(docs: DataFrame, families: list[tuple[str, str]]) -> DataFrame:
    """Distinct (doc_id, scheme, label) of pattern families."""
    def of(scheme: str, rx: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(rx), 0)), lambda q: F.struct(F.lit(scheme).alias("scheme"), q.alias("label")))

    each = [of(*f) for f in families]
    return docs.where("text IS NOT NULL").select("doc_id", F.explode(F.concat(*each)).alias("c")).select("doc_id", "c.*")


def chunks(docs: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    """Trimmed pieces of so many characters with an overlap; empty ones go."""
    n = F.length("text")
    x = docs.where("length(text) > 0").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).alias("start"))
    return x.select("doc_id", "start", F.trim(F.regexp_replace(F.expr(f"substring(text, start + 1, {size})"), "^[ \n\t]+|[ \n\t]+$", "")).alias("chunk")).where("chunk <> ''")


TERM = r"[a-z0-9]{3,}"
#: Terms that are broadcast at most.
COMMON = 100_000


def postings(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, term, tf): exact terms of three or more letters or digits, tf = count / all."""
    t = rows.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("c"))
    return t.withColumn("tf", F.col("c") / F.sum("c").over(Window.partitionBy(*key)))


def bags(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, n, bag): a row for each key with the number of its terms and, for each distinct one, (term, c); keys without terms go.

    The text is shuffled once; what a row holds is counted within the row.
    """
    t = rows.select(*key, F.regexp_extract_all(F.lower(text), F.lit(TERM), 0).alias("_t"))
    t = t.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("_t"))).alias("_t")).where("size(_t) > 0").withColumn("n", F.size("_t"))
    t = t.withColumn("_at", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))))
    each = F.transform("_at", lambda at, k: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_at", k + 1), F.col("n")) - at).alias("c")))
    return t.select(*key, "n", each.alias("bag"))


def in_bags(found: DataFrame, *columns: str) -> DataFrame:
    """The columns, term and tf = c / n of each term of bags."""
    x = found.select(*columns, "n", F.explode("bag").alias("b"))
    return x.select(*columns, F.col("b.term").alias("term"), (F.col("b.c") / F.col("n")).alias("tf"))


def idfs(found: DataFrame, n: int) -> DataFrame:
    """(term, df, idf) of bags, written; idf = ln((N + 1) / (df + 1)) + 1."""
    df = in_bags(found).groupBy("term").agg(F.count("*").alias("df"))
    return written(df.withColumn("idf", F.ln(F.lit(n + 1.0) / (F.col("df") + 1)) + 1), "terms")


def with_idf(posts: DataFrame, terms: DataFrame, most: int = COMMON) -> DataFrame:
    """posts (term, ...) with df and idf.

    The commonest terms, so many at most, are broadcast; so the shuffle is of the
    rare ones' rows alone, and what is summed up by key combines before it shuffles.
    """
    sizes = terms.groupBy("df").agg(F.count("*").alias("k"))
    upto = sizes.withColumn("s", F.sum("k").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)))  # a row for each df
    cut, least = upto.agg(F.min(F.when(F.col("s") <= most, F.col("df"))), F.min("df")).first()
    if cut is None:
        return posts.join(terms.hint("merge"), "term")
    head = F.broadcast(terms.where(F.col("df") >= cut))
    common = posts.join(head, "term")
    if cut == least:
        return common
    rare = posts.join(head.select("term"), "term", "left_anti").join(terms.where(F.col("df") < cut).hint("merge"), "term")
    return common.unionByName(rare)


def tfidf(rows: DataFrame, key: list[str], text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) with weights tf (ln((N + 1) / (df + 1)) + 1), and (term, df, idf); postings are never shuffled but those of rare terms."""
    b = written(bags(rows, key, text), "bags")
    terms = idfs(b, n)
    return with_idf(in_bags(b, *key), terms).select(*key, "term", (F.col("tf") * F.col("idf")).alias("w")), terms


def search(index: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.05) -> DataFrame:
    """Cosine top k of each query over all documents that share a term; both are (id, term, w)."""
    norm = index.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    qn = queries.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    dot = index.join(queries.withColumnRenamed("w", "qw"), "term").groupBy("item_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    s = dot.join(norm, "doc_id").join(qn, "item_id").withColumn("score", F.col("dot") / (F.col("dn") * F.col("qn"))).where(F.col("score") >= least)
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def gates(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """(check, status, detail) of expectations, all evaluated in one pass: (name, passes, detail) over aggregates."""
    one = df.agg(*[F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), detail.cast("string").alias("detail")).alias(f"c{i}") for i, (name, ok, detail) in enumerate(checks)])
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(checks))])).alias("c")).select("c.*")
