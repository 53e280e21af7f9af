"""Zone comparisons, stratified nulls, global shuffles and allographs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import hash_rank, join_ranks, join_small, tokens, top_per
from seqweave.functions.tables import written
from seqweave.operators import assoc, compare
from seqweave.operators import measures as m
from seqweave.operators import positions as p
from seqweave.operators.hypotheses import readout
from seqweave.operators.transforms import hashed


def shuffle_globally(seq: DataFrame, seed: str, by: list[str], key: Column | None = None) -> DataFrame:
    """Tokens of each group dealt anew to its sequences, whose lengths stay: rank of a token's hash against rank of a place's hash.

    key names a sequence in the hashes, seq_id if none is given; seq_id has to be unique within by.
    Sequences are put together by their groups and ids; they are joined with seq for further columns alone.
    """
    named = F.col("seq_id") if key is None else key
    t = tokens(seq.select("seq_id", *by, named.alias("_key"), "symbols"))
    left = hash_rank(t.select(*by, "sym", hashed(seed, "token", F.col("_key"), F.col("pos")).alias("h")), "h", by).select(*by, "sym", "rank")
    right = hash_rank(t.select(*by, "seq_id", "pos", hashed(seed, "place", F.col("_key"), F.col("pos")).alias("h")), "h", by).select(*by, "seq_id", "pos", "rank")
    x = join_ranks(right, left, by).groupBy("seq_id", *by).agg(F.array_sort(F.collect_list(F.struct("pos", "sym"))).alias("x")).select("seq_id", *by, F.col("x.sym").alias("symbols"))
    if set(seq.columns) == set(x.columns):
        return x.select(*seq.columns)
    return seq.drop("symbols").join(x, ["seq_id", *by]).select(*[c for c in seq.columns if c != "symbols"], "symbols")


def zone_report(seq: DataFrame, site: str, zones: DataFrame) -> DataFrame:
    """Vocabulary overlap and divergence of zones (site, zone) of sites."""
    z = join_small(seq, zones, [site]).withColumn("zone", F.coalesce("zone", F.lit("other")))
    pairs = compare.stratum_pairs(m.symbol_counts(z, ["zone"]), "zone")
    return compare.overlaps(pairs).join(compare.divergences(pairs), ["x", "y"])


def zone_inventories(seq: DataFrame, site: str, zones: DataFrame, initial: float, terminal: float) -> DataFrame:
    """Sequences, tokens and types of each zone, and its symbols that start or end sequences in at least such shares of their tokens."""
    x = join_small(seq, zones, [site]).withColumn("zone", F.coalesce("zone", F.lit("other")))
    c = p.start_end_counts(x, ["zone"])
    named = lambda rate, least: F.array_join(F.array_sort(F.collect_set(F.when(F.col(rate) >= least, F.col("sym")))), ",")
    g = c.groupBy("zone").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), named("start_rate", initial).alias("initials"), named("end_rate", terminal).alias("terminals"))
    return x.groupBy("zone").agg(F.count("*").alias("sequences")).join(g, "zone")


def signature_distance(signatures: DataFrame, key: str, role: str, columns: list[str]) -> DataFrame:
    """Distance of each corpus to the template of its role's references: columns scaled by the template's spread."""
    t = signatures.groupBy(role).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[(F.max(c) - F.min(c)).alias(f"s_{c}") for c in columns])
    j = signatures.select(key, *columns).crossJoin(t)  # a row for each role
    d = sum((F.pow((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(1e-9)), F.lit(2.0)) for c in columns), F.lit(0.0))
    return j.select(key, role, F.sqrt(d).alias("distance"))


def sound_groups(words: DataFrame, word: str, digraphs: dict[str, int], letters: dict[str, int]) -> DataFrame:
    """Shares of initial-sound groups: the first two letters if they are a known digraph, else the first letter."""
    lookup = lambda table, c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()]) if table else F.lit(None)
    up = F.upper(word)
    g = words.select(F.coalesce(lookup(digraphs, F.substring(up, 1, 2)), lookup(letters, F.substring(up, 1, 1))).alias("group")).where("group IS NOT NULL")
    c = g.groupBy("group").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def stratified_readout(names: DataFrame, objects: DataFrame, stratum: str) -> DataFrame:
    """The length readout within each stratum of objects: (stratum, total, matched); one row for each, and all together as '(all)'."""
    strata = [r[0] for r in objects.where(F.col(stratum).isNotNull()).select(stratum).distinct().orderBy(stratum).limit(101).collect()]
    if len(strata) > 100:
        raise ValueError("more than 100 strata")
    out = readout(names, objects).withColumn("stratum", F.lit("(all)"))
    for s in strata:
        out = out.unionByName(readout(names, objects.where(F.col(stratum) == s)).withColumn("stratum", F.lit(s)))
    return out


def confidence_null(seq: DataFrame, labels: DataFrame, seed: str, reps: int = 20) -> DataFrame:
    """Weight of labelled tokens (sym, confidence) against labels permuted over symbols; counts per symbol are joined once."""
    w = F.when(F.col("confidence") == "HIGH", 1.0).when(F.col("confidence") == "MEDIUM", 0.5).otherwise(0.2)
    c = m.symbol_counts(seq).join(labels.select("sym", w.alias("w")), "sym", "left").fillna(0.0, ["w"])
    x = c.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    a = hash_rank(x.select("rep", "cnt", hashed(seed, "a", F.col("rep"), F.col("sym")).alias("h")), "h", ["rep"]).select("rep", "rank", "cnt")
    b = hash_rank(x.select("rep", "w", hashed(seed, "b", F.col("rep"), F.col("sym")).alias("h")), "h", ["rep"]).select("rep", "rank", "w")
    null = a.join(b, ["rep", "rank"]).groupBy("rep").agg(F.sum(F.col("cnt") * F.col("w")).alias("v"))
    seen = c.agg(F.sum(F.col("cnt") * F.col("w")).alias("v"))
    from seqweave.operators.hypotheses import permutation_p

    return permutation_p(seen, null, "v")


def allographs(seq: DataFrame, least_cosine: float = 0.55, most_shift: float = 0.5) -> DataFrame:
    """Pairs of symbols with like right contexts whose positional rates differ by little (L1), and a score.

    score = .4 positional similarity + .4 how rarely both are in one sequence + .2 ratio of frequencies.
    """
    seq = written(seq.select("seq_id", "symbols"), "sequences")
    v = assoc.context_vectors(seq, []).where(F.col("feature").startswith("R:"))
    r = p.start_end_counts(seq, []).select("sym", "n", "start_rate", "end_rate", "internal_rate")
    one = lambda k: r.select(*[F.col(c).alias(f"{k}_{c}") for c in r.columns])
    j = assoc.cosine_pairs(v, [], least_cosine).select("x", "y", "cosine").join(one("a"), F.col("x") == F.col("a_sym")).join(one("b"), F.col("y") == F.col("b_sym"))
    shift = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("start_rate", "end_rate", "internal_rate")), F.lit(0.0))
    pairs = j.withColumn("shift", shift).where(F.col("shift") <= most_shift).select("x", "y", "cosine", "shift", F.col("a_n").alias("nx"), F.col("b_n").alias("ny"))
    pairs = written(pairs, "pairs")
    # the symbols of a sequence are paired within it; sequences that share a seq_id are one
    whole = seq.groupBy("seq_id").agg(F.array_distinct(F.flatten(F.collect_list("symbols"))).alias("u"))
    has = whole.select("u", F.explode("u").alias("x"))
    size = has.groupBy(F.col("x").alias("sym")).agg(F.count("*").alias("k"))
    met = has.join(pairs.select("x").distinct(), "x", "left_semi").select("x", F.explode("u").alias("y")).where("x < y").groupBy("x", "y").agg(F.count("*").alias("both"))
    both = pairs.select("x", "y").join(met, ["x", "y"])
    q = pairs.join(both, ["x", "y"], "left").fillna(0, ["both"]).join(size.select(F.col("sym").alias("x"), F.col("k").alias("kx")), "x").join(size.select(F.col("sym").alias("y"), F.col("k").alias("ky")), "y")
    score = 0.4 * (1 - F.col("shift") / 2) + 0.4 * (1 - F.col("both") / F.least("kx", "ky")) + 0.2 * F.least("nx", "ny") / F.greatest("nx", "ny")
    return q.select("x", "y", "cosine", "shift", "both", score.alias("score"))


def allograph_groups(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(sym, grp): symbols joined by pairs of allographs, under the least symbol of each group."""
    return assoc.components(pairs.select("x", "y"), symbols.select("sym")).withColumnRenamed("cluster", "grp")


def template_distance(signatures: DataFrame, key: str, role: str, columns: list[str], positive: str) -> DataFrame:
    """Distances of each corpus to the template of the positive role and to the nearest other one, and which is nearer."""
    d = signature_distance(signatures, key, role, columns)
    g = d.groupBy(key).agg(F.min(F.when(F.col(role) == positive, F.col("distance"))).alias("positive"), F.min(F.when(F.col(role) != positive, F.col("distance"))).alias("negative"))
    return g.withColumn("verdict", F.when(F.col("positive") < F.col("negative"), positive).otherwise("other"))


def matched_words(decoded: DataFrame, vocabulary: DataFrame, examples: int = 3) -> DataFrame:
    """Vocabulary words that decodings hit: counts and the first sequences with them."""
    j = decoded.select("seq_id", F.lower("decoded").alias("word")).join(vocabulary.select(F.lower("word").alias("word")).distinct(), "word")
    n = j.groupBy("word").agg(F.count("*").alias("hits"))
    top = top_per(j, ["word"], ["seq_id"], examples).groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("seq_id")).cast("array<string>"), ",").alias("examples"))
    return n.join(top, "word")


def retagged(roles: DataFrame, vocabulary: DataFrame, n: int, tag: str = "logogram") -> DataFrame:
    """Roles (value, role) with the n most frequent vocabulary words (word, cnt) retagged."""
    top = vocabulary.orderBy(F.desc("cnt"), "word").limit(n).select(F.col("word").alias("value"), F.lit(tag).alias("new"))
    return roles.join(top, "value", "left").select("value", F.coalesce("new", "role").alias("role"))


def function_lookup(registry: DataFrame, ids: str, functions: DataFrame, sep: str = r"\|") -> DataFrame:
    """Functions (id, function) of a registry's list of ids, and a stable id from the symbol's hash."""
    x = registry.select("sym", F.explode_outer(F.split(ids, sep)).alias("id")).join(functions, "id", "left")
    return x.groupBy("sym").agg(F.array_join(F.array_sort(F.collect_set("function")), ",").alias("functions")).withColumn("stable_id", F.substring(F.sha2("sym", 256), 1, 32))


def coverage_summary(read: DataFrame, dims: list[str]) -> DataFrame:
    """Mean coverage and share of full coverage over all and by each dimension of (coverage, dims...)."""
    sets = [[], *[[d] for d in dims]]
    full = F.avg(F.when(F.col("coverage") >= 1, 1.0).otherwise(0.0))
    return read.groupingSets(sets, *dims).agg(F.count("*").alias("sequences"), F.avg("coverage").alias("coverage"), full.alias("full_share"))
