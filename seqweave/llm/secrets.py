"""Secret scans, with DataFrame functions only.

Patterns find keyed assignments, access ids and long hex strings. Beside them, a
battery of randomness tests looks at every other long run of token characters:
chi-squared uniformity over the alphabet of its inferred encoding, a runs test
and lag-1 serial correlation. Fisher's sum of the three tells how far a run is
from random; words put together are far, keys are near.

How near is near enough depends on the length, so it is learnt from decoys: each
text gives one string of its own words to a length band, joined as names, slugs or
constants are. A run's p-value is the chance that a decoy of its band and
encoding comes as near; within each band, Benjamini and Hochberg's step-up rule
over all runs bounds the share of false discoveries. A run of letters alone is
tested against decoys of letters alone, so only a long one can be found.

The values that the patterns found are tested too, as families of their own: were
they tested with the other runs, some hundred plain discoveries among them would
let dozens of words in as false ones. Their verdicts only tell keys from
placeholders; their spans stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import materialise

#: The patterns of the kinds, in the order in which they are listed.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the longest run, hence the same as any run of 18 characters or more
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]

#: Encodings by the pattern of their strings and their alphabet; the first that fits counts. Letters with at most a capital before are lower-cased.
ALPHABETS = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789abcdef"),
    "letters": (r"^[A-Z]?[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Least lengths of the bands; decoys of a band have that length, at which the tests are weakest.
BANDS = [20, 32, 64, 128]
#: What decoys are like before any is seen: mean and deviation of the logarithm of Fisher's sum in each band, and how many decoys that counts for.
#: Over 10,000 texts of a test corpus decoys had means of 3.19, 4.15, 6.06 and 7.92, and deviations of 0.77, 0.78, 0.78 and 0.45.
PRIOR_MEAN, PRIOR_SPREAD, PRIOR_COUNT = [3.1, 4.1, 5.9, 7.8], 0.7, 10
#: Bounds of the p-value that are tried, and the width of the cells by which decoys are counted.
CUTOFFS = [10 ** (-k / 4) for k in range(5, 49)]
CELL = 0.05
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002\ue002"
LN2 = 0.6931471805599453


def _found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, as array<struct<start, stop, value>>.

    Matches are bracketed by two private characters and the text is split there;
    each part's length in code points tells where it stands. A text's own such
    characters were replaced, one for one, before.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    parts = F.when(F.contains(marked, F.lit(_OPEN)), F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)).otherwise(F.array().cast("array<string>"))
    span = "struct<start:int,stop:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{span}>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        stop = state["at"] + F.length(part)
        one = F.array(F.struct(state["at"].alias("start"), stop.alias("stop"), part.alias("value")).cast(span))
        return F.struct(stop.alias("at"), (~state["inside"]).alias("inside"), F.when(state["inside"], F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def _cdf(z: Column) -> Column:
    """The normal distribution by its logistic approximation (error under 0.0002)."""
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return 1 / (1 + F.exp(-(1.5976 * x + 0.07056 * x * x * x)))


def _surprise(z: Column) -> Column:
    """-ln(1 - _cdf(z)), exact far out as well."""
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    g = 1.5976 * x + 0.07056 * x * x * x
    return F.greatest(g, F.lit(0.0)) + F.log1p(F.exp(-F.abs(g)))


def battery(value: str = "value") -> dict[str, Column]:
    """Columns for the token column `value`, each of which may use those before it.

    encoding, plain (the string over the encoding's alphabet, without up to two signs of padding), tally (how often each
    letter stands there), z_chi, z_runs, z_serial and evidence. z_chi grows with the
    chi-squared statistic. Where letters are expected five times or more it is Wilson
    and Hilferty's. Where they are rarer that isn't valid; the statistic is then a
    linear function of the number of pairs of equal characters, whose distribution
    is nearly Poisson's, and its tail counts. evidence is Fisher's sum: twice the
    sum of -ln p, about 6 for random strings.
    """
    known = ["base36", "base32", "letters", "hex"]
    encoding = reduce(lambda rest, k: F.when(F.col(value).rlike(ALPHABETS[k][0]), F.lit(k)).otherwise(rest), known, F.lit("base64"))
    by = lambda f: reduce(lambda rest, k: F.when(F.col("encoding") == k, f(ALPHABETS[k][1])).otherwise(rest), known, f(ALPHABETS["base64"][1]))
    low = F.when(F.col("encoding").isin("hex", "letters"), F.lower(value)).otherwise(F.col(value))
    plain = F.translate(F.regexp_replace(low, "={1,2}$", ""), "-_=", "+//")
    n, size = F.length("plain").cast("double"), by(lambda a: F.lit(float(len(a))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    tally = F.transform(by(lambda a: F.array(*[F.lit(c) for c in a])), lambda c: (F.length("plain") - F.length(F.replace(F.col("plain"), c, F.lit("")))).cast("double"))
    squares = total(F.transform("tally", lambda c: c * c))
    chi, df = size / n * F.col("squares") - n, size - 1
    dense = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    pairs, mean_pairs = (F.col("squares") - n) / 2, n * (n - 1) / (2 * size)
    at = F.greatest(pairs, F.lit(1.0))
    sparse = F.when(pairs > 0, -3 * F.sqrt(at) * (F.pow(mean_pairs / at, F.lit(1 / 3)) - 1 + 1 / (9 * at))).otherwise(F.lit(-30.0))
    halves = by(lambda a: F.translate("plain", a, "L" * (len(a) // 2) + "H" * (len(a) - len(a) // 2)))
    high = n - F.length(F.replace(F.col("halves"), F.lit("H"), F.lit("")))
    turns = F.regexp_count("halves", F.lit("H+")) + F.regexp_count("halves", F.lit("L+")) - 1
    expect = 2 * F.col("high") * (n - F.col("high")) / n
    spread = expect * (expect - 1) / (n - 1)
    z_runs = F.when(spread > 0, (turns - expect) / F.sqrt(spread)).otherwise(F.lit(30.0))
    x = F.transform(F.split("plain", ""), lambda c: F.instr(by(F.lit), c) - 1)
    mean, power = total(F.transform("tally", lambda c, i: c * i)) / n, total(F.transform("tally", lambda c, i: c * i * i))
    follow = total(F.zip_with(F.slice("x", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: (a * b).cast("double")))
    m = F.col("mean")
    squared = power - n * m * m
    lagged = follow - m * (2 * n * m - F.get("x", F.lit(0)) - F.element_at("x", -1)) + (n - 1) * m * m
    z_serial = F.when(squared > 1e-9, (lagged / squared + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
    both = lambda z: F.greatest(_surprise(F.abs(F.col(z))) - F.lit(LN2), F.lit(0.0))
    return {
        "encoding": encoding, "plain": plain, "tally": tally, "squares": squares, "z_chi": F.when(n < 5 * size, sparse).otherwise(dense), "halves": halves, "high": high, "z_runs": z_runs,
        "x": x, "mean": mean, "z_serial": z_serial, "evidence": 2 * (_surprise(F.col("z_chi")) + both("z_runs") + both("z_serial")),
    }


def decoy(text: Column) -> Column:
    """A string of the text's own words from a hashed place on, of the length of a hashed band; null if they don't fill it.

    By the hash, words are joined as they are, without capitals, in capitals, with
    capitals in front, by "-" or by "0". Long runs of token characters, which may
    be keys, aren't words, and neither are runs cut off by the place.
    """
    h = F.xxhash64(text)
    of = lambda k, m: F.pmod(F.xxhash64(F.lit(k), text), m)
    length = F.element_at(F.array(*[F.lit(n) for n in BANDS]), (F.pmod(h, F.lit(len(BANDS))) + 1).cast("int"))
    piece = F.substr(text, (of(1, F.greatest(F.length(text) - 4 * length, F.lit(1))) + 1).cast("int"), 4 * length)
    whole = F.regexp_replace(piece, "^[A-Za-z0-9+/_=-]+|[A-Za-z0-9+/_=-]+$", "")
    slug = F.regexp_replace(F.regexp_replace(whole, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+|[^A-Za-z]", "-"), "-+", "-")

    def joined(d: Column) -> Column:
        part, style = d["slug"], d["style"]
        bare = F.replace(part, F.lit("-"), F.lit(""))
        styled = F.when(style == 0, part).when(style == 1, bare).when(style == 2, F.lower(bare)).when(style == 3, F.upper(bare)).when(style == 4, F.replace(F.initcap(F.replace(part, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))).otherwise(F.lower(F.replace(part, F.lit("-"), F.lit("0"))))
        return F.when(F.length(styled) >= d["length"], F.substr(styled, F.lit(1), d["length"]))

    one = F.struct(slug.alias("slug"), of(2, F.lit(6)).alias("style"), length.alias("length"))
    return F.get(F.transform(F.array(one), joined), F.lit(0))  # in an array, so that it is made once


def _band(length: Column) -> Column:
    return reduce(lambda c, k: F.when(length >= BANDS[k], k).otherwise(c), range(1, len(BANDS)), F.lit(0))


def _cell(evidence: Column) -> Column:
    return F.floor(F.ln(F.greatest(evidence, F.lit(1e-3))) / CELL).cast("int")


def null_chances(tested: DataFrame) -> DataFrame:
    """tested (encoding, band, decoy, evidence) without its decoys, and p: the chance that a decoy comes as near to random.

    The logarithm of the decoys' evidence is taken as normal, with moments that
    begin at the prior; where decoys did come as near, p is at least their share.
    One row for each encoding and band, 20 at most, is broadcast.
    """
    ln, band = F.ln(F.greatest("evidence", F.lit(1e-3))), F.col("band")
    prior = reduce(lambda c, k: F.when(band == k, PRIOR_MEAN[k]).otherwise(c), range(len(BANDS)), F.lit(0.0))
    cells = tested.where("decoy").groupBy("encoding", "band", _cell(F.col("evidence")).alias("cell")).agg(F.count("*").alias("n"), F.sum(ln).alias("s"), F.sum(ln * ln).alias("q"))
    seen = cells.groupBy("encoding", "band").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    rows = tested.where("NOT decoy").join(F.broadcast(seen), ["encoding", "band"], "left").fillna(0, ["n", "s", "q"]).withColumn("prior", prior)
    n = F.col("n") + PRIOR_COUNT
    mean = (F.col("s") + PRIOR_COUNT * F.col("prior")) / n
    square = (F.col("q") + PRIOR_COUNT * (PRIOR_SPREAD**2 + F.col("prior") * F.col("prior"))) / n
    rows = rows.withColumn("mean", mean).withColumn("spread", F.sqrt(F.greatest(square - F.col("mean") * F.col("mean"), F.lit(1e-4))))
    near = F.aggregate(F.filter(F.coalesce("cells", F.array().cast("array<struct<cell:int,n:bigint>>")), lambda c: c["cell"] <= _cell(F.col("evidence"))), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    p = F.greatest(F.exp(-_surprise((F.col("mean") - ln) / F.col("spread"))), near / n)
    return rows.select(*[c for c in tested.columns if c != "decoy"], p.alias("p"))


def step_up(tested: DataFrame, false_share: float) -> DataFrame:
    """(added, band, cutoff): for each family and band the largest bound of p at which the false discoveries expected are at most the share of those made."""
    made = [F.sum(F.when(F.col("p") <= c, 1).otherwise(0)) for c in CUTOFFS]
    sums = tested.groupBy("added", "band").agg(F.count("*").alias("m"), F.array(*[F.struct(F.lit(c).alias("c"), r.alias("r")) for c, r in zip(CUTOFFS, made, strict=True)]).alias("tried"))
    good = F.filter("tried", lambda t: (t["r"] > 0) & (F.col("m") * t["c"] <= false_share * t["r"]))
    return sums.select("added", "band", F.array_max(F.transform(good, lambda t: t["c"])).alias("cutoff"))


def _uncovered(run: Column, spans: str, least: int) -> Column:
    """The parts of a run that no span touches, of so many characters or more, as array<struct<start, stop, value>>; spans are in order."""
    over = F.filter(spans, lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"]))
    kind = "struct<start:int,stop:int,value:string>"
    begin = F.struct(run["start"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def part(at: Column, stop: Column) -> Column:
        value = F.substring(run["value"], at - run["start"] + 1, stop - at)
        return F.when(stop - at >= least, F.array(F.struct(at.alias("start"), stop.alias("stop"), value.alias("value")).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))

    def step(state: Column, b: Column) -> Column:
        return F.struct(F.greatest(state["at"], b["stop"]).alias("at"), F.concat(state["out"], part(state["at"], b["start"])).alias("out"))

    return F.aggregate(over, begin, step, lambda s: F.concat(s["out"], part(s["at"], run["stop"])))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", false_share: float = 0.05) -> DataFrame:
    """doc_id, text_hash, base, spans and verdicts of every row.

    base and spans are array<struct<start, rank, stop, kind>> in order, positions
    code points, the end exclusive. base holds the spans of the patterns; spans adds
    those of the battery, none of which touches a base span: where a run does, what
    is left of it is tested. verdicts, array<struct<start, rank, stop, kind, p,
    random>>, has those base spans whose value (dots left out) has as many characters
    as the battery needs, and whether it is random; of overlapping ones each is
    tested. A text of null or the empty text has no spans; repeated rows get a row
    each; no rows give no rows. Other columns aren't looked at.
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), _OPEN + _CLOSE, _OTHER)
    raw = df.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(text).alias("text_hash"), clean.alias("t"))
    raw = raw.select("doc_id", "rid", "text_hash", _found(F.col("t"), ASSIGN).alias("assign"), _found(F.col("t"), ACCESS).alias("access"), _found(F.col("t"), HEX).alias("hex"), _found(F.col("t"), TOKEN).alias("tokens"), decoy(F.col("t")).alias("decoy"))
    secret = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)

    def named(column: str, value=None) -> Column:  # noqa: ANN001
        kept = F.filter(column, lambda s: F.length(secret(s)) >= 12) if column == "assign" else F.col(column)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(column)).alias("rank"), s["stop"].alias("stop"), (value(s).alias("value") if value else F.lit(column).alias("kind"))))

    base = F.array_sort(F.concat(*[named(k) for k in KINDS[:3]]))
    values = F.concat(named("assign", lambda s: F.replace(secret(s), F.lit("."), F.lit(""))), named("access", lambda s: s["value"]), named("hex", lambda s: s["value"]))
    values = F.filter(values, lambda s: F.length(s["value"]) >= BANDS[0])
    rows = raw.select("doc_id", "rid", "text_hash", base.alias("base"), values.alias("values"), "tokens", "decoy")
    apart = F.flatten(F.transform("tokens", lambda s: _uncovered(s, "base", BANDS[0])))
    rows = materialise(rows.select("doc_id", "rid", "text_hash", "base", "values", apart.alias("tokens"), "decoy"), "scan")

    at = lambda column, rank: rows.select("rid", F.explode(column).alias("s")).select("rid", "s.start", rank, "s.stop", "s.value", F.lit(False).alias("decoy"))
    added = F.lit(KINDS.index("random")).alias("rank")
    made = rows.where("decoy IS NOT NULL").select("rid", F.lit(0).alias("start"), added, F.lit(0).alias("stop"), F.col("decoy").alias("value"), F.lit(True).alias("decoy"))
    tested = at("tokens", added).unionByName(at("values", F.col("s.rank"))).unionByName(made).withColumn("band", _band(F.length("value")))
    for name, column in battery().items():
        tested = tested.withColumn(name, column)
    tested = tested.withColumn("added", F.col("rank") == KINDS.index("random"))
    tested = materialise(tested.select("rid", "start", "rank", "stop", "added", "band", "decoy", "encoding", "evidence"), "tested")
    judged = null_chances(tested)
    judged = judged.join(F.broadcast(step_up(judged, false_share)), ["added", "band"])  # a row for each band of the two families
    judged = judged.withColumn("random", F.coalesce(F.col("p") <= F.col("cutoff"), F.lit(False))).where("random OR NOT added")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1).alias("kind")
    span, verdict = F.struct("start", "rank", "stop", kind), F.struct("start", "rank", "stop", kind, "p", "random")
    more = judged.groupBy("rid").agg(F.collect_list(F.when(F.col("added"), span)).alias("more"), F.array_sort(F.collect_list(F.when(~F.col("added"), verdict))).alias("verdicts"))
    none = lambda more: F.array().cast(f"array<struct<start:int,rank:int,stop:int,kind:string{more}>>")
    spans = F.array_sort(F.concat("base", F.coalesce("more", none(""))))
    return rows.join(more, "rid", "left").select("doc_id", "text_hash", "base", spans.alias("spans"), F.coalesce("verdicts", none(",p:double,random:boolean")).alias("verdicts"))


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of a secret replaced by the mark; all rows and columns stay.

    Rows without a secret, null texts among them, stay byte for byte as they are.
    Where secrets overlap, one mark stands for their union. A column n_chars, if
    there is one, follows the text. Spans are joined back by key and a hash of the
    text, so rows that share a key, or have none, each get their own. Very long and
    repeated texts are as any other; no rows give no rows; names that begin with
    seqweave_ are kept for the operator.
    """
    hits = scan(df, key, text).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("seqweave_id"), F.col("text_hash").alias("seqweave_hash")).agg(F.first("spans").alias("seqweave_spans"))
    joined = df.join(hits, F.col(key).eqNullSafe(F.col("seqweave_id")) & (F.xxhash64(text) == F.col("seqweave_hash")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.when(s["start"] > state["at"], F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])).otherwise(F.lit(""))
        inside = s["start"] < state["at"]
        out = F.when(inside, state["out"]).otherwise(F.concat(state["out"], before, F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    done = F.aggregate("seqweave_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))))
    joined = joined.withColumn("seqweave_new", F.when(F.col("seqweave_spans").isNotNull() & F.col(text).isNotNull(), done).otherwise(F.col(text)))
    columns = [F.col("seqweave_new").alias(c) if c == text else F.when(F.col("seqweave_spans").isNotNull() & F.col(text).isNotNull(), F.length("seqweave_new").cast(dict(df.dtypes)[c])).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in df.columns]
    return joined.select(*columns)
