"""Language models as tables, scoring of sequences and mappings, recall of decodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import bigrams, ngrams, null_strata, tokens
from seqweave.functions.tables import written
from seqweave.operators.measures import stream_ngram_counts, with_totals

START, END, FLOOR = "<BOW>", "<EOW>", 1e-8


def bounded(seq: DataFrame) -> DataFrame:
    return seq.withColumn("symbols", F.concat(F.array(F.lit(START)), "symbols", F.array(F.lit(END))))


def model(seq: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, gram, cnt, p): unigrams with p over tokens; bigrams within sequences and their bounds with p of b after a; first and last symbols."""
    s = seq.select(*by, "symbols")
    uni = s.select(*by, F.explode("symbols").alias("gram")).withColumn("kind", F.lit("unigram")).withColumn("given", F.lit(""))
    bi = bigrams(bounded(s)).select(*by, F.concat_ws(" ", "a", "b").alias("gram"), F.lit("bigram").alias("kind"), F.col("a").alias("given"))
    first = s.where("size(symbols) > 0").select(*by, F.get("symbols", F.lit(0)).alias("gram"), F.lit("initial").alias("kind"), F.lit("").alias("given"))
    last = s.where("size(symbols) > 0").select(*by, F.element_at("symbols", -1).alias("gram"), F.lit("final").alias("kind"), F.lit("").alias("given"))
    c = uni.unionByName(bi).unionByName(first).unionByName(last).groupBy(*by, "kind", "given", "gram").agg(F.count("*").alias("cnt"))
    return c.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by, "kind", "given"))).select(*by, "kind", "gram", "cnt", "p")


@null_strata
def stream_model(seq: DataFrame, by: list[str], order: str = "seq_id") -> DataFrame:
    """(by, n, gram, cnt, p): bigrams and trigrams of the flat stream of each group, p over all of their length."""
    c = stream_ngram_counts(seq, 1, 3, by, order)
    return with_totals(c, c.groupBy(*by, "n").agg(F.sum("cnt").alias("total")), [*by, "n"]).select(*by, "n", "gram", "cnt", (F.col("cnt") / F.col("total")).alias("p"))


def score_stream(seq: DataFrame, model_: DataFrame, least_tokens: int = 1000) -> DataFrame:
    """Log-likelihood of each sequence's own pairs under a stream model; with .1 of its triples' if the model has enough tokens."""
    grams_ = ngrams(seq.select("seq_id", "symbols"), 2, 3).select("seq_id", "n", "gram")
    j = grams_.join(model_.select("n", "gram", "p"), ["n", "gram"], "left").withColumn("lp", F.ln(F.coalesce("p", F.lit(FLOOR))))
    g = j.groupBy("seq_id").agg(F.sum(F.when(F.col("n") == 2, F.col("lp")).otherwise(0.0)).alias("two"), F.sum(F.when(F.col("n") == 3, F.col("lp")).otherwise(0.0)).alias("three"), F.max("n").alias("most"))
    size = model_.where("n = 1").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("size"))
    g = g.crossJoin(F.broadcast(size))  # one row
    return g.select("seq_id", F.when((F.col("size") >= least_tokens) & (F.col("most") > 2), 0.9 * F.col("two") + 0.1 * F.col("three")).otherwise(F.col("two")).alias("ll"))


def word_statistics(seq: DataFrame, by: list[str]) -> DataFrame:
    """Pairs within sequences and the share of them that repeat a symbol."""
    p = bigrams(seq.select(*by, "symbols"))
    return p.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("repeat_rate"))


@null_strata
def together(seq: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, p): the share of sequences of two symbols or more that hold both a < b."""
    s = seq.where("size(symbols) >= 2").select(*by, F.array_sort(F.array_distinct("symbols")).alias("u"))
    pairs = F.flatten(F.transform("u", lambda x, i: F.transform(F.slice("u", i + 2, F.size("u")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    c = s.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.a", "p.b").agg(F.count("*").alias("cnt"))
    return with_totals(c, s.groupBy(*by).agg(F.count("*").alias("n")), by).select(*by, "a", "b", (F.col("cnt") / F.col("n")).alias("p"))


def positional(seq: DataFrame, by: list[str]) -> DataFrame:
    """Shares of initial, medial and terminal places of each symbol in sequences of two or more."""
    t = tokens(seq.where("size(symbols) >= 2").select(*by, "symbols"))
    n = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    first, last = F.col("pos") == 0, F.col("pos") == F.col("len") - 1
    return t.groupBy(*by, "sym").agg(n(first).alias("initial"), n(~first & ~last).alias("medial"), n(last).alias("terminal"))


def score(seq: DataFrame, lm: DataFrame) -> DataFrame:
    """Log-likelihood of each sequence with its bounds: sum of ln p, unseen pairs at the floor."""
    pairs = bigrams(bounded(seq.select("seq_id", "symbols"))).select("seq_id", F.concat_ws(" ", "a", "b").alias("gram"))
    p = lm.where("kind = 'bigram'").select("gram", "p")
    return pairs.join(p, "gram", "left").groupBy("seq_id").agg(F.sum(F.ln(F.coalesce("p", F.lit(FLOOR)))).alias("ll"), F.count("*").alias("pairs"))


def score_mappings(seq: DataFrame, mappings: DataFrame, lm: DataFrame) -> DataFrame:
    """Log-likelihood of the decoded corpus under each mapping (run_id, sym, value): from bigram counts, whatever the corpus's length."""
    c = bigrams(seq.select("symbols")).groupBy("a", "b").agg(F.count("*").alias("cnt"))
    x = c.join(mappings.select("run_id", F.col("sym").alias("a"), F.col("value").alias("va")), "a").join(mappings.select("run_id", F.col("sym").alias("b"), F.col("value").alias("vb")), ["run_id", "b"])
    p = lm.where("kind = 'bigram'").select("gram", "p")
    return x.withColumn("gram", F.concat_ws(" ", "va", "vb")).join(p, "gram", "left").groupBy("run_id").agg(F.sum(F.col("cnt") * F.ln(F.coalesce("p", F.lit(FLOOR)))).alias("ll"))


def score_mappings_fully(seq: DataFrame, mappings: DataFrame, target: DataFrame, positional_weight: float = 0.005, repeat_weight: float = 0.0, together_weight: float = 0.0) -> DataFrame:
    """Scores of all mappings (run_id, sym, value) at once: (run_id, ll, positional, repeats, together, score).

    ll is the log-likelihood of the decoded sequences with their bounds under
    target's model, symbols without a value being unseen. Then, each in proportion
    to the size of the score so far: the agreement of symbols' and values' places is
    added, the share of pairs that repeat a value beyond target's is taken off, and
    the mean log share of target sequences that hold a decoded pair (1e-4 if none)
    is added. Everything comes from counts of pairs, places and distinct sets of
    symbols, so the corpus is read for those alone, however many mappings there are.
    Sequences without symbols count as nothing; a run of null is left out.
    """
    m = written(mappings.where("run_id IS NOT NULL AND sym IS NOT NULL AND value IS NOT NULL").select("run_id", "sym", "value").distinct(), "mappings")
    s, to = seq.where("size(symbols) > 0").select("symbols"), target.where("size(symbols) > 0").select("symbols")
    own = lambda end: m.select("run_id", F.col("sym").alias(end), F.col("value").alias(f"v{end}"))
    marks = m.select("run_id").distinct().withColumn("value", F.explode(F.array(F.lit(START), F.lit(END)))).select("run_id", F.col("value").alias("sym"), "value")
    known = m.unionByName(marks)
    end = lambda c: known.select("run_id", F.col("sym").alias(c), F.col("value").alias(f"v{c}"))
    pairs = written(bigrams(bounded(s)).groupBy("a", "b").agg(F.count("*").alias("cnt")), "pairs")
    p = model(to, []).where("kind = 'bigram'").select("gram", "p")
    decoded = pairs.join(end("a"), "a").join(end("b"), ["run_id", "b"]).withColumn("gram", F.concat_ws(" ", "va", "vb")).join(p, "gram", "left")
    two = decoded.groupBy("run_id").agg(F.sum(F.col("cnt") * F.ln(F.coalesce("p", F.lit(FLOOR)))).alias("lp"), F.sum("cnt").alias("known"))
    all_pairs = pairs.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("all"))
    # pairs without the bounds: equal values, or neither symbol with one
    inner = pairs.where((F.col("a") != START) & (F.col("b") != END))
    met = inner.join(own("a"), "a").join(own("b"), ["run_id", "b"]).groupBy("run_id").agg(F.sum(F.when(F.col("va") == F.col("vb"), F.col("cnt")).otherwise(0)).alias("same"), F.sum("cnt").alias("both"))
    side = lambda c, name: inner.join(own(c), c).groupBy("run_id").agg(F.sum("cnt").alias(name))
    all_inner = inner.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("inner"))
    base = word_statistics(to, []).agg(F.coalesce(F.max("repeat_rate"), F.lit(0.0)).alias("base"))
    places = positional(s, []).join(m, "sym").join(positional(to, []).select(F.col("sym").alias("value"), *[F.col(c).alias(f"t_{c}") for c in ("initial", "medial", "terminal")]), "value")
    places = places.groupBy("run_id").agg(F.sum(sum((F.col(c) * F.col(f"t_{c}") for c in ("initial", "medial", "terminal")), F.lit(0.0))).alias("positional"))
    sets = s.where("size(symbols) >= 2").groupBy(F.array_sort(F.array_distinct("symbols")).alias("u")).agg(F.count("*").alias("cnt"))
    values = sets.select("u", "cnt", F.explode("u").alias("sym")).join(m, "sym").groupBy("run_id", "u", "cnt").agg(F.array_sort(F.collect_set("value")).alias("v"))
    each = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    near = values.select("run_id", "cnt", F.explode(each).alias("p")).select("run_id", "cnt", "p.a", "p.b").groupBy("run_id", "a", "b").agg(F.sum("cnt").alias("cnt"))
    near = near.join(together(to, []), ["a", "b"], "left").groupBy("run_id").agg((F.sum(F.col("cnt") * F.ln(F.coalesce("p", F.lit(1e-4)))) / F.sum("cnt")).alias("together"))
    x = m.select("run_id").distinct()
    for part in (two, met, side("a", "left"), side("b", "right"), places, near):
        x = x.join(part, "run_id", "left")
    x = x.fillna(0).crossJoin(F.broadcast(all_pairs)).crossJoin(F.broadcast(all_inner)).crossJoin(F.broadcast(base))  # one row each
    ll = F.col("lp") + (F.col("all") - F.col("known")) * F.ln(F.lit(FLOOR))
    again = (F.col("same") + F.col("inner") - F.col("left") - F.col("right") + F.col("both")) / F.nullif(F.col("inner"), F.lit(0))
    x = x.select("run_id", ll.alias("ll"), "positional", F.greatest(F.coalesce(again, F.lit(0.0)) - F.col("base"), F.lit(0.0)).alias("repeats"), "together")
    x = x.withColumn("score", F.col("ll") + F.col("positional") * F.abs("ll") * positional_weight)
    x = x.withColumn("score", F.col("score") - repeat_weight * F.col("repeats") * F.abs("score"))
    return x.withColumn("score", F.col("score") + together_weight * F.col("together") * F.abs("score"))


def consistency(mappings: DataFrame) -> DataFrame:
    """Modal value of each symbol over runs, its share, the top three."""
    n = mappings.groupBy("sym", "value").agg(F.count("*").alias("cnt")).withColumn("runs", F.sum("cnt").over(Window.partitionBy("sym")))
    k = n.withColumn("k", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("cnt"), "value"))).where("k <= 3")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", "value", F.col("cnt").cast("string")).alias("s")))), lambda v: v["s"]), ",")
    return k.groupBy("sym").agg(F.min_by("value", "k").alias("value"), (F.max(F.when(F.col("k") == 1, F.col("cnt"))) / F.first("runs")).alias("share"), top.alias("top"))


def accuracy(mappings: DataFrame, key: DataFrame) -> DataFrame:
    """Share of the key's symbols mapped rightly in each run; unmapped ones count as wrong."""
    n = key.agg(F.count("*").alias("n"))
    hit = mappings.join(key.select("sym", "answer"), "sym").where("value = answer").groupBy("run_id").agg(F.count("*").alias("right"))
    runs = mappings.select("run_id").distinct().join(hit, "run_id", "left").fillna(0, ["right"])
    return runs.join(F.broadcast(n)).select("run_id", "right", (F.col("right") / F.col("n")).alias("accuracy"))  # n is one row


def agreement(mappings: DataFrame) -> DataFrame:
    """Pairs of runs: shared symbols, those with one value, by a join on the symbol."""
    x, y = (mappings.select(F.col("run_id").alias(f"run_{k}"), "sym", F.col("value").alias(f"v{k}")) for k in "ab")
    return x.join(y, "sym").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("shared"), F.avg(F.when(F.col("va") == F.col("vb"), 1.0).otherwise(0.0)).alias("same"))


def decode(seq: DataFrame, mapping: DataFrame) -> DataFrame:
    """(seq_id, decoded, mapped, len): values of mapped symbols in order."""
    t = tokens(seq.select("seq_id", "symbols")).join(mapping.select("sym", "value"), "sym", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))))
    return t.groupBy("seq_id").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("decoded"), F.count("value").alias("mapped"), F.max("len").cast("long").alias("len"))


def recall(decoded: DataFrame, vocabulary: DataFrame, least: int = 1) -> DataFrame:
    """Words of the vocabulary that are decoded somewhere: hits, words, rate."""
    d = decoded.select(F.lower("decoded").alias("word")).where(F.length("word") >= least).distinct()
    v = vocabulary.select(F.lower("word").alias("word")).distinct()
    x = v.join(d.withColumn("hit", F.lit(1)), "word", "left").agg(F.count("hit").alias("hits"), F.count("*").alias("words"))
    return x.withColumn("rate", F.col("hits") / F.col("words"))


def internal_consistency(seq: DataFrame, decoded: DataFrame) -> DataFrame:
    """Repeated sequences, and how many of them have one decoding."""
    g = seq.select("seq_id", "symbols").join(decoded, "seq_id").groupBy("symbols").agg(F.count("*").alias("n"), F.count_distinct("decoded").alias("forms")).where("n > 1")
    return g.agg(F.count("*").alias("repeated"), F.sum(F.when(F.col("forms") == 1, 1).otherwise(0)).alias("consistent"))


def clipped_recall(hypothesis: DataFrame, reference: DataFrame) -> DataFrame:
    """Sum of min(count, count) over n-grams of both, over the reference's; (n, gram, cnt) tables."""
    j = reference.join(hypothesis.withColumnRenamed("cnt", "h"), ["n", "gram"], "left")
    return j.groupBy("n").agg((F.sum(F.least("cnt", F.coalesce("h", F.lit(0)))) / F.sum("cnt")).alias("recall"))


def substring_matches(seq: DataFrame, vocabulary: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Vocabulary words (symbols joined by spaces) met as substrings of sequences: counts."""
    return ngrams(seq.select("symbols"), least, most).groupBy("gram").agg(F.count("*").alias("cnt")).join(vocabulary.select(F.col("word").alias("gram")).distinct(), "gram")


def anchors(seq: DataFrame, k: int) -> DataFrame:
    """The k most frequent symbols."""
    c = seq.select(F.explode("symbols").alias("sym")).groupBy("sym").agg(F.count("*").alias("cnt"))
    return c.orderBy(F.desc("cnt"), "sym").limit(k)


def class_runs(seq: DataFrame, classes: DataFrame, cut: int = 6, least: int = 2) -> DataFrame:
    """Maximal runs of one class within sequences, cut at so many symbols: (seq_id, class, start, word)."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    t = tokens(seq.select("seq_id", "symbols")).join(classes.select("sym", "class"), "sym")
    t = t.withColumn("new", F.when((F.lag("class").over(w) == F.col("class")) & (F.lag("pos").over(w) == F.col("pos") - 1), 0).otherwise(1))
    t = t.withColumn("run", F.sum("new").over(w))
    t = t.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("seq_id", "run").orderBy("pos")) - 1) / cut))
    g = t.groupBy("seq_id", "run", "part", "class").agg(F.min("pos").alias("start"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]), " ").alias("word"))
    return g.where(F.col("n") >= least).select("seq_id", "class", "start", "n", "word")

