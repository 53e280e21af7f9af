"""Vocabularies against sequences, and candidate words with readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqweave.functions.exprs import ngrams
from seqweave.functions.tables import written
from seqweave.operators.lm import class_runs


def forms(seq: DataFrame, least: int = 2, most: int = 5, separator: str = " ") -> DataFrame:
    """(word, cnt, whole): all distinct forms of a corpus, its sequences and their parts of so many symbols.

    cnt counts the parts, whole the sequences that are the form; sequences of null
    or without symbols have none, null symbols are skipped in a form. Parts are
    counted before they are shuffled.
    """
    s = seq.where("size(symbols) > 0")
    parts = ngrams(s.select("symbols"), least, most, joined=False).groupBy(F.array_join("gram", separator).alias("word")).agg(F.count("*").alias("cnt"))
    whole = s.groupBy(F.array_join("symbols", separator).alias("word")).agg(F.count("*").alias("whole"))
    return parts.join(whole, "word", "full").fillna(0, ["cnt", "whole"])


def word_matches(seq: DataFrame, vocabulary: DataFrame, least: int = 2, most: int = 5, separator: str = " ") -> DataFrame:
    """(word, meaning, length, cnt, whole): words of the vocabulary that occur as whole sequences or as parts of them.

    vocabulary has word and meaning; of a word that is listed more than once the
    smallest meaning stays, words of null go. length is in symbols of the corpus.
    """
    v = vocabulary.where("word IS NOT NULL").groupBy("word").agg(F.min("meaning").alias("meaning"))
    found = forms(seq, least, most, separator).join(v, "word")
    return found.select("word", "meaning", F.size(F.split("word", _literal(separator))).alias("length") if separator else F.length("word").alias("length"), "cnt", "whole")


def word_coverage(seq: DataFrame, vocabulary: DataFrame, least: int = 2, most: int = 5, separator: str = " ") -> DataFrame:
    """One row: matches, forms checked, words of the vocabulary, coverage = matches / words (0 for an empty vocabulary)."""
    v = vocabulary.where("word IS NOT NULL").select("word").distinct().withColumn("known", F.lit(1))
    f = forms(seq, least, most, separator).select("word").withColumn("met", F.lit(1))
    n = f.join(v, "word", "full").agg(F.count(F.expr("CASE WHEN known = 1 AND met = 1 THEN 1 END")).alias("matches"), F.count("met").alias("checked"), F.count("known").alias("words"))
    return n.withColumn("coverage", F.col("matches") / F.greatest("words", F.lit(1)))


def candidate_words(seq: DataFrame, classes: DataFrame, readings: DataFrame, vocabulary: DataFrame, wanted: str, cut: int = 6, least: int = 2, bonus: float = 2.0) -> DataFrame:
    """(word, reading, n, occurrences, confidence, known, meaning, score): runs of one class, read and looked up.

    Runs of symbols of the class `wanted`, cut at so many symbols, each once;
    readings has sym, reading and confidence. A symbol without a reading reads `?`
    with confidence 0; of several readings the surest stays, ties go to the
    smallest. score is the mean confidence, times bonus for a word of the
    vocabulary. Readings are joined to each distinct run, not to each token.
    """
    runs = class_runs(seq, classes.where(F.col("class") == wanted), cut, least)
    runs = written(runs.groupBy("word", "n").agg(F.count("*").alias("occurrences")), "runs")
    best = Window.partitionBy("sym").orderBy(F.desc_nulls_last("confidence"), "reading")
    r = readings.where("reading IS NOT NULL").withColumn("_k", F.row_number().over(best)).where("_k = 1").select("sym", "reading", F.coalesce("confidence", F.lit(0.0)).alias("sure"))
    each = runs.select("word", F.posexplode(F.split("word", " ")).alias("at", "sym")).join(r, "sym", "left")
    part = F.struct("at", F.coalesce("reading", F.lit("?")).alias("reading"))
    read = each.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["reading"]), "").alias("reading"), F.avg(F.coalesce("sure", F.lit(0.0))).alias("confidence"))
    v = vocabulary.where("word IS NOT NULL").groupBy(F.col("word").alias("reading")).agg(F.min("meaning").alias("meaning"), F.lit(True).alias("known"))
    out = runs.join(read, "word").join(v, "reading", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return out.select("word", "reading", "n", "occurrences", "confidence", "known", "meaning", F.when(F.col("known"), F.col("confidence") * bonus).otherwise(F.col("confidence")).alias("score"))


def boundary_coherence(decoded: DataFrame, target: DataFrame, by: list[str], floor: float = 1e-8) -> DataFrame:
    """(by, coherence, scored): mean log-probability of the symbol pairs within decoded words under a target's pairs.

    target has a, b and p; pairs that it lacks count as floor. Groups without a
    pair have coherence 0. Pairs are counted before they meet the target.
    """
    from seqweave.functions.exprs import bigrams

    c = bigrams(decoded.select(*by, "symbols")).groupBy(*by, "a", "b").agg(F.count("*").alias("cnt")).join(target.select("a", "b", "p"), ["a", "b"], "left")
    c = c.groupBy(*by).agg((F.sum(F.col("cnt") * F.ln(F.coalesce("p", F.lit(floor)))) / F.sum("cnt")).alias("coherence"), F.sum("cnt").alias("scored"))
    if not by:
        return c.fillna(0)
    return decoded.select(*by).distinct().join(c, by, "left").fillna(0, ["coherence", "scored"])


def mapping_agreement(mappings: DataFrame) -> DataFrame:
    """(run_a, run_b, shared, same, share, keys): symbols two runs share, those with one value, that share, and the Jaccard index of their symbols.

    Rows with a null in run, symbol or value are left out, repeated rows count once;
    a run that gives a symbol two values takes the smaller. The pairs of runs are
    few; runs that share no symbol are listed with zeros.
    """
    m = mappings.where("run_id IS NOT NULL AND sym IS NOT NULL AND value IS NOT NULL").groupBy("run_id", "sym").agg(F.min("value").alias("value"))
    m = written(m, "mappings")
    n = written(m.groupBy("run_id").agg(F.count("*").alias("n")), "runs")
    x, y = (m.select(F.col("run_id").alias(f"run_{k}"), "sym", F.col("value").alias(f"v{k}")) for k in "ab")
    met = x.join(y, "sym").where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("shared"), F.sum(F.when(F.col("va") == F.col("vb"), 1).otherwise(0)).alias("same"))
    p, q = (n.select(F.col("run_id").alias(f"run_{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = p.join(q, F.col("run_a") < F.col("run_b")).join(met, ["run_a", "run_b"], "left").fillna(0)
    share = F.col("same") / F.greatest("shared", F.lit(1))
    return pairs.select("run_a", "run_b", "shared", "same", share.alias("share"), (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("keys"))


def unanimous(mappings: DataFrame, high: float = 0.75) -> DataFrame:
    """One row: symbols, those that two runs or more map, those that all of these map to one value, and those whose modal value has a share of `high` or more."""
    m = mappings.where("run_id IS NOT NULL AND sym IS NOT NULL AND value IS NOT NULL").groupBy("run_id", "sym").agg(F.min("value").alias("value"))
    s = m.groupBy("sym", "value").agg(F.count("*").alias("cnt")).groupBy("sym").agg(F.max("cnt").alias("top"), F.sum("cnt").alias("runs"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    two = F.col("runs") >= 2
    return s.agg(F.count("*").alias("symbols"), n(two).alias("compared"), n(two & (F.col("top") == F.col("runs"))).alias("unanimous"), n(F.col("top") >= high * F.col("runs")).alias("high"))


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"
