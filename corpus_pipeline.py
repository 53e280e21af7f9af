"""A pipeline over documents: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm import jaccard, mixing, secrets, toxicity
from seqweave.llm.common import join_small, materialise, prepare, table
from seqweave.llm.queries import packed

#: Near duplicates: five words and a similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80
#: Mean repetitions of a source's documents at most: small sources must not become many copies of few texts.
MOST_REPEATS = 4.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, repeated rows alike; texts of null or without words are scored as empty ones."""
    prepare(spark)
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id; repeated rows of it count as its group too.

    Documents without words, and rows with a doc_id of null, are in no group and stay.
    """
    prepare(spark)
    found = jaccard.similar_documents(docs, n=SHINGLE_WORDS, percent=PERCENT).where("n_shingles > 0 AND doc_id IS NOT NULL")
    told = found.groupBy("doc_id").agg(F.max(F.expr("doc_id <> component_id")).alias("gone"), F.expr("count_if(doc_id = component_id)").alias("n"))
    told = materialise(told.where("gone OR n > 1"), "told")
    again = told.where("n > 1").select("doc_id")
    kept = join_small(docs, told.where("gone").select("doc_id"), ["doc_id"], jaccard.MOST_IDS, "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; texts of null stay null, repeated rows stay apart."""
    prepare(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, in a global random order.

    A source's documents are repeated four times on average at most; the weight
    that small sources can't take goes to the others. Texts of null or without
    characters follow their source; a source of such texts alone goes. Columns of
    other names than those of documents stay as they are.
    """
    prepare(spark)
    return mixing.mix(docs, detail=False, most_repeats=MOST_REPEATS).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens.

    A text of null is empty, its piece the end id alone; repeated rows are packed
    each; columns besides doc_id and text are dropped.
    """
    prepare(spark)
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
