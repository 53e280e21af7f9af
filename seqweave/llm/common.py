"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.functions.tables import shuffles_removed

#: Rows and bytes of text that one Arrow batch holds: long texts must not pile up in a Python worker.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}

_made_here: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps their batches of text small.

    Sizes of batches are read from the session when a query runs, so they are set
    there; one that the user has set to another value than Spark's default stays.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, (default, small) in TEXT_BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, small)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session has none and all runs in one process (tests in local
    mode) is a folder made here; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made_here:
        _made_here[app] = "file://" + tempfile.mkdtemp(prefix="spark-seqweave-")
    return _made_here[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/seqweave-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again.

    This cuts the lineage in a way that survives lost executors, and work that
    several branches need is done once. Shuffle files go with the write.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies fn to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; an id of null counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(df: DataFrame, small: DataFrame, on: list[str], max_rows: int = 20_000, how: str = "left") -> DataFrame:
    """Joins a table of groups, broadcast only when a count shows that it is small.

    Beyond max_rows it is an ordinary join, whose hot keys adaptive execution splits.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return df.join(small, on, how)
