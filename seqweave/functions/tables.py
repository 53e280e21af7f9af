"""Intermediate tables, written where driver and executors both see them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made_here: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where all runs in one process (local mode) and none is set, a folder made here. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made_here:
        _made_here[app] = "file://" + tempfile.mkdtemp(prefix="spark-seqweave-")
    return _made_here[app]


#: Lets Spark (4.1 and later, others ignore it) remove a query's shuffle files at its end, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go with them: for writes, whose results are read from what they wrote."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df, written as Parquet and read again.

    What several branches need is computed once, lineage is cut so that lost
    executors cost little, and the planner knows the table's size: a small one is
    broadcast in joins, one beyond the session's threshold isn't. Shuffle files go with the write.
    """
    path = f"{shared_folder(df.sparkSession)}/seqweave-{tag}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
