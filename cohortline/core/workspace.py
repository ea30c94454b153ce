"""Shared scratch space for tables that must be computed once.

A table that feeds several later passes is written to Parquet in the folder the
cluster names in ``spark.checkpoint.dir`` and read back. That cuts the lineage,
survives the loss of executors, and gives the planner real file sizes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; a temporary one only on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder all executors can reach"
        )
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortline-"))
    return context.getCheckpointDir()


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables stored inside the block when it ends.

    Results must be written before that: a DataFrame that reads a removed table fails.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


#: Spark then removes the shuffle files of a query when it ends, not when the driver happens to
#: collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows sent to a Python worker at once: by default whole partitions of long texts are.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Settings for queries that run inside the block: short-lived shuffles, small batches."""
    before = {key: spark.conf.get(key, None) for key in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and return the stored table.

    The shuffle files of that write go when it ends: later passes read the table.
    """
    path = f"{scratch_dir(df.sparkSession)}/cohortline/{name}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    with frugal(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
