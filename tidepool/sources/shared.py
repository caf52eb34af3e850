"""A folder for files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where driver and executors are one machine may that be unset; then it
    is a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidepool-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidepool/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{scratch(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `size` bytes, a row at least: what a task holds as Python objects at a time
    does not follow the rows of a batch. A batch without rows gives nothing."""
    for batch in batches:
        step = max(batch.num_rows * size // max(batch.nbytes, 1), 1)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _at(spark: SparkSession, path: str):
    """Hadoop's path and the file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    where, files = _at(spark, path)
    files.delete(where, True)
