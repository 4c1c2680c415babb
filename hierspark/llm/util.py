"""Small helpers that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir.  Where that is unset, as in tests, a temporary folder becomes the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows does not depend on the executors that made it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on this session exchanges Arrow batches of about this size with Python, unless it has a setting of its own.

    Else a batch is up to 10,000 rows: texts of some kilobytes with their ids then fill hundreds of MB on both sides of every running task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL for a NULL key."""
    return F.crc32(key.cast("string")) % n


def pieces(batches: Iterator[pa.RecordBatch], text: int, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose texts hold about ``chars`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
        group = np.maximum(np.cumsum(sizes) - sizes, 0) // chars
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            yield batch.slice(begin, end - begin)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast where the table is counted to have at most ``rows`` rows; a shuffle join gives the same result beyond it."""
    return F.broadcast(df) if df.count() <= rows else df


def local_copy(name: str, content: bytes) -> str:
    """A driver-side file of this content, for SparkContext.addFile."""
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "wb") as out:
        out.write(content)
    return path


def next_ids(ids: DataFrame) -> DataFrame:
    """(_id, _next): each distinct id with the next larger one, the largest with the smallest.

    Ids are range-partitioned and looked at range by range, whatever values they have; only the first ids of the ranges, one
    row a partition, meet in one task.
    """
    ranges = stored(ids.select("_id").distinct().repartitionByRange("_id").withColumn("_p", F.spark_partition_id()), "ids")
    first = ranges.groupBy("_p").agg(F.min("_id").alias("_first"))
    after = first.select("_p", F.lead("_first").over(Window.orderBy("_p")).alias("_after"))
    start = ranges.agg(F.min("_id")).scalar()
    inner = ranges.withColumn("_own", F.lead("_id").over(Window.partitionBy("_p").orderBy("_id")))
    return inner.join(F.broadcast(after), "_p").select("_id", F.coalesce("_own", "_after", start).alias("_next"))
