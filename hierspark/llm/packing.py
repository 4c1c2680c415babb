"""Packing by power-of-two decomposition: no padding, and no sequence crosses documents.

The ids of a document, with the end id behind them, are cut into pieces of the lengths that the binary form of their
number gives: as many pieces of the longest length as fit, then at most one of each smaller power of two, in falling
order.  A piece is a sequence of its own.  Sequences of equal length share a bucket, so a batch is drawn from one bucket
and needs no padding.

The buckets are Parquet folders ``length=...`` below one path.  A row holds what task wrote it and its number in the task's
bucket; sequence ids follow from the tasks' counts alone: dense from 0, longest bucket first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hierspark.llm.byte_bpe import encoder
from hierspark.llm.util import broadcast_up_to, pieces, texts_of

BROADCAST_COUNTS = 500_000
STORED = "doc_id bigint, start bigint, doc_tokens bigint, ids binary, part int, nth bigint, length int"


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids, for a longest length that is a power of two."""
    found = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at, size = len(found) * longest, longest >> 1
    while size:
        if n - at >= size:
            found.append((at, size))
            at += size
        size >>= 1
    return found


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, longest: int) -> Iterator[pa.RecordBatch]:
    codes, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
    written: dict[int, int] = {}
    for batch in pieces(batches, 1):
        rows: list[tuple] = []
        for key, ids in zip(batch.column(0).to_pylist(), codes.encode(texts_of(batch, 1))):
            for start, length in cuts(len(ids) // 4, longest):
                nth = written.get(length, 0)
                written[length] = nth + 1
                rows.append((key, start, len(ids) // 4, ids[4 * start : 4 * (start + length)], part, nth, length))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names=["doc_id", "start", "doc_tokens", "ids", "part", "nth", "length"])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Cut all documents into pieces and write them by bucket below ``folder``.

    ``tokenizer`` is a file that every machine has.  A NULL or empty text is one piece, the end id alone.  Every row is a
    document of its own, so repeated rows give their pieces each, and rows with a NULL id keep it.  Documents of any length
    are cut whole.  Other columns are ignored; an empty table gives no piece.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"the longest length must be a power of two, not {longest}")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    cut = rows.mapInArrow(lambda batches: _cut(batches, tokenizer, end_id, longest), STORED)
    cut.write.partitionBy("length").option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All sequences: (doc_id, start, length, ids, doc_tokens, sequence_id, offset), ``ids`` as little-endian 32-bit numbers.

    The counts are one row for each task and bucket; a bucket's tasks are numbered in a window of their own.
    """
    stored = spark.read.schema(STORED).parquet(folder)
    counts = stored.groupBy("length", "part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("_n").alias("_all"))
    # one row a bucket: no more buckets than bits in the longest length
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = totals.select("length", F.coalesce(F.sum("_all").over(longer), F.lit(0)).alias("_bucket"))
    firsts = counts.withColumn("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(buckets), "length")
    firsts = broadcast_up_to(firsts.select("length", "part", (F.col("_bucket") + F.col("_task")).alias("_first")), BROADCAST_COUNTS)
    return stored.join(firsts, ["length", "part"]).select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids", "doc_tokens", (F.col("_first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
