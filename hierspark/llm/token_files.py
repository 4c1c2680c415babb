"""Token ids in binary files: each document a zstandard frame of its own, with one dictionary for all.

A shard file holds the documents of one range of keys:

    magic "TIDS", version, dictionary digest (xxhash64 of its bytes)
    frames: little-endian unsigned 32-bit ids, compressed with the shared dictionary
    index: keys int64[n], offsets uint64[n + 1], ids uint64[n]
    number of documents n, magic

The dictionary is a file beside the shards, named by its digest.  Any document can be read by one seek.
A shard is written under a temporary name and renamed, so a repeated task leaves the same file.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hierspark.llm.byte_bpe import encoder
from hierspark.llm.util import pieces, texts_of

MAGIC, VERSION = b"TIDS", 2
HEAD = struct.Struct("<4sIQ")
TAIL = struct.Struct("<Q4s")
SAMPLE_CHARS = 1 << 16


def digest(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content)


def train_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A dictionary from serialized id arrays; empty where the samples are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, dictionary: bytes, level: int) -> Iterator[pa.RecordBatch]:
    files, root = filesystem(folder)
    codes, squeeze = encoder(tokenizer, end_id), compressor(dictionary, level)
    shard = TaskContext.get().partitionId()
    keys, offsets, sizes = [], [HEAD.size], []
    temporary, final = f"{root}/{uuid.uuid4().hex}.part", f"{root}/shard-{shard:06d}.tids"
    out = None
    for batch in pieces(batches, 1):
        if out is None:
            out = files.open_output_stream(temporary)
            out.write(HEAD.pack(MAGIC, VERSION, digest(dictionary)))
        for ids in codes.encode(texts_of(batch, 1)):
            offsets.append(offsets[-1] + out.write(squeeze.compress(ids)))
            sizes.append(len(ids) // 4)
        keys += batch.column(0).to_pylist()
    if out is None:
        return
    out.write(np.array(keys, "<i8").tobytes() + np.array(offsets, "<u8").tobytes() + np.array(sizes, "<u8").tobytes() + TAIL.pack(len(keys), MAGIC))
    out.close()
    files.move(temporary, final)
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"shard-{shard:06d}.tids"], "docs": pa.array([len(keys)], pa.int64()), "ids": pa.array([sum(sizes)], pa.int64())})


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", dictionary_sample: int = 1000, level: int = 3) -> DataFrame:
    """Write all documents in ascending key order; return the shards (shard, file, docs, ids, start).

    ``dictionary_sample`` bounds (in expectation) the documents, taken by the hash of their key, that train the dictionary;
    documents of over 65,536 characters do not train it.
    Keys are whole numbers; rows with a NULL key cannot be placed and are left out.  NULL texts are empty documents: the end
    id alone.  Repeated keys are neighbours, ordered by text.  An empty table makes no shard.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, dictionary_sample / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < math.ceil((1 << 30) * share)).where(F.length("text") <= SAMPLE_CHARS).select("text").collect()
    dictionary = train_dictionary(encoder(tokenizer, end_id).encode([r["text"] for r in sample]))
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary-{digest(dictionary):016x}.zdict") as out:
        out.write(dictionary)
    placed = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    placed.mapInArrow(lambda batches: _write(batches, folder, tokenizer, end_id, dictionary, level), "shard int, file string, docs bigint, ids bigint").write.parquet(f"{folder}/shards")
    return shards(spark, folder)


def shards(spark, folder: str) -> DataFrame:
    """One row per shard with the number of ids in all shards before it."""
    listed = spark.read.schema("shard int, file string, docs bigint, ids bigint").parquet(f"{folder}/shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class Shard:
    """An open shard: its index, and any document by place."""

    def __init__(self, folder: str, name: str):
        files, root = filesystem(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        magic, version, stamp = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        n, end = TAIL.unpack(self.file.read_at(TAIL.size, self.file.size() - TAIL.size))
        if (magic, version, end) != (MAGIC, VERSION, MAGIC):
            raise ValueError(f"{name} is not a shard")
        index = self.file.read_at(8 * (3 * n + 1), self.file.size() - TAIL.size - 8 * (3 * n + 1))
        self.keys = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.sizes = np.frombuffer(index, "<u8", n, 8 * (2 * n + 1))
        with files.open_input_stream(f"{root}/dictionary-{stamp:016x}.zdict") as source:
            dictionary = source.read()
        if digest(dictionary) != stamp:
            raise ValueError(f"{name} was written with another dictionary")
        self.expand = decompressor(dictionary)

    def ids(self, i: int) -> bytes:
        begin, end = int(self.offsets[i]), int(self.offsets[i + 1])
        return self.expand.decompress(self.file.read_at(end - begin, begin))


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(folder, row["file"])
            starts = np.cumsum(shard.sizes).astype(np.int64) - shard.sizes.astype(np.int64) + row["start"]
            for at in range(0, len(shard.keys), 1024):
                part = slice(at, at + 1024)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.keys[part], pa.int64()),
                        "start": pa.array(starts[part], pa.int64()),
                        "n_tokens": pa.array(shard.sizes[part].astype(np.int64)),
                        "ids": pa.array([shard.ids(i) for i in range(at, min(at + 1024, len(shard.keys)))], pa.binary()),
                    }
                )


def read(spark, folder: str) -> DataFrame:
    """All documents of the files: (doc_id, start, n_tokens, ids as little-endian 32-bit numbers)."""
    listed = shards(spark, folder).select("shard", "file", "start")
    # a given number of partitions: a task for each shard, however few bytes the list has
    return listed.repartitionByRange(max(1, listed.count()), "shard").mapInArrow(lambda batches: _read(batches, folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


