"""Audit of how filters interact, whatever their order; copies are found with radix tries of whole texts.

Every document gets a mask of the filters that it fails.  Four filters look at the text alone.  The fifth, identity to the
text of a smaller id, needs all texts: they are range-partitioned by adaptive text prefixes, so that each bucket holds
about as many bytes, and every bucket inserts its whole texts into a compressed trie whose terminals hold the smallest
id.  A traversal then gives the flags.

A boundary between buckets is the shortest prefix that tells two neighbours of a sample of texts apart: a few bytes as a
rule, more where many texts begin alike.  Equal texts always meet in one bucket; before that, every slice of a task keeps
only the smallest id of each text, so a text that holds a third of all rows arrives as one row a slice.

Masks are then counted by part, and what each filter removes at each step of each order follows from the counts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierspark.llm.util import pieces, stored

LETTERS = "ABCDE"
COPY = 16
SLICE_BYTES = 1 << 25
SAMPLES = 32
FIRST_PREFIX = 64
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JUDGED = "id bigint, part string, mask int, bucket int, text binary"


@dataclass(frozen=True)
class Rules:
    """A: fewer words; B: fewer distinct words in a hundred; C: more capitals in a hundred characters; D: holds a mark."""

    words: int = 50
    distinct_percent: int = 65
    capitals_percent: int = 5
    marks: bytes = b"#$%&*|"

    def mask(self, text: bytes, n_chars: int) -> int:
        """Bits of the first four filters that the text fails."""
        words = text.split()
        few = len(words) < self.words
        same = 100 * len(set(words)) < self.distinct_percent * len(words)
        loud = 100 * (len(text) - len(text.translate(None, UPPER))) > self.capitals_percent * n_chars
        marked = any(m in text for m in self.marks)
        return few | same << 1 | loud << 2 | marked << 3


class Trie:
    """A compressed trie of byte strings.  Each distinct string has a terminal, a number from 0 on."""

    __slots__ = ("root", "terminals")

    def __init__(self) -> None:
        self.root, self.terminals = [b"", {}, -1], 0

    def insert(self, text: bytes) -> int:
        """The terminal of the text, new if it was not inserted before."""
        node, at = self.root, 0
        while at < len(text):
            below = node[1].get(text[at])
            if below is None:
                below = node[1][text[at]] = [text[at:], {}, -1]
            elif not text.startswith(below[0], at):
                # the texts part inside the label: a node for what they share
                shared = common(below[0], text, at)
                upper = node[1][text[at]] = [below[0][:shared], {below[0][shared]: below}, -1]
                below[0] = below[0][shared:]
                below = upper
            node, at = below, at + len(below[0])
        if node[2] < 0:
            node[2] = self.terminals
            self.terminals += 1
        return node[2]


def common(label: bytes, text: bytes, at: int) -> int:
    """Length of the prefix that the label shares with the text from a place on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def separators(prefixes: list[tuple[bytes, int]], per_bucket: int) -> list[bytes]:
    """Boundaries after about every ``per_bucket`` of weight, each the shortest prefix that tells its neighbours apart."""
    found, held, last = [], 0, b""
    for prefix, n in sorted(prefixes):
        if held + n > per_bucket and held:
            found.append(prefix[: common(prefix, last, 0) + 1])
            held = 0
        held, last = held + n, prefix
    return found


def boundaries(texts: DataFrame, bucket_bytes: int) -> list[bytes]:
    """Boundaries of buckets of about ``bucket_bytes``, from a sample of 32 texts a bucket drawn by the texts' hash.

    The driver gets prefixes of the sample; only where many sampled texts begin alike does it ask for longer ones.  The
    sample decides how even the buckets are, never what is found.
    """
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first()
    n_buckets = math.ceil(size["bytes"] / bucket_bytes)
    if n_buckets < 2:
        return []
    share = min(1.0, SAMPLES * n_buckets / size["n"])
    drawn = F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) < math.ceil((1 << 30) * share)
    sample = stored(texts.where(drawn).distinct().select(F.col("_text").cast("binary").alias("_text")), "sample")
    prefix = lambda n: F.substring("_text", 1, n)
    depth, got, rows, limit = FIRST_PREFIX, {}, sample, 1
    while True:
        seen = rows.groupBy(prefix(depth).alias("p")).agg(F.count("*").alias("n"), F.sum(F.octet_length("_text") + 1).alias("bytes")).collect()
        got |= {bytes(r["p"]): r["bytes"] for r in seen}
        if rows is sample:
            limit = max(1, sum(got.values()) // n_buckets)
        heavy = [bytes(r["p"]) for r in seen if r["n"] > 1 and 2 * r["bytes"] > limit and len(r["p"]) == depth]
        if not heavy:
            return separators(list(got.items()), limit)
        rows = sample.where(F.xxhash64(prefix(depth)).isin([signed(p) for p in heavy]))
        for p in heavy:
            del got[p]
        depth *= 8


def signed(prefix: bytes) -> int:
    """Spark's xxhash64 of a binary value."""
    h = xxhash.xxh64_intdigest(prefix, 42)
    return h - (1 << 64) if h >> 63 else h


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules, limits: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Masks of the rows of a slice; only the smallest id of each text is still to be compared, and carries the text."""
    for batch in pieces(batches, 1, SLICE_BYTES):
        lengths = pc.utf8_length(batch.column(1)).to_pylist()
        ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        smallest: dict[bytes, int | None] = {}
        masks: dict[bytes, int] = {}
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for key, text, n_chars in zip(ids, texts, lengths):
            if text not in masks:
                masks[text], smallest[text] = rules.mask(text, n_chars), key
            elif key is not None and (smallest[text] is None or key < smallest[text]):
                smallest[text] = key
        mask, bucket, carried = [], [], []
        for key, text in zip(ids, texts):
            open_ = key is not None and key == smallest[text]
            mask.append(masks[text] | (0 if open_ or key is None else COPY))
            # settled rows go anywhere
            bucket.append(bisect_right(limits, text) if open_ else (key or 0) % (len(limits) + 1))
            carried.append(text if open_ else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.string()), pa.array(mask, pa.int32()), pa.array(bucket, pa.int32()), pa.array(carried, pa.binary())], names=["id", "part", "mask", "bucket", "text"])


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Insert the texts of a bucket into a trie, then give out the masks with the copies' flags."""
    tries: dict[int, tuple[Trie, list[int]]] = {}
    kept: list[tuple[pa.RecordBatch, np.ndarray, int]] = []
    names = ["id", "part", "mask"]
    for batch in batches:
        waiting = pc.is_valid(batch.column(4))
        yield pa.RecordBatch.from_arrays([c.filter(pc.invert(waiting)) for c in batch.columns[:3]], names=names)
        open_ = batch.filter(waiting)
        terminals = np.zeros(open_.num_rows, np.int64)
        for i, (key, bucket, text) in enumerate(zip(open_.column(0).to_pylist(), open_.column(3).to_pylist(), open_.column(4).to_pylist())):
            trie, least = tries.setdefault(bucket, (Trie(), []))
            at = terminals[i] = trie.insert(text)
            if at == len(least):
                least.append(key)
            elif key < least[at]:
                least[at] = key
        kept.append((open_.select([0, 1, 2]), terminals, np.array(open_.column(3).to_pylist(), np.int64)))
    minima = {bucket: np.array(least, np.int64) for bucket, (_, least) in tries.items()}
    for rows, terminals, buckets in kept:
        least = np.array([minima[b][t] for b, t in zip(buckets.tolist(), terminals.tolist())], np.int64)
        copy = rows.column(0).to_numpy(zero_copy_only=False) > least if rows.num_rows else np.zeros(0, bool)
        mask = pa.array((rows.column(2).to_numpy(zero_copy_only=False) | np.where(copy, COPY, 0)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), mask], names=names)


def masks(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bucket_bytes: int = 1 << 23) -> DataFrame:
    """(id, part, mask), one row per input row: bits 1, 2, 4, 8 and 16 for the filters A to E that the row fails.

    NULL texts are empty, as are NULL parts.  Ids are whole numbers.  A row fails E if a smaller id has the same text:
    of repeated rows of one id and text none fails it on account of the other, and a row with a NULL id neither
    fails it nor makes another one fail.  Texts are compared whole, byte by byte.  Other columns are ignored.
    """
    rules = rules or Rules()
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(part_col), F.lit("")).alias("_part"))
    limits = boundaries(rows.select("_text"), bucket_bytes)
    judged = rows.mapInArrow(lambda batches: _judge(batches, rules, limits), JUDGED)
    return judged.repartition(len(limits) + 1, "bucket").mapInArrow(_flags, "id bigint, part string, mask int")


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's filter) of all orders of the filters."""
    bit = {letter: 1 << i for i, letter in enumerate(LETTERS)}
    return [("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[order[k]]) for order in permutations(LETTERS) for k in range(len(LETTERS))]


def audit(docs: DataFrame, labels: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", bucket_bytes: int = 1 << 23) -> DataFrame:
    """One row per part, order of the filters and step, with counts of the part's documents.

    ``kept`` after the step; ``removed`` by it; ``redundant``: failing its filter but removed before; ``unique_fails``:
    failing its filter only; ``good_lost`` and ``toxic_lost``: removed here, with a label quality or toxic of 1 (in any of
    the id's label rows); ``shapley``: what the filter removes, summed over all orders.  Masks as in ``masks``; an empty
    table has no part and gives no row.
    """
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    # rows without an id are dealt out at random instead of meeting under one key
    spread = F.when(F.col("id").isNull(), F.floor(F.rand(1) * (1 << 30)).cast("bigint")).otherwise(F.lit(-1))
    keyed = masks(docs, rules, id_col, text_col, part_col, bucket_bytes).select(F.coalesce("id", F.lit(0)).alias("_id"), spread.alias("_spread"), "part", "mask")
    joined = keyed.join(marked.withColumn("_spread", F.lit(-1).cast("bigint")), ["_id", "_spread"], "left")
    counts = joined.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(name) for c, name in (("_good", "good"), ("_toxic", "bad"))))
    counts = stored(counts, "counts")  # at most 32 rows a part, read twice
    pairs = [(sum(before), bit) for bit in (1, 2, 4, 8, 16) for k in range(5) for before in combinations([b for b in (1, 2, 4, 8, 16) if b != bit], k)]
    cases = F.explode(F.array(*(F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in pairs))).alias("case")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias
    by_case = counts.select("*", cases).select("part", "mask", "n", "good", "bad", "case.*").groupBy("part", "before", "bit").agg(
        total(~fails & ~earlier, "n")("kept"), total(fails & ~earlier, "n")("removed"), total(fails & earlier, "n")("redundant"),
        total(mask == bit, "n")("unique_fails"), total(fails & ~earlier, "good")("good_lost"), total(fails & ~earlier, "bad")("toxic_lost"),
    )
    # so many orders have just these filters before
    orders = F.factorial(F.bit_count(before)) * F.factorial(F.lit(len(LETTERS) - 1) - F.bit_count(before))
    shares = by_case.groupBy("part", "bit").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    order = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, before int, bit int")
    # 600 rows, whatever the input
    return by_case.join(shares, ["part", "bit"]).join(F.broadcast(order), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
