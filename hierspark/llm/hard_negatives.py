"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

Vectors become whole numbers.  Rows are ordered along a Hilbert curve through all dimensions and written as Parquet files
whose row groups are the blocks; a zone map holds the smallest and largest value of each dimension, and of the label, in
each block.  Interval arithmetic on a zone map bounds the score that any row of the block can have with an anchor.

Anchors, in Hilbert order as well, are dealt out in groups.  For each group and each span of the blocks a task reads the
zone maps of the span, and then, best bound first, those blocks alone that a window of one of its anchors may still need:
the window of the positives is open above and closes at the k-th best score so far; a window of negatives is closed on
both sides.  The best of each span are merged.  So no task holds more than a group of anchors and one block, and what is
read a second time after a lost executor is in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierspark.llm.util import shared_folder, stored

BITS = 4
BLOCK_ROWS, BLOCKS_A_FILE = 4096, 16
GROUP, SPANS = 256, 8
LIMIT = 1 << 24
FOUND = "array<struct<worse: bigint, id: bigint>>"
ANCHORS = "grp bigint, uid bigint, id bigint, label bigint, vec array<bigint>"


@dataclass(frozen=True)
class Windows:
    """How many positives and negatives, and between what percentages of the positive's score a negative's lies."""

    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90

    def of(self, score: int) -> tuple[int, int]:
        """Smallest and largest score of a negative; empty if the first is larger."""
        return -(-self.low_percent * score // 100), self.high_percent * score // 100


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of whole numbers below 2^bits, as bytes in order (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(bits * x.shape[0], -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part."""
    odd = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    cell = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"), F.lit(LIMIT)), F.lit(-LIMIT))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~odd)
    return good.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.transform(vec_col, cell).alias("vec"))


def keyed(rows: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """Rows with their place on the curve; each dimension is cut into 2^BITS steps between the table's extremes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (matrix(batch.column(2), width) - low) * ((1 << BITS) - 1) // max(1, high - low)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cells, BITS), pa.binary()), *batch.columns], names=["key", "id", "label", "vec"])

    return rows.mapInArrow(run, "key binary, id bigint, label bigint, vec array<bigint>")


def write_blocks(rows: DataFrame, folder: str, width: int, n_files: int, block_rows: int) -> None:
    """Write the rows in curve order as Parquet files of blocks, and the zone maps beside them, by span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/blocks")
        number = TaskContext.get().partitionId()
        temporary, final = f"{root}/{uuid.uuid4().hex}.part", f"{root}/{number:06d}.parquet"
        schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), *((f"d{i}", pa.int64()) for i in range(width))])
        writer, zones, waiting, held = None, [], [], 0

        def block() -> None:
            whole = pa.Table.from_batches(waiting)
            values, labels = np.concatenate([matrix(b.column(3), width) for b in waiting]), whole["label"].to_numpy()
            order = slice(0, block_rows)
            writer.write_table(pa.Table.from_arrays([whole["id"][order], whole["label"][order], *(pa.array(values[order, i]) for i in range(width))], schema=schema))
            zones.append((number, len(zones), int(labels[order].min()), int(labels[order].max()), values[order].min(0).tolist(), values[order].max(0).tolist(), (number + len(zones)) % SPANS))
            waiting[:] = whole.slice(block_rows).to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            writer = writer or pq.ParquetWriter(temporary, schema, filesystem=files)
            waiting.append(batch)
            held += batch.num_rows
            while held >= block_rows:
                block()
                held -= block_rows
        if writer is None:
            return
        if held:
            block()
        writer.close()
        files.move(temporary, final)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*zones), kinds)], names=["file", "block", "label_low", "label_high", "low", "high", "span"])

    files, root = pyarrow.fs.FileSystem.from_uri(f"{folder}/blocks")
    files.create_dir(root, recursive=True)
    placed = rows.repartitionByRange(n_files, "key", "id").sortWithinPartitions("key", "id")
    zone_rows = placed.mapInArrow(run, "file bigint, block bigint, label_low bigint, label_high bigint, low array<bigint>, high array<bigint>, span int")
    zone_rows.write.partitionBy("span").parquet(f"{folder}/zones")


@dataclass
class Zones:
    """Zone maps of a span, and its blocks on demand."""

    files: pyarrow.fs.FileSystem
    root: str
    places: list[tuple[int, int]]
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest score that each anchor (row) can have in each block (column)."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return products(up, self.low) + products(down, self.high), products(up, self.high) + products(down, self.low)

    def read(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and vectors of a block."""
        file, block = self.places[at]
        with pq.ParquetFile(f"{self.root}/blocks/{file:06d}.parquet", filesystem=self.files) as source:
            found = source.read_row_group(block)
        columns = [c.to_numpy() for c in found.columns]
        return columns[0], columns[1], np.stack(columns[2:], axis=1)


@lru_cache(maxsize=2)
def zones(folder: str, span: int, width: int) -> Zones:
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    listed = files.get_file_info(pyarrow.fs.FileSelector(f"{root}/zones/span={span}", allow_not_found=True))
    parts = [pq.ParquetFile(f.path, filesystem=files).read() for f in sorted(listed, key=lambda f: f.path) if f.path.endswith(".parquet")]
    rows = pa.concat_tables(parts).to_pylist() if parts else []
    stack = lambda name: np.array([r[name] for r in rows], np.int64).reshape(len(rows), width)
    return Zones(files, root, [(r["file"], r["block"]) for r in rows], np.array([[r["label_low"], r["label_high"]] for r in rows], np.int64).reshape(len(rows), 2), stack("low"), stack("high"))


class Best:
    """The k best (score, id) of one window: higher scores, then smaller ids."""

    __slots__ = ("k", "low", "high", "scores", "ids")

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """Lower scores cannot enter any more."""
        return self.low if len(self.scores) < self.k else max(self.low, int(self.scores[-1]))

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.floor()) & (scores <= self.high))
        if len(fits):
            scores, ids = np.append(self.scores, scores[fits]), np.append(self.ids, ids[fits])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[first], ids[first]


def search(own: Zones, anchors: np.ndarray, ids: list[int], labels: np.ndarray, windows: list[list[Best]], same_label: bool) -> int:
    """Fill the windows of all anchors from the blocks that they need; return how many blocks were read."""
    if not own.places or not len(anchors):
        return 0
    least, most = own.bounds(anchors)
    label_low, label_high = own.labels[:, 0], own.labels[:, 1]
    inside = (label_low <= labels[:, None]) & (labels[:, None] <= label_high)
    possible = inside if same_label else ~((label_low == labels[:, None]) & (label_high == labels[:, None]))
    n_read = 0
    reach = np.where(possible, most, np.iinfo(np.int64).min).max(axis=0)
    for at in np.argsort(-reach, kind="stable").tolist():
        needed = [[w for w in windows[i] if most[i, at] >= w.floor() and least[i, at] <= w.high] if possible[i, at] else [] for i in range(len(anchors))]
        who = [i for i, ws in enumerate(needed) if ws]
        if not who:
            continue
        n_read += 1
        block_ids, block_labels, vectors = own.read(at)
        scores = products(anchors[who], vectors)
        for row, i in enumerate(who):
            fits = ((block_labels == labels[i]) if same_label else (block_labels != labels[i])) & (block_ids != ids[i])
            for window in needed[i]:
                window.offer(scores[row][fits], block_ids[fits])
    return n_read


def _listed(best: Best) -> list[dict[str, int]]:
    return [{"worse": -s, "id": i} for s, i in zip(best.scores.tolist(), best.ids.tolist())]


def _positives(folder: str, width: int, k: int) -> Callable:
    lowest, highest = -(1 << 62), 1 << 62

    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors, ids, labels = matrix(table["vec"].combine_chunks(), width), table["id"].to_pylist(), table["label"].to_numpy()
        windows = [[Best(k, lowest, highest)] for _ in ids]
        search(zones(folder, key[1].as_py(), width), vectors, ids, labels, windows, same_label=True)
        # a group's anchors travel on with the first span alone
        vec = table["vec"] if key[1].as_py() == 0 else pa.nulls(len(ids), table["vec"].type)
        return pa.table({"grp": table["grp"], "uid": table["uid"], "id": table["id"], "label": table["label"], "vec": vec, "found": pa.array([_listed(w[0]) for w in windows], FOUND_TYPE)})

    return run


def _negatives(folder: str, width: int, rule: Windows) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors, ids, labels = matrix(table["vec"].combine_chunks(), width), table["id"].to_pylist(), table["label"].to_numpy()
        positives = table["positives"].to_pylist()
        windows = [[Best(rule.negatives, *rule.of(-p["worse"])) for p in own] for own in positives]
        search(zones(folder, key[1].as_py(), width), vectors, ids, labels, windows, same_label=False)
        rows = [(u, i, n, p["id"], -p["worse"], _listed(w)) for u, i, own, ws in zip(table["uid"].to_pylist(), ids, positives, windows) for n, (p, w) in enumerate(zip(own, ws))]
        kinds = {"uid": pa.int64(), "id": pa.int64(), "nth": pa.int32(), "positive_id": pa.int64(), "positive_score": pa.int64(), "found": FOUND_TYPE}
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})

    return run


FOUND_TYPE = pa.list_(pa.struct([("worse", pa.int64()), ("id", pa.int64())]))


def first(lists: Column, k: int) -> Column:
    """The k best of some short lists."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, k)


def grouped(rows: DataFrame, size: int) -> DataFrame:
    """Anchors with a row number of their own and the number of their group, at most ``size`` neighbours on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            place = np.arange(seen, seen + batch.num_rows, dtype=np.int64) + (part << 36)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(place // size), pa.array(place), *batch.columns[1:]], names=["grp", "uid", "id", "label", "vec"])

    return rows.mapInArrow(run, ANCHORS)


def mine(
    vectors: DataFrame, anchor: Column, rule: Windows | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Return (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says of ``id`` which rows are anchors.  Each component x becomes floor(scale * x), cut at 2^24 on both sides;
    a score is the inner product of whole numbers, a shorter vector ending in zeros.  Rows with a NULL id, label or vector,
    or a component that is NULL or not finite, take no part.  An anchor's positives are its best other rows of the same label,
    its negatives, for each positive, the best rows of another label inside the window of percentages; higher scores first,
    ties by smaller id.  Rows of an anchor's own id are never its positives or negatives.  Repeated rows take part each,
    repeated anchors are mined each.  An anchor without positives, or a positive without negatives, gives no row, as
    does an empty table.  Other columns are ignored.
    """
    rule = rule or Windows()
    rows = whole_numbers(vectors, id_col, vec_col, label_col, scale)
    extent = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.min(F.array_min("vec")).alias("low"), F.max(F.array_max("vec")).alias("high")).first()
    width, low, high = max(1, extent["width"] or 1), min(0, extent["low"] or 0), max(0, extent["high"] or 0)
    folder = shared_folder(vectors.sparkSession, "vectors")
    curve = keyed(rows, width, low, high)
    write_blocks(curve, folder, width, -(-extent["n"] // (block_rows * BLOCKS_A_FILE)) or 1, block_rows)
    chosen = curve.where(anchor)
    near = chosen.repartitionByRange(-(-extent["n"] // (100 * GROUP)) or 1, "key", "id").sortWithinPartitions("key", "id")
    anchors = stored(grouped(near, GROUP), "anchors")
    spans = F.explode(F.sequence(F.lit(0), F.lit(SPANS - 1))).alias("span")
    # few bytes, much work: a stated number of partitions, so that groups are not put together by their bytes
    n_parts = -(-anchors.count() // GROUP) * SPANS or 1
    near_by = anchors.select("*", spans).repartition(n_parts, "grp", "span").groupBy("grp", "span").applyInArrow(_positives(folder, width, rule.positives), f"{ANCHORS}, found {FOUND}")
    whole = near_by.groupBy("uid").agg(*(F.max(c).alias(c) for c in ("grp", "id", "label")), F.first("vec", ignorenulls=True).alias("vec"), first(F.col("found"), rule.positives).alias("positives"))
    known = stored(whole.where(F.size("positives") > 0), "positives")
    apart = known.select("*", spans).repartition(n_parts, "grp", "span").groupBy("grp", "span").applyInArrow(_negatives(folder, width, rule), f"uid bigint, id bigint, nth int, positive_id bigint, positive_score bigint, found {FOUND}")
    merged = apart.groupBy("uid", "nth").agg(*(F.max(c).alias(c) for c in ("id", "positive_id", "positive_score")), first(F.col("found"), rule.negatives).alias("found"))
    return merged.select("id", "positive_id", "positive_score", F.posexplode("found").alias("_at", "_one")).select(
        F.col("id").alias("anchor_id"), "positive_id", (F.col("_at") + 1).alias("rank"), F.col("_one.id").alias("negative_id"), "positive_score", (-F.col("_one.worse")).alias("negative_score")
    )
