"""Paths of whole ids at a time: rows sorted by id once, then segment arithmetic over Arrow batches.

``SortedTree`` gives the rows that the window and join walks of ``decode`` give.  A task reads its rows in order of id and
keeps, between two batches, only those of the id that may go on; repeated rows are dropped before that, so it never keeps
more rows than the hierarchy has labels.  Every step is an array operation over all ids of a batch: nothing runs for a
single row, and the plan depends on no size.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("id", "lvl", "label", "ord", "prob", "parent", "child_ord")
NONE = np.iinfo(np.int64).min + 1


class SortedTree:
    """``placed`` has the columns ``COLUMNS``; a label without a parent has NULL there.

    A window over the id asks for rows that are dealt out and sorted by it: those that already are dealt out, in
    whatever number of partitions, stay where they are.
    """

    def __init__(self, placed: DataFrame, n_levels: int):
        self.n = n_levels
        self.placed = placed.select(*COLUMNS, F.row_number().over(Window.partitionBy("id").orderBy("id")).alias("_row"))

    def rows(self, starts: Sequence[int], up: bool = True, down: bool = True, gate: Sequence[float] | None = None) -> DataFrame:
        """``(id, start_lvl, l0, p0, …)``; only complete rows, without NaN, unless gated."""
        starts, gate = list(starts), gate and [float(t) for t in gate]
        levels = range(0 if up else min(starts), self.n if down else max(starts) + 1)
        needed = [starts[0]] if gate is not None else list(levels)
        return self._run(levels, lambda ids: ids.rows(starts, levels, needed, up, down, gate))

    def best(self) -> DataFrame:
        levels = range(self.n)
        return self._run(levels, lambda ids: ids.best(levels), [T.StructField("conf", T.DoubleType())])

    def _run(self, levels: Sequence[int], job: Callable, more: Sequence[T.StructField] = ()) -> DataFrame:
        own, n = self.placed.schema, self.n
        cells = [T.StructField(f"{c}{k}", t) for k in levels for c, t in (("l", own["label"].dataType), ("p", T.DoubleType()))]
        schema = T.StructType([own["id"], T.StructField("start_lvl", T.IntegerType()), *cells, *more])
        return self.placed.mapInArrow(lambda batches: _of_whole_ids(batches, n, schema.names, job), schema)


def _of_whole_ids(batches: Iterator[pa.RecordBatch], n: int, names: Sequence[str], job: Callable) -> Iterator[pa.RecordBatch]:
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch]).select(COLUMNS)
        table = _distinct(pa.concat_tables([rest, new]).combine_chunks() if rest is not None else new)
        last = _runs(table["id"])[-1]
        done, rest = table.slice(0, last), table.slice(last)
        if last:
            yield pa.RecordBatch.from_arrays(job(Ids(done, n)), names=names)
    if rest is not None:
        yield pa.RecordBatch.from_arrays(job(Ids(rest, n)), names=names)


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal values begins; NULL equals NULL."""
    codes = _ranks(column)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _ranks(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return pc.rank(column, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers; NULL is below all others."""
    return pc.fill_null(column.cast(pa.int64()), NONE).to_numpy()


def _real(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers; NULL is below all others, as NaN is above them."""
    return pc.fill_null(column.cast(pa.float64()), -np.inf).to_numpy()


def _distinct(table: pa.Table) -> pa.Table:
    """One row of each ``(id, lvl, label)``, in that order: the smallest ``ord``, then the largest ``prob``."""
    begins = _runs(table["id"])
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
    lvl, label = _whole(table["lvl"]), _ranks(table["label"])
    prob = table["prob"].cast(pa.float64())
    less = np.where(prob.is_null().to_numpy(), -np.inf, -_real(prob))
    order = np.lexsort((less, _whole(table["ord"]), label, lvl, group))
    key = np.stack([group[order], lvl[order], label[order]])
    return table.take(order[np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))])


def _last_of(*keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, where each run of equal ones ends."""
    ends = np.zeros(len(keys[0]), dtype=bool)
    for key in keys:
        ends[:-1] |= key[1:] != key[:-1]
    ends[-1:] = True
    return np.flatnonzero(ends)


class Ids:
    """Distinct rows of whole ids in the order ``(id, lvl, label)``, as arrays; -1 is no row."""

    def __init__(self, table: pa.Table, n: int):
        self.n, self.table = n, table.combine_chunks()
        begins = _runs(table["id"])
        self.group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
        self.lvl, self.prob = _whole(table["lvl"]), _real(table["prob"])
        self.scored = table["prob"].is_valid().to_numpy() & ~np.isnan(self.prob)
        codes = _ranks(pa.chunked_array([*table["label"].chunks, *table["parent"].cast(table["label"].type).chunks]))
        self.label, parent = codes[: table.num_rows], codes[table.num_rows :]
        self.has_parent = table["parent"].is_valid().to_numpy()
        width = int(codes.max(initial=0)) + 1
        self.own, self.family = self.group * width + self.label, self.group * width + parent
        self.first, self.child_first = -_whole(table["ord"]), -_whole(table["child_ord"])
        self.first[table["ord"].is_null().to_numpy()] = NONE
        self.at = [np.flatnonzero(self.lvl == k) for k in range(n)]

    def _find(self, rows: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The rows, ascending by their keys, that have the wanted ones."""
        if not len(rows):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, rows[at], -1)

    def below(self, gate: Sequence[float] | None) -> np.ndarray:
        """The best child of every row; one that fails the gate is none."""
        child = np.full(len(self.lvl), -1)
        for k in range(self.n - 1):
            kids = self.at[k + 1][self.has_parent[self.at[k + 1]]]
            kids = kids[np.lexsort((self.label[kids], self.child_first[kids], self.prob[kids], self.family[kids]))]
            kids = kids[_last_of(self.family[kids])]
            found = self._find(kids, self.family[kids], self.own[self.at[k]])
            if gate is not None:
                found = np.where((found >= 0) & ~(self.prob[found] < gate[k + 1]), found, -1)
            child[self.at[k]] = found
        return child

    def above(self) -> np.ndarray:
        """The parent's row of every row."""
        parent = np.full(len(self.lvl), -1)
        for k in range(1, self.n):
            kids = self.at[k][self.has_parent[self.at[k]]]
            parent[kids] = self._find(self.at[k - 1], self.own[self.at[k - 1]], self.family[kids])
        return parent

    def tops(self, starts: Sequence[int]) -> np.ndarray:
        """The best row of every id and start level: the largest score, then the first column, then the largest label."""
        rows = np.flatnonzero(np.isin(self.lvl, starts))
        rows = rows[np.lexsort((self.label[rows], self.first[rows], self.prob[rows], self.lvl[rows], self.group[rows]))]
        return rows[_last_of(self.lvl[rows], self.group[rows])]

    def paths(self, starts: Sequence[int], up: bool, down: bool, gate: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray]:
        """Best rows of the start levels and, by level, the rows of their paths."""
        tops = self.tops(starts)
        way = np.full((self.n, len(tops)), -1)
        way[self.lvl[tops], np.arange(len(tops))] = tops
        steps = [(k, k - 1, child) for child in ([self.below(gate)] if down else []) for k in range(1, self.n)]
        steps += [(k, k + 1, parent) for parent in ([self.above()] if up else []) for k in reversed(range(self.n - 1))]
        for k, source, link in steps:
            go = (way[k] < 0) & (way[source] >= 0) & ((self.lvl[tops] < k) == (source < k))
            way[k, go] = link[way[source, go]]
        return tops, way

    def rows(self, starts: Sequence[int], levels: Sequence[int], needed: Sequence[int], up: bool, down: bool, gate: Sequence[float] | None) -> list[pa.Array]:
        tops, way = self.paths(starts, up, down, gate)
        keep = (way[needed] >= 0).all(axis=0)
        keep &= self.scored[way[needed]].all(axis=0)
        return self._columns(tops[keep], way[:, keep], levels)

    def best(self, levels: Sequence[int]) -> list[pa.Array]:
        """Of each id the path with the highest geometric mean above 0, of equal ones the shallowest start."""
        tops, way = self.paths(levels, True, True, None)
        total = np.ones(way.shape[1])
        for k in levels:
            total = total * np.where(way[k] >= 0, self.prob[way[k]], 0.0)
        whole = (way >= 0).all(axis=0) & self.scored[way].all(axis=0)
        conf = np.power(np.where(whole, total, 0.0), 1.0 / self.n)
        good = np.flatnonzero(conf > 0)
        good = good[np.lexsort((-self.lvl[tops[good]], conf[good], self.group[tops[good]]))]
        good = good[_last_of(self.group[tops[good]])]
        return [*self._columns(tops[good], way[:, good], levels), pa.array(conf[good], from_pandas=False)]

    def _columns(self, tops: np.ndarray, way: np.ndarray, levels: Sequence[int]) -> list[pa.Array]:
        out = [self._taken("id", tops), pa.array(self.lvl[tops].astype(np.int32))]
        for k in levels:
            rows = pa.array(way[k], mask=way[k] < 0)
            out += [self._taken("label", rows), self._taken("prob", rows).cast(pa.float64())]
        return out

    def _taken(self, column: str, rows: np.ndarray | pa.Array) -> pa.Array:
        found = self.table[column].take(pa.array(rows))
        return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
