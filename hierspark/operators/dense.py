"""Decode model outputs that are complete: one array of scores per level and id.

This is the form models write their scores in.  One row per id holds the arrays
``probs0, probs1, …`` in trained-label order; the best label of a level is one pass over
its array, its best child one look at the few positions of its children.  Nothing is
exploded and, once the levels of an id are in one row, nothing is shuffled.  Results are
those of the decoders for long tables.

The label lists and the hierarchy between listed labels become literals of the plan.  A label list is no longer than
the arrays of scores in every row, and a listed label has one parent, so they are of the size of one row.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierspark.operators import decode


@dataclass(frozen=True)
class LabelIndex:
    """Trained labels per level and, by position in them, children and parents.

    ``kids[k][i]`` lists positions at level k+1 in child order, ``parents[k][i]`` is a
    position at level k-1 or -1.
    """

    labels: list[list[int]]
    kids: list[list[list[int]]]
    parents: list[list[int]]


def label_index(trained: DataFrame, edges: DataFrame, n_levels: int) -> LabelIndex:
    """Collect the label lists and, joined in Spark, the part of the hierarchy that lies between listed labels."""
    known = trained.filter(F.col("lvl") < n_levels).select("lvl", "pos", "label")
    listed = [tuple(r) for r in known.collect()]
    above = known.select("lvl", F.col("label").alias("parent"))
    below = known.select((F.col("lvl") - 1).alias("lvl"), F.col("label").alias("child"))
    between = edges.select("lvl", "ord", "parent", "child").join(above, ["lvl", "parent"], "left_semi").join(below, ["lvl", "child"], "left_semi")
    linked = [tuple(r) for r in between.select("lvl", "ord", "parent", "child").collect()]
    labels: list[list[int]] = [[] for _ in range(n_levels)]
    for lvl, _, label in sorted(listed):
        labels[lvl].append(label)
    at = [{x: i for i, x in enumerate(level)} for level in labels]
    kids = [[[] for _ in level] for level in labels]
    parents = [[-1] * len(level) for level in labels]
    for lvl, _, parent, child in sorted(linked):
        if parent in at[lvl] and child in at[lvl + 1]:
            kids[lvl][at[lvl][parent]].append(at[lvl + 1][child])
            parents[lvl + 1][at[lvl + 1][child]] = at[lvl][parent]
    return LabelIndex(labels, kids, parents)


def stack_levels(rows: DataFrame, n_levels: int) -> DataFrame:
    """``(id, probs0, probs1, …)`` from one ``(id, lvl, probs)`` row per id and level."""
    cells = [F.first(F.when(F.col("lvl") == k, F.col("probs")), ignorenulls=True).alias(f"probs{k}") for k in range(n_levels)]
    return rows.groupBy("id").agg(*cells)


def best_path(rows: DataFrame, index: LabelIndex) -> DataFrame:
    """``(id, start_lvl, path, conf)``."""
    return decode.best_of(_ArrayTree(rows, index))


def candidates(rows: DataFrame, index: LabelIndex) -> DataFrame:
    """``(id, start_lvl, path, conf)``, one row per start level with a full path."""
    return decode.candidates_of(_ArrayTree(rows, index))


def gated_descent(rows: DataFrame, index: LabelIndex, thresholds: Sequence[float]) -> DataFrame:
    """``(id, l0, p0, …, score)``."""
    return decode.gated_of(_ArrayTree(rows, index), thresholds)


class _ArrayTree(decode.RowTree):
    def __init__(self, rows: DataFrame, index: LabelIndex):
        self.n = len(index.labels)
        self.df = rows.select("id", *[f"probs{k}" for k in range(self.n)])
        self.labels = [_literal(x, "bigint") for x in index.labels]
        self.parents = [_literal(x, "int") for x in index.parents]
        self.kids = [_nested_literal(x) for x in index.kids]

    def _walk(
        self, starts: Sequence[int], up: bool = True, down: bool = True, gate: Sequence[float] | None = None
    ) -> DataFrame:
        """``s2_i0`` is the position at level 0 on the path from start level 2, ``NULL`` past a gap."""
        rows = self.df.withColumns({f"s{s}_p{s}": F.array_max(f"probs{s}") for s in starts})
        rows = rows.withColumns(
            {f"s{s}_i{s}": (F.array_position(f"probs{s}", F.col(f"s{s}_p{s}")) - 1).cast("int") for s in starts}
        )
        for k in reversed(range(self.n - 1)) if up else ():
            below = [s for s in starts if s > k]
            rows = rows.withColumns({f"s{s}_i{k}": _known(_at(self.parents[k + 1], F.col(f"s{s}_i{k + 1}"))) for s in below})
            rows = rows.withColumns({f"s{s}_p{k}": _at(F.col(f"probs{k}"), F.col(f"s{s}_i{k}")) for s in below})
        for k in range(1, self.n) if down else ():
            above = [s for s in starts if s < k]
            rows = rows.withColumns({f"_kids{s}": _at(self.kids[k - 1], F.col(f"s{s}_i{k - 1}")) for s in above})
            probs = F.col(f"probs{k}")
            rows = rows.withColumns({f"_vals{s}": F.transform(f"_kids{s}", lambda i: F.get(probs, i)) for s in above})
            rows = rows.withColumns({f"s{s}_p{k}": _gated(F.array_max(f"_vals{s}"), gate, k) for s in above})
            place = {s: F.array_position(f"_vals{s}", F.col(f"s{s}_p{k}")) - 1 for s in above}
            rows = rows.withColumns({f"s{s}_i{k}": _at(F.col(f"_kids{s}"), place[s].cast("int")) for s in above})
        named = {
            f"s{s}_l{k}": _at(self.labels[k], F.col(f"s{s}_i{k}"))
            for s in starts
            for k in range(0 if up else s, self.n if down else s + 1)
        }
        return rows.withColumns(named)


def _at(values: Column, position: Column) -> Column:
    """Element at a zero-based position, ``NULL`` for a ``NULL`` position or one outside."""
    return F.when(position.isNotNull(), F.get(values, position))


def _known(position: Column) -> Column:
    return F.when(position >= 0, position)


def _gated(prob: Column, gate: Sequence[float] | None, k: int) -> Column:
    return prob if gate is None else F.when(prob >= F.lit(float(gate[k])), prob)


def _literal(values: Sequence[int], kind: str) -> Column:
    return F.from_json(F.lit(str(list(values))), f"array<{kind}>")


def _nested_literal(values: Sequence[Sequence[int]]) -> Column:
    return F.from_json(F.lit(str([list(v) for v in values])), "array<array<int>>")
