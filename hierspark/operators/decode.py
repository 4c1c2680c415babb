"""Decode one consistent root-to-leaf path per id from scores and a hierarchy.

Input is ``scores(id, lvl, label, ord, prob)`` with one row per ``(id, lvl, label)`` and
``edges(lvl, parent, child, ord)``.  From a start level the path takes that level's best
label, then the best child of each label down to the leaf, and the recorded parents up to
the root.  Ties go to the smaller ``ord``: column order at the start level, child order
below it.  A label without scored children, or without a scored parent, has no path.

Scores are dealt out and sorted by ``id`` once; then the paths of all ids of an Arrow batch are found by array operations
(``segments``).  An id has no more rows than there are labels; nothing is collected, and the plan does not depend on any size.

``strategy="window"`` finds the same rows without Python: going up the levels, a window over a label and its children hands every label the path below its
best child; going down, the same window hands every child the path above its parent.  Each
label then knows its whole path, and the best label of a level is a plain aggregate.

Of repeated rows of one ``(id, lvl, label)`` the one with the smallest ``ord`` counts, of
equal ones the largest ``prob``.

``strategy="join"`` walks the same paths by equi-joins on ``(id, label)`` instead, with the same rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hierspark.functions import paths as P
from hierspark.operators.hierarchy import nodes
from hierspark.operators.segments import SortedTree
from hierspark.operators.skew import is_small, salted_join


def best_path(
    scores: DataFrame, edges: DataFrame, n_levels: int, strategy: str = "sorted"
) -> DataFrame:
    """``(id, start_lvl, path, conf)``: the candidate with the highest geometric mean.

    Ties go to the shallowest start.  An id whose candidates all score 0 has no row, so
    zero scores are dropped before anything is shuffled.
    """
    return best_of(_tree(scores.filter("prob > 0"), edges, n_levels, strategy))


def candidates(
    scores: DataFrame, edges: DataFrame, n_levels: int, strategy: str = "sorted"
) -> DataFrame:
    """``(id, start_lvl, path, conf)``, one row for every start level that has a full path."""
    return candidates_of(_tree(scores, edges, n_levels, strategy))


def descend(
    scores: DataFrame, edges: DataFrame, n_levels: int, start: int = 0, strategy: str = "sorted"
) -> DataFrame:
    """``(id, path)`` from the best label at ``start`` down to the leaf level."""
    rows = _tree(scores, edges, n_levels, strategy).rows([start], up=False)
    return rows.select("id", P.path_of(n_levels, start=start).alias("path"))


def backfill(
    scores: DataFrame, edges: DataFrame, n_levels: int, start: int, strategy: str = "sorted"
) -> DataFrame:
    """``(id, path)`` from the root down to the best label at ``start``, with the ancestors' own scores."""
    rows = _tree(scores, edges, n_levels, strategy).rows([start], down=False)
    return rows.select("id", P.path_of(start + 1).alias("path"))


def gated_descent(
    scores: DataFrame, edges: DataFrame, thresholds: Sequence[float], strategy: str = "sorted"
) -> DataFrame:
    """``(id, l0, p0, l1, p1, …, score)``: descend from the root while ``prob >= threshold``.

    The first level that fails ends the path.  The root is exempt while descending and is
    blanked at the end if it is below its own threshold.  ``score`` is the product of the
    kept probabilities, 1 when none is kept.
    """
    if min(thresholds[1:], default=0) > 0:
        # the root is exempt from its gate, so a root score of 0 still leads the way
        scores = scores.filter("lvl = 0 OR prob > 0")
    return gated_of(_tree(scores, edges, len(thresholds), strategy), thresholds)


def best_of(tree) -> DataFrame:
    return tree.best().select("id", "start_lvl", P.path_of(tree.n).alias("path"), "conf")


def candidates_of(tree) -> DataFrame:
    rows = tree.rows(range(tree.n))
    return rows.select("id", "start_lvl", P.path_of(tree.n).alias("path"), _path_score(tree.n).alias("conf"))


def gated_of(tree, thresholds: Sequence[float]) -> DataFrame:
    rows = tree.rows([0], up=False, gate=thresholds)
    root_ok = F.col("p0") >= F.lit(float(thresholds[0]))
    rows = rows.withColumns({"l0": F.when(root_ok, F.col("l0")), "p0": F.when(root_ok, F.col("p0"))})
    score = F.lit(1.0)
    for k in range(tree.n):
        score = score * F.coalesce(f"p{k}", F.lit(1.0))
    return rows.select("id", *_level_columns(tree.n), score.alias("score"))


def gated_backfill(gated: DataFrame, edges: DataFrame, n_levels: int) -> DataFrame:
    """Fill missing labels from their kept child; probabilities and score stay as they are."""
    rows, broadcast = gated, is_small(edges)
    for k in reversed(range(n_levels - 1)):
        up = edges.filter(F.col("lvl") == k).select(F.col("child").alias("_child"), F.lit(False).alias("_none"), F.col("parent").alias("_up"))
        # a row without a label finds nothing, wherever it is; its id spreads such rows
        keyed = rows.withColumns({"_none": F.col(f"l{k + 1}").isNull(), "_child": F.coalesce(F.col(f"l{k + 1}"), F.xxhash64("id"))})
        rows = salted_join(keyed, up, ["_child", "_none"], ["id"], how="left", broadcast=broadcast).withColumn(f"l{k}", F.coalesce(f"l{k}", "_up")).drop("_up", "_child", "_none")
    return rows.select(*gated.columns)


def apply_thresholds(
    decoded: DataFrame,
    thresholds: Sequence[float] = P.DEFAULT_THRESHOLDS,
    floor: float = P.CONFIDENCE_FLOOR,
) -> DataFrame:
    """Add ``rank_lvl`` and ``confidence`` to decoded paths and blank what lies below the rank.

    ``rank_lvl`` is the deepest level strictly above its threshold, ``NULL`` if none is; the
    labels then stay and the confidence is 0.  ``confidence`` is the geometric mean of the
    passing scores above ``floor``, ``NULL`` if there is none.
    """
    passed = P.passing(F.col("path"), thresholds)
    return (
        decoded.withColumn("_passed", passed)
        .withColumns({"rank_lvl": P.deepest(F.col("_passed")), "confidence": P.confidence(F.col("_passed"), floor)})
        .withColumn("path", P.truncate(F.col("path"), F.col("rank_lvl")))
        .drop("_passed")
    )


def unreachable(scores: DataFrame, edges: DataFrame, n_levels: int) -> DataFrame:
    """``(lvl, label, problem)`` for scored labels that can only be part of a broken path."""
    known = nodes(edges)
    seen = scores.select("lvl", "label").distinct().join(known, ["lvl", "label"], "left")
    problem = F.when((F.col("lvl") > 0) & F.col("parent").isNull(), "no parent").when(
        (F.col("lvl") < n_levels - 1) & ~F.coalesce("is_parent", F.lit(False)), "no child"
    )
    return seen.select("lvl", "label", problem.alias("problem")).filter("problem IS NOT NULL")


def _tree(scores: DataFrame, edges: DataFrame, n_levels: int, strategy: str):
    if strategy not in ("sorted", "window", "join"):
        raise ValueError(f"unknown strategy: {strategy}")
    # the few labels near the root occur for every id, so their rows are spread by id, or stay where they are
    placed = salted_join(scores.filter(F.col("lvl") < n_levels), nodes(edges), ["lvl", "label"], ["id"], how="left", broadcast=is_small(edges))
    if strategy == "sorted":
        return SortedTree(placed, n_levels)
    return (_WindowTree if strategy == "window" else _JoinTree)(_single(placed.repartition("id")), n_levels)


def _single(placed: DataFrame) -> DataFrame:
    """One row per ``(id, lvl, label)``; what the hierarchy says of a label is the same in all of them."""
    first = F.min(F.struct("ord", (-F.col("prob")).alias("_less"))).alias("_first")
    of_label = [F.first(c).alias(c) for c in ("parent", "child_ord", "is_parent")]
    rows = placed.groupBy("id", "lvl", "label").agg(first, *of_label)
    return rows.select("id", "lvl", "label", F.col("_first.ord").alias("ord"), (-F.col("_first._less")).alias("prob"), "parent", "child_ord", "is_parent")


def _top() -> Column:
    """Best label of a level; the struct carries the tie rule and the label's parent."""
    return F.max(F.struct("prob", (-F.col("ord")).alias("_rev"), "label", "parent"))


def _best_child() -> Column:
    return F.max(F.struct("prob", (-F.col("child_ord")).alias("_rev"), "label"))


def _level_columns(n_levels: int) -> list[str]:
    return [c for k in range(n_levels) for c in (f"l{k}", f"p{k}")]


def _path_score(n_levels: int, prefix: str = "") -> Column:
    """Geometric mean of the columns ``p0, p1, …``; plain arithmetic stays in generated code."""
    total = F.col(f"{prefix}p0")
    for k in range(1, n_levels):
        total = total * F.col(f"{prefix}p{k}")
    return F.pow(total, F.lit(1.0 / n_levels))


class RowTree:
    """All start levels walked side by side in one row per id, in columns such as ``s2_l0``.

    A subclass supplies ``n``, the number of levels, and ``_walk``.
    """

    def rows(self, starts: Sequence[int], up: bool = True, down: bool = True, gate: Sequence[float] | None = None) -> DataFrame:
        """``(id, start_lvl, l0, p0, …)``; only complete rows unless gated."""
        walked = self._walk(starts, up, down, gate)
        per_start = [F.struct(F.lit(s).alias("start_lvl"), *self._row(s, up, down)) for s in starts]
        out = walked.select("id", F.inline(F.array(*per_start)))
        needed = [f"p{starts[0]}"] if gate is not None else [c for c in out.columns if c.startswith("p")]
        return out.dropna("any", subset=needed)

    def best(self) -> DataFrame:
        found = [
            F.struct(_path_score(self.n, f"s{s}_").alias("conf"), F.lit(-s).alias("_rev"), F.lit(s).alias("start_lvl"), *self._row(s))
            for s in range(self.n)
        ]
        best = F.array_max(F.filter(F.array(*found), lambda c: c["conf"] > 0))
        # a generator drops ids without a path; a filter would be pushed down the whole walk,
        # repeating its expressions at every step
        kept = F.filter(F.array(best), lambda c: c.isNotNull())
        return self._walk(range(self.n)).select("id", F.inline(kept)).drop("_rev")

    def _row(self, s: int, up: bool = True, down: bool = True) -> list[Column]:
        levels = range(0 if up else s, self.n if down else s + 1)
        return [F.col(f"s{s}_{c}{k}").alias(f"{c}{k}") for k in levels for c in ("l", "p")]


class _WindowTree:
    """Every row learns the path below and above it, level by level, inside its id."""

    def __init__(self, placed: DataFrame, n_levels: int):
        self.n = n_levels
        self.placed = placed

    def rows(self, starts: Sequence[int], up: bool = True, down: bool = True, gate: Sequence[float] | None = None) -> DataFrame:
        """``(id, start_lvl, l0, p0, …)``; only complete rows unless gated."""
        tops = self._tops(starts, up, down, gate)
        levels = range(0 if up else min(starts), self.n if down else max(starts) + 1)
        found = tops.select("id", F.col("lvl").alias("start_lvl"), *[F.col(f"top.{c}{k}").alias(f"{c}{k}") for k in levels for c in ("l", "p")])
        needed = [f"p{starts[0]}"] if gate is not None else [f"p{k}" for k in levels]
        return found.dropna("any", subset=needed)

    def best(self) -> DataFrame:
        scored = self.rows(range(self.n)).withColumn("conf", _path_score(self.n)).filter("conf > 0")
        rank = F.struct("conf", (-F.col("start_lvl")).alias("_rev"), "start_lvl", *_level_columns(self.n))
        return scored.groupBy("id").agg(F.max(rank).alias("b")).select("id", "b.*").drop("_rev")

    def _tops(self, starts: Sequence[int], up: bool, down: bool, gate: Sequence[float] | None) -> DataFrame:
        lvl = F.col("lvl")
        own = {c: F.when(lvl == k, F.col(v)) for k in range(self.n) for c, v in ((f"l{k}", "label"), (f"p{k}", "prob"))}
        rows = self.placed.withColumns(own)
        for k in reversed(range(min(starts), self.n - 1)) if down else ():
            rows = self._learn_below(rows, k, gate)
        for k in range(max(starts)) if up else ():
            rows = self._learn_above(rows, k)
        path = F.struct("prob", (-F.col("ord")).alias("_rev"), *_level_columns(self.n))
        return rows.filter(lvl.isin(*starts)).groupBy("id", "lvl").agg(F.max(path).alias("top"))

    def _learn_below(self, rows: DataFrame, k: int, gate: Sequence[float] | None) -> DataFrame:
        """Rows of level k take the best child and the path below it; a child that fails the gate is none."""
        below = [(c, j) for j in range(k + 1, self.n) for c in ("l", "p")]
        child = (F.col("lvl") == k + 1) & F.col("parent").isNotNull()
        kid = F.max(F.when(child, F.struct("prob", (-F.col("child_ord")).alias("_rev"), *[f"{c}{j}" for c, j in below]))).over(self._family(k))
        taken = F.col("lvl") == k
        if gate is not None:
            taken = taken & (F.col("_kid.prob") >= F.lit(float(gate[k + 1])))
        rows = rows.withColumn("_kid", kid)
        return rows.withColumns({f"{c}{j}": F.when(taken, F.col(f"_kid.{c}{j}")).otherwise(F.col(f"{c}{j}")) for c, j in below}).drop("_kid")

    def _learn_above(self, rows: DataFrame, k: int) -> DataFrame:
        """Rows of level k + 1 take their parent and the path above it."""
        above = [(c, j) for j in range(k + 1) for c in ("l", "p")]
        parent = F.max(F.when(F.col("lvl") == k, F.struct(*[f"{c}{j}" for c, j in above]))).over(self._family(k))
        taken = (F.col("lvl") == k + 1) & F.col("parent").isNotNull()
        rows = rows.withColumn("_par", parent)
        return rows.withColumns({f"{c}{j}": F.when(taken, F.col(f"_par.{c}{j}")).otherwise(F.col(f"{c}{j}")) for c, j in above}).drop("_par")

    def _family(self, k: int) -> WindowSpec:
        """A label of level k with its children; the other rows of the id are a family without effect."""
        return Window.partitionBy("id", F.when(F.col("lvl") == k, F.col("label")).when(F.col("lvl") == k + 1, F.col("parent")))


class _JoinTree:
    """The same walk as equi-joins on ``(id, label)``, one row per id and start level.

    The scores are read once per step, so they should be a stored table.
    """

    def __init__(self, placed: DataFrame, n_levels: int):
        self.n = n_levels
        self.placed = placed

    def rows(self, starts: Sequence[int], up: bool = True, down: bool = True, gate: Sequence[float] | None = None) -> DataFrame:
        """``(id, start_lvl, l0, p0, …)``; only complete rows unless gated."""
        rows = self._starts(starts)
        for k in reversed(range(max(starts))) if up else ():
            rows = self._up(rows, k)
        for k in range(min(starts) + 1, self.n) if down else ():
            rows = self._down(rows, k, gate)
        return rows.drop("_up")

    def best(self) -> DataFrame:
        scored = self.rows(range(self.n)).withColumn("conf", _path_score(self.n)).filter("conf > 0")
        rank = F.struct("conf", (-F.col("start_lvl")).alias("_rev"), "start_lvl", *_level_columns(self.n))
        return scored.groupBy("id").agg(F.max(rank).alias("b")).select("id", "b.*").drop("_rev")

    def _starts(self, levels: Sequence[int]) -> DataFrame:
        lvl, top = F.col("start_lvl"), F.col("top")
        cells = [F.when(lvl == k, top[f]).alias(f"{c}{k}") for k in range(self.n) for c, f in (("l", "label"), ("p", "prob"))]
        return (
            self.placed.filter(F.col("lvl").isin(*levels))
            .groupBy("id", F.col("lvl").alias("start_lvl"))
            .agg(_top().alias("top"))
            .select("id", "start_lvl", top["parent"].alias("_up"), *cells)
        )

    def _up(self, rows: DataFrame, k: int) -> DataFrame:
        """Fill level k of the rows that started below it; a missing parent drops the row."""
        at = self.placed.filter((F.col("lvl") == k) & F.col("is_parent")).select(
            "id", F.col("label").alias("_up"), F.col("prob").alias("_prob"), F.col("parent").alias("_next")
        )
        below = F.col("start_lvl") > k
        return (
            rows.join(at, ["id", "_up"], "left")
            .filter(~below | F.col("_prob").isNotNull())
            .withColumns(
                {
                    f"l{k}": F.when(below, F.col("_up")).otherwise(F.col(f"l{k}")),
                    f"p{k}": F.when(below, F.col("_prob")).otherwise(F.col(f"p{k}")),
                    "_up": F.when(below, F.col("_next")).otherwise(F.col("_up")),
                }
            )
            .drop("_prob", "_next")
        )

    def _down(self, rows: DataFrame, k: int, gate: Sequence[float] | None) -> DataFrame:
        """Fill level k of the rows that started above it.

        With a gate a failing child is left out; without one a missing child drops the row.
        """
        kids = (
            self.placed.filter((F.col("lvl") == k) & F.col("parent").isNotNull())
            .groupBy("id", F.col("parent").alias(f"l{k - 1}"))
            .agg(_best_child().alias("_kid"))
        )
        taken = F.col("start_lvl") < k
        if gate is not None:
            kids = kids.filter(F.col("_kid.prob") >= F.lit(float(gate[k])))
        rows = rows.join(kids, ["id", f"l{k - 1}"], "left").withColumns(
            {
                f"l{k}": F.when(taken, F.col("_kid.label")).otherwise(F.col(f"l{k}")),
                f"p{k}": F.when(taken, F.col("_kid.prob")).otherwise(F.col(f"p{k}")),
            }
        )
        return rows.drop("_kid") if gate is not None else rows.drop("_kid").filter(F.col(f"l{k}").isNotNull())
