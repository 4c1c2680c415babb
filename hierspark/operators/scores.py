"""Score tables: build, union, dedupe, floor, rank, reshape."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hierspark.functions import probs


def from_arrays(rows: DataFrame, array: str, lvl: int, labels: str | None = None) -> DataFrame:
    """Long scores from one ``ARRAY<DOUBLE>`` per id.

    The label is the position, or the element of the parallel array ``labels``.
    """
    out = rows.select("id", *([labels] if labels else []), F.posexplode(array).alias("ord", "prob"))
    label = F.element_at(labels, F.col("ord") + 1) if labels else F.col("ord")
    return out.select("id", F.lit(lvl).alias("lvl"), label.cast("bigint").alias("label"), "ord", "prob")


def to_arrays(scores: DataFrame) -> DataFrame:
    """``(id, lvl, labels, probs)`` in output order; a row is as wide as the label list of its level."""
    cells = F.array_sort(F.collect_list(F.struct("ord", "label", "prob")))
    return (
        scores.groupBy("id", "lvl")
        .agg(cells.alias("_cells"))
        .select("id", "lvl", F.col("_cells.label").alias("labels"), F.col("_cells.prob").alias("probs"))
    )


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; a plain aggregate, so hot keys combine before the shuffle."""
    return _pick(rows, keys, order, F.min)


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(rows, keys, order, F.max)


def _pick(rows: DataFrame, keys: Sequence[str], order: Sequence[str], best) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(best(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def floor_fixed(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores below the threshold become 0; a threshold of 0 changes nothing."""
    return scores.withColumn("prob", probs.floor_prob(F.col("prob"), threshold))


def floor_uniform(scores: DataFrame, trained: DataFrame) -> DataFrame:
    """Scores below ``1 / number of trained labels of their level`` become 0; a level without any is an error."""
    limits = trained.groupBy("lvl").agg((F.lit(1.0) / F.count(F.lit(1))).alias("_limit"))
    # one row per level
    return (
        scores.join(F.broadcast(limits), "lvl", "left")
        .withColumn("_limit", F.coalesce("_limit", F.raise_error(F.concat(F.lit("no trained label at level "), F.col("lvl").cast("string"))).cast("double")))
        .withColumn("prob", probs.floor_prob(F.col("prob"), F.col("_limit")))
        .select(*scores.columns)
    )


def floor_scores(scores: DataFrame, threshold: float, trained: DataFrame | None = None) -> DataFrame:
    """0 is off, 2 is the uniform floor, anything else is a fixed threshold."""
    if threshold == 0:
        return scores
    if threshold == 2:
        return floor_uniform(scores, trained)
    return floor_fixed(scores, threshold)


def best(*carry: str) -> Column:
    """Aggregate: the highest score, the smaller ``ord`` on a tie, with the carried columns."""
    return F.max(F.struct("prob", (-F.col("ord")).alias("_rev"), *carry))


def top1(scores: DataFrame) -> DataFrame:
    """``(id, lvl, label, prob)`` of the best label per id and level."""
    return (
        scores.groupBy("id", "lvl").agg(best("label").alias("b")).select("id", "lvl", "b.label", "b.prob")
    )


def topk(scores: DataFrame, k: int) -> DataFrame:
    """The k best labels per id and level with their rank.

    Spark turns the ``rank <= k`` filter into a per-partition limit below the shuffle.
    """
    w = Window.partitionBy("id", "lvl").orderBy(F.desc("prob"), "ord")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def combine_wide(
    scores: DataFrame,
    columns: Sequence[tuple[int, int]],
    level_names: Sequence[str],
    carry: Sequence[str] = (),
    fill: float | None = None,
) -> DataFrame:
    """One row per id with a ``{level}_{label}`` column for each listed ``(lvl, label)``.

    For sinks only.  The column list is given, so the table is read once.  ``fill`` replaces
    scores that a sparse table leaves out.
    """
    wanted = [f"{lvl}_{label}" for lvl, label in columns]
    cells = scores.withColumn("_cell", F.concat_ws("_", "lvl", "label"))
    wide = cells.groupBy("id", *carry).pivot("_cell", wanted).agg(F.max("prob"))
    names = [
        (F.col(w) if fill is None else F.coalesce(w, F.lit(fill))).alias(f"{level_names[lvl]}_{label}")
        for w, (lvl, label) in zip(wanted, columns)
    ]
    return wide.select("id", *carry, *names)


def with_dummies(wide: DataFrame, n: int = 5) -> DataFrame:
    """Put the placeholder label columns ``dum1 … dumN`` (``'0'``) behind the id."""
    return wide.select("id", *[F.lit("0").alias(f"dum{i + 1}") for i in range(n)], *[c for c in wide.columns if c != "id"])


def melt_wide(wide: DataFrame, level_names: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """Long scores from ``{level}_{label}`` columns; ``ord`` is the column's place in its level."""
    seen: dict[str, int] = {}
    cells = []
    for c in wide.columns:
        if c in keys:
            continue
        level, _, label = c.rpartition("_")
        seen[level] = seen.get(level, -1) + 1
        cells.append(
            F.struct(
                F.lit(list(level_names).index(level)).alias("lvl"),
                F.lit(int(label)).cast("bigint").alias("label"),
                F.lit(seen[level]).alias("ord"),
                F.col(f"`{c}`").alias("prob"),
            )
        )
    return wide.select(*keys, F.inline(F.array(*cells)))
