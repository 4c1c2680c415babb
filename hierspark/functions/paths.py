"""Expressions on a decoded path: ``ARRAY<STRUCT<lvl, label, prob>>`` ordered by level."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hierspark.functions.probs import geometric_mean, product

# Fixed value: scores that do not exceed it are left out of the re-scored confidence.
CONFIDENCE_FLOOR = 0.2
# Per-level thresholds at a 0.5 % false-positive rate, root first.
DEFAULT_THRESHOLDS = (0.38, 0.045, 0.008, 0.007, 0.002)


def path_of(n_levels: int, label: str = "l", prob: str = "p", start: int = 0) -> Column:
    """Pack the columns ``l0, p0, l1, p1, …`` into one path."""
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("lvl"),
                F.col(f"{label}{k}").cast("bigint").alias("label"),
                F.col(f"{prob}{k}").alias("prob"),
            )
            for k in range(start, n_levels)
        ]
    )


def unpack(path: str, n_levels: int) -> list[Column]:
    """The columns ``l0, p0, l1, p1, …`` of a path that starts at level 0."""
    out = []
    for k in range(n_levels):
        node = F.col(path)[k]
        out += [node["label"].alias(f"l{k}"), node["prob"].alias(f"p{k}")]
    return out


def path_product(path: Column) -> Column:
    return product(F.transform(path, lambda x: x["prob"]))


def path_score(path: Column) -> Column:
    """Geometric mean of the probabilities on the path."""
    return geometric_mean(F.transform(path, lambda x: x["prob"]))


def passing(path: Column, thresholds: Sequence[float]) -> Column:
    """The part of the path whose score is strictly above its level's threshold."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    return F.filter(path, lambda x: x["prob"] > F.element_at(limits, x["lvl"] + 1))


def deepest(path: Column) -> Column:
    return F.array_max(F.transform(path, lambda x: x["lvl"]))


def truncate(path: Column, lvl: Column) -> Column:
    """Blank the labels below ``lvl``; with no level given the labels stay."""
    return F.transform(
        path,
        lambda x: F.struct(
            x["lvl"].alias("lvl"),
            F.when(lvl.isNull() | (x["lvl"] <= lvl), x["label"]).alias("label"),
            x["prob"].alias("prob"),
        ),
    )


def confidence(passed: Column, floor: float = CONFIDENCE_FLOOR) -> Column:
    """0 when no level passed, ``NULL`` when none of the passing scores exceeds the floor."""
    strong = F.filter(passed, lambda x: x["prob"] > F.lit(float(floor)))
    return F.when(F.size(passed) == 0, F.lit(0.0)).otherwise(path_score(strong))
