"""Put levels and ground truth together, and report what does not fit."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hierspark.functions import ids
from hierspark.operators.hierarchy import raise_if_any
from hierspark.operators.scores import union_all


def level_counts(scores: DataFrame) -> DataFrame:
    """``(id, n_lvls)``: distinct levels per id, kept as one bit per level while aggregating."""
    bits = F.bit_or(F.expr("shiftleft(1L, lvl)"))
    return scores.groupBy("id").agg(F.bit_count(bits).cast("int").alias("n_lvls"))


def incomplete(scores: DataFrame, n_levels: int, strict: bool = False) -> DataFrame:
    """Ids that are not scored at all levels; with ``strict`` any such id is an error."""
    bad = level_counts(scores).filter(F.col("n_lvls") != n_levels)
    if strict:
        raise_if_any(bad, f"ids without all {n_levels} levels")
    return bad


def complete(scores: DataFrame, n_levels: int) -> DataFrame:
    """Scores of the ids that are scored at all levels, by one window over the rows of an id (no more than its labels)."""
    bits = F.bit_or(F.expr("shiftleft(1L, lvl)")).over(Window.partitionBy("id"))
    return scores.withColumn("_bits", bits).filter(F.bit_count("_bits") == n_levels).drop("_bits")


def combine_levels(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of the per-level score tables, restricted to ids present in every one of them."""
    return complete(union_all(tables), len(tables))


def completeness(scores: DataFrame) -> DataFrame:
    """How many ids are scored at how many levels."""
    return level_counts(scores).groupBy("n_lvls").agg(F.count(F.lit(1)).alias("n_ids"))


def row_counts(scores: DataFrame) -> DataFrame:
    """Ids per level, with a flag that tells whether all levels have the same number."""
    counts = (
        scores.select("id", "lvl").distinct().groupBy("lvl").agg(F.count(F.lit(1)).alias("n_ids"))
    )
    # one row per level
    levels = Window.partitionBy(F.lit(0))
    parity = F.min("n_ids").over(levels) == F.max("n_ids").over(levels)
    return counts.withColumn("parity", parity)


def check_row_counts(scores: DataFrame) -> DataFrame:
    """The counts, or an error when levels differ."""
    counts = row_counts(scores)
    raise_if_any(counts.filter(~F.col("parity")), "levels with different numbers of ids")
    return counts


def with_original(scores: DataFrame, delimiter: str = "", source: str = "id") -> DataFrame:
    """Add ``orig_id``: tiles and augmentations of one photo share it."""
    return scores.withColumn("orig_id", ids.original_id(ids.photo_id(F.col(source)), delimiter))


def truth_join(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of ids with a truth row plus all truth columns, matched on ``orig_id``.

    A photo with very many tiles makes one hot key; adaptive execution splits it because
    nothing after the join asks for a partitioning.
    """
    return scores.join(truth.withColumnRenamed("id", "orig_id"), "orig_id")


def truth_unmatched(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct ids whose original has no truth row."""
    return (
        scores.select("id", "orig_id")
        .distinct()
        .join(truth.select(F.col("id").alias("orig_id")).distinct(), "orig_id", "left_anti")
        .select("id", "orig_id")
    )


def keep_level(features: DataFrame, level: str, levels: Sequence[str]) -> DataFrame:
    """One level's training table: its label column and all features, without the other labels."""
    return features.drop(*[x for x in levels if x != level])


def assign_split(table: DataFrame, split_ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose id is listed in ``split_ids(id, split, …)``, with the listed columns."""
    return table.join(split_ids, "id")
