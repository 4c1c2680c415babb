"""Joins whose key may be hot on the large side."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def salted_join(
    large: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], salts: int = 8, how: str = "inner", broadcast: bool = False
) -> DataFrame:
    """Join where one key may own a large share of ``large``.

    Rows of ``large`` are spread over ``salts`` slices of their key by the hash of the
    ``spread`` columns and every row of ``small`` is copied to each slice, so one key is
    worked on by several tasks.  The result is partitioned by key *and* slice: a later
    aggregation on the key still combines map-side before its own shuffle.

    With ``broadcast`` every task gets all of ``small``, once and not in slices, and ``large`` stays where it is.
    """
    if salts & (salts - 1):
        raise ValueError("salts must be a power of two")
    if broadcast:
        return large.join(F.broadcast(small), on, how)
    slices = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    # a bit mask is never null, so the join adds no null filter that could split a shared subplan
    left = large.withColumn("_salt", F.xxhash64(*spread).bitwiseAND(F.lit(salts - 1).cast("bigint")).cast("int"))
    return left.join(small.select("*", slices), [*on, "_salt"], how).drop("_salt")


def is_small(df: DataFrame) -> bool:
    """Whether a table is counted to have few enough rows for every task."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
