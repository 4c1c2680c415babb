"""Training history: accuracy and loss per epoch, best epoch."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epoch_history(rows: DataFrame) -> DataFrame:
    """``(run, epoch, phase, n_rows, loss, acc)`` from per-row ``loss`` and ``correct``."""
    return rows.groupBy("run", "epoch", "phase").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("loss").alias("loss"),
        F.avg(F.col("correct").cast("double")).alias("acc"),
    )


def best_epochs(history: DataFrame, phase: str = "val") -> DataFrame:
    """Validation epochs with the best accuracy before each and whether the epoch is saved.

    An epoch is saved when it is strictly better than every earlier one and than 0, so
    the earliest of equal epochs stays.  A run has as many rows as it has epochs.
    """
    earlier = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return (
        history.filter(F.col("phase") == phase)
        .select("run", "epoch", "acc", F.coalesce(F.max("acc").over(earlier), F.lit(0.0)).alias("best_before"))
        .withColumn("saved", F.col("acc") > F.col("best_before"))
    )


def best_epoch(history: DataFrame, phase: str = "val") -> DataFrame:
    """The saved epoch that is kept at the end of each run."""
    rank = F.struct("acc", (-F.col("epoch")).alias("_rev"), "epoch")
    return (
        history.filter((F.col("phase") == phase) & (F.col("acc") > 0))
        .groupBy("run")
        .agg(F.max(rank).alias("b"))
        .select("run", "b.epoch", "b.acc")
    )
