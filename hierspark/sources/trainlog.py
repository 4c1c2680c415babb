"""Training logs: free text with one block of lines per epoch and accuracy lines at the end."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns of the log text.
EPOCH = r"Epoch (\d+)/\d+[^\n]*\n[^\n]*(?:\ntrain Loss: ([0-9.]+) Acc: ([0-9.]+)[^\n]*)?(?:\nval Loss: ([0-9.]+) Acc: ([0-9.]+))?"
CLASS_LINE = r"Test Accuracy of +([^\n]*?): *\d+% \( *(\d+)/ *(\d+)\)"
OVERALL_LINE = r"Test Accuracy \(Overall\): *\d+% \( *(\d+)/ *(\d+)\)"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(run, text)``, one row per log file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("run"), F.col("value").alias("text")
    )


def _matches(logs: DataFrame, pattern: str, n_groups: int) -> DataFrame:
    """One row per match with the groups ``g1 … gn``."""
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(f"g{i + 1}") for i in range(n_groups)]
    zipped = logs.select("run", *groups).select("run", F.explode(F.arrays_zip(*[f"g{i + 1}" for i in range(n_groups)])).alias("m"))
    return zipped.select("run", "m.*")


def epochs(logs: DataFrame) -> DataFrame:
    """``(run, epoch, phase, loss, acc)``: a row for each phase that an epoch has."""
    found = _matches(logs, EPOCH, 5)
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("double")
    phases = F.array(
        *[
            F.when(F.col(a) != "", F.struct(F.lit(p).alias("phase"), number(a).alias("loss"), number(b).alias("acc")))
            for p, a, b in (("train", "g2", "g3"), ("val", "g4", "g5"))
        ]
    )
    return found.select("run", F.col("g1").cast("int").alias("epoch"), F.inline(F.array_compact(phases)))


def class_accuracy(logs: DataFrame) -> DataFrame:
    """``(run, class, num_tp, num_total)``."""
    return _matches(logs, CLASS_LINE, 3).select(
        "run", F.col("g1").alias("class"), F.col("g2").cast("bigint").alias("num_tp"), F.col("g3").cast("bigint").alias("num_total")
    )


def overall_accuracy(logs: DataFrame) -> DataFrame:
    """``(run, num_tp, num_total)``."""
    return _matches(logs, OVERALL_LINE, 2).select(
        "run", F.col("g1").cast("bigint").alias("num_tp"), F.col("g2").cast("bigint").alias("num_total")
    )
