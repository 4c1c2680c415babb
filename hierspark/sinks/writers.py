"""Writers for score tables, matrices, hierarchies and reports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierspark.functions.text import percent_text
from hierspark.operators.labels import look_up
from hierspark.operators.scores import to_arrays
from hierspark.sources.logs import LOG_HEAD


def write_scores(scores: DataFrame, path: str) -> None:
    """Canonical score table: Parquet with one folder per level, so a level is read alone."""
    scores.write.mode("overwrite").partitionBy("lvl").parquet(path)


def score_log_lines(scores: DataFrame, pred: str = "pred", conf: str = "conf") -> DataFrame:
    """Text lines ``file,pred,conf,<scores>`` from one row per id with the array ``probs``."""
    return scores.select(
        F.concat_ws(",", F.col("id").cast("string"), F.col(pred).cast("string"), F.col(conf).cast("string"), _joined("probs")).alias(
            "value"
        )
    )


def write_score_log(
    scores: DataFrame, path: str, labels: Sequence[int], encodings: DataFrame | None = None
) -> None:
    """Score log of one level: text lines under the header ``file,pred,conf,<labels>``.

    ``pred`` is the taxon id of the best label, or the label itself without encodings; a label
    that the encodings lack is an error.  The
    header is one more line of the same folder; readers recognise it by its names.
    """
    rows = to_arrays(scores).withColumn("conf", F.array_max("probs"))
    best = F.element_at("labels", F.array_position("probs", F.col("conf")).cast("int"))
    rows = rows.withColumn("label", best)
    if encodings is not None:
        rows = look_up(rows, encodings, ["lvl", "label"], "taxon_id", spread=["id"]).withColumn("pred", F.col("taxon_id"))
    else:
        rows = rows.withColumn("pred", F.col("label"))
    head = ",".join([*LOG_HEAD, *[str(x) for x in labels]])
    top = scores.sparkSession.createDataFrame([(head,)], "value STRING")
    top.unionByName(score_log_lines(rows)).write.mode("overwrite").text(path)


def write_matrix(rows: DataFrame, path: str, vec: str, names: Sequence[str], key: str = "id") -> None:
    """Matrix CSV: the id, then one column per vector element."""
    head = rows.sparkSession.createDataFrame([(",".join(["photoid", *names]),)], "value STRING")
    lines = rows.select(F.concat_ws(",", F.col(key).cast("string"), _joined(vec)).alias("value"))
    head.unionByName(lines).write.mode("overwrite").text(path)


def write_wide(wide: DataFrame, path: str, key: str = "id") -> None:
    """Combined table as CSV with header; the id column is named ``photoid``."""
    wide.withColumnRenamed(key, "photoid").write.mode("overwrite").csv(path, header=True)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per level and split."""
    rows.write.mode("overwrite").partitionBy("lvl", "split").parquet(path)


def hierarchy_rows(collected: DataFrame, levels: Sequence[str]) -> DataFrame:
    return collected.select(
        level_name(levels, F.col("lvl")).alias("taxon_level"), F.col("parent").alias("label"), F.col("children").alias("child_labels")
    )


def write_hierarchy(collected: DataFrame, path: str, levels: Sequence[str]) -> None:
    """Hierarchy TSV from ``collect_edges`` rows."""
    hierarchy_rows(collected, levels).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_names(names: DataFrame, path: str, levels: Sequence[str]) -> None:
    """Name map TSV."""
    rows = names.select(
        level_name(levels, F.col("lvl")).alias("taxon_level"), F.col("name").alias("taxon_name"), F.col("label").alias("taxon_label")
    )
    rows.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_label_lists(listed: DataFrame, path: str, levels: Sequence[str]) -> None:
    """Label list TSV without header from ``(lvl, labels)`` rows."""
    listed.select(level_name(levels, F.col("lvl")), "labels").write.mode("overwrite").csv(path, sep="\t")


def write_class_accuracy(accuracy: DataFrame, path: str) -> None:
    """``class,accuracy(%),num_tp,num_total``."""
    accuracy.select(
        F.col("true_label").alias("class"),
        percent_text(F.col("num_tp") / F.col("num_total")).alias("accuracy(%)"),
        "num_tp",
        "num_total",
    ).write.mode("overwrite").csv(path, header=True)


def write_report(report: DataFrame, path: str) -> None:
    """Any finished report, such as a submission, as CSV with header."""
    report.write.mode("overwrite").csv(path, header=True)


def level_name(levels: Sequence[str], lvl: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in levels]), lvl + 1)


def _joined(vec: str) -> Column:
    return F.array_join(F.transform(vec, lambda x: x.cast("string")), ",")
