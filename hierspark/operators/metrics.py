"""Accuracy, losses, confusion counts and thresholds."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hierspark.functions import probs
from hierspark.operators.scores import best, top1

# Fixed values.
SMOOTHING = 0.1
FOCAL_GAMMA = 2.0
CONFUSION_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
FALSE_POSITIVE_RATE = 0.005


def predictions(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """``(id, lvl, true_label, pred_label)`` of ids with a truth row."""
    top = top1(scores).select("id", "lvl", F.col("label").alias("pred_label"))
    return top.join(truth.withColumnRenamed("label", "true_label"), ["id", "lvl"]).select(
        "id", "lvl", "true_label", "pred_label"
    )


def _hit() -> Column:
    return F.sum(F.when(F.col("true_label") == F.col("pred_label"), 1).otherwise(0))


def per_class_accuracy(preds: DataFrame) -> DataFrame:
    """``(lvl, true_label, accuracy_percent, num_tp, num_total)``; classes without rows are absent."""
    return (
        preds.groupBy("lvl", "true_label")
        .agg(_hit().alias("num_tp"), F.count(F.lit(1)).alias("num_total"))
        .withColumn("accuracy_percent", F.lit(100.0) * F.col("num_tp") / F.col("num_total"))
    )


def overall_accuracy(preds: DataFrame) -> DataFrame:
    """``(lvl, num_tp, num_total, accuracy, percent)``; ``percent`` is cut, not rounded."""
    return (
        preds.groupBy("lvl")
        .agg(_hit().alias("num_tp"), F.count(F.lit(1)).alias("num_total"))
        .withColumns(
            {
                "accuracy": F.col("num_tp") / F.col("num_total"),
                "percent": F.floor(F.lit(100.0) * F.col("num_tp") / F.col("num_total")),
            }
        )
    )


def smoothed_loss(logits: Column, truth: Column, smoothing: float = SMOOTHING) -> Column:
    """Cross-entropy against ``1 - smoothing`` on the true class plus ``smoothing`` spread evenly."""
    nll = -probs.log_prob(logits, truth)
    even = -probs.mean_log_prob(logits)
    return F.lit(1.0 - smoothing) * nll + F.lit(smoothing) * even


def focal_loss(logits: Column, truth: Column, gamma: float = FOCAL_GAMMA) -> Column:
    log_p = probs.log_prob(logits, truth)
    return -F.pow(F.lit(1.0) - F.exp(log_p), F.lit(gamma)) * log_p


def mean_loss(rows: DataFrame, loss: Column) -> DataFrame:
    """One row ``(n_rows, mean_loss)``; the mean over rows equals batch means weighted by size."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(loss).alias("mean_loss"))


def true_vs_pred(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """True label with the score it got and best label with its score, per id and level.

    Both come from one aggregation of the scores once the true label is marked on its row;
    a true label that was not scored has a ``NULL`` score.
    """
    marked = scores.join(truth.withColumn("_true", F.lit(True)), ["id", "lvl", "label"], "left")
    seen = marked.groupBy("id", "lvl").agg(
        best("label").alias("b"), F.max(F.when(F.col("_true"), F.col("prob"))).alias("true_prob")
    )
    return seen.join(truth.withColumnRenamed("label", "true_label"), ["id", "lvl"]).select(
        "id",
        "lvl",
        "true_label",
        "true_prob",
        F.col("b.label").alias("pred_label"),
        F.col("b.prob").alias("pred_prob"),
    )


def confusion_at_thresholds(
    scores: DataFrame, truth: DataFrame, thresholds: Sequence[float] = CONFUSION_THRESHOLDS
) -> DataFrame:
    """TP, FP and FN counts per (level, label) of the best label over *all* levels of an id.

    A best score at or below the threshold is an FN, otherwise a TP or an FP.  The counts of
    all thresholds are made in one pass, in columns such as ``tp_p0_5``.  Ties between
    levels go to the shallower level, inside a level to the smaller ``ord``.
    """
    order = F.struct("prob", (-F.col("lvl")).alias("_l"), (-F.col("ord")).alias("_o"), "lvl", "label")
    top = scores.groupBy("id").agg(F.max(order).alias("b")).select("id", "b.lvl", "b.label", "b.prob")
    judged = top.join(truth.withColumnRenamed("label", "true_label"), ["id", "lvl"])
    correct = F.col("label") == F.col("true_label")
    aggs = []
    for name in ("tp", "fp", "fn"):
        for t in thresholds:
            above = F.col("prob") > F.lit(float(t))
            case = {"tp": above & correct, "fp": above & ~correct, "fn": ~above}[name]
            aggs.append(F.sum(F.when(case, 1).otherwise(0)).alias(f"{name}_p{str(t).replace('.', '_')}"))
    return judged.groupBy("lvl", "label").agg(*aggs)


def fpr_thresholds(scores: DataFrame, truth: DataFrame, rate: float = FALSE_POSITIVE_RATE) -> DataFrame:
    """Per level the smallest observed negative score t with ``share of negatives > t`` at most ``rate``.

    Negatives are the scores of labels that are not the true one.  With n negatives in
    descending order t is the one at zero-based rank ``floor(rate·n)``.
    """
    judged = scores.join(truth.withColumnRenamed("label", "true_label"), ["id", "lvl"])
    return kth_largest(judged.filter(F.col("label") != F.col("true_label")).select("lvl", "prob"), rate)


def kth_largest(values: DataFrame, share: float, rounds: int = 2, bits: int = 16) -> DataFrame:
    """Exact order statistic per ``lvl`` of values ``(lvl, prob)`` in [0, 1], from the raw rows.

    Radix selection by histograms: each round counts ``2^bits`` slices of the interval still in
    question, combined before their shuffle, and keeps the one that holds the wanted rank.  So a
    task gives out, and a window sees, at most ``2^bits`` rows per level, however many values
    there are.  Scaling by powers of two is exact.  At the end the distinct values of one slice
    of width ``2^-(rounds·bits)`` are counted and ordered.
    """
    wanted = F.floor(F.lit(share) * F.col("total"))
    rest = values.select("lvl", "prob", *(F.lit(None).cast("bigint").alias(c) for c in ("total", "rank")))
    for r in range(1, rounds + 1):
        rest = rest.withColumn("slice", F.floor(F.col("prob") * F.lit(float(1 << (bits * r)))))
        counts = rest.groupBy("lvl", "slice").agg(
            F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.max("rank").alias("rank")
        )
        if r == 1:
            whole = Window.partitionBy("lvl")
            counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("rank", wanted)
        # one row per level
        kept = _holding_rank(counts, "slice").select("lvl", "slice", "total", "rank")
        rest = rest.drop("total", "rank").join(F.broadcast(kept), ["lvl", "slice"])
    last = rest.groupBy("lvl", "prob").agg(
        F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.max("rank").alias("rank")
    )
    return _holding_rank(last, "prob").select("lvl", F.col("total").alias("n_negatives"), F.col("prob").alias("threshold"))


def _holding_rank(counts: DataFrame, by: str) -> DataFrame:
    """The row per level that holds zero-based ``rank`` in descending order; ``rank`` becomes relative to it."""
    down = Window.partitionBy("lvl").orderBy(F.desc(by))
    before = F.sum("n").over(down) - F.col("n")
    return (
        counts.withColumn("_before", before)
        .filter((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("n")))
        .withColumn("rank", F.col("rank") - F.col("_before"))
        .drop("_before")
    )


def prefix_counts(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows per label prefix: for each level k one group per distinct ``(l0, …, lk)``."""
    sets = [[F.col(c) for c in levels[: k + 1]] for k in range(len(levels))]
    depth = F.grouping_id().alias("_gid")
    counted = rows.groupingSets(sets, *levels).agg(depth, F.count(F.lit(1)).alias("n_rows"))
    lvl = F.lit(len(levels) - 1) - F.bit_count("_gid")
    return counted.select(lvl.cast("int").alias("lvl"), *levels, "n_rows")
