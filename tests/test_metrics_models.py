"""Metrics, history, reduction, classification."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hierspark.operators import classify, history, metrics, reduce, wide_reduce
from hierspark.schema import SCORES
from hierspark.sources import models


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_accuracy_and_true_vs_pred(spark):
    table = spark.createDataFrame(
        [("a", 0, 1, 0, 0.6), ("a", 0, 2, 1, 0.4), ("b", 0, 1, 0, 0.3), ("b", 0, 2, 1, 0.7), ("c", 0, 1, 0, 1.0)], SCORES
    )
    truth = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("c", 0, 9)], "id STRING, lvl INT, label BIGINT")
    preds = metrics.predictions(table, truth)
    assert rows(metrics.per_class_accuracy(preds), "true_label", "num_tp", "num_total", "accuracy_percent") == [
        (1, 1, 2, 50.0), (9, 0, 1, 0.0),
    ]
    assert rows(metrics.overall_accuracy(preds), "num_tp", "num_total", "percent") == [(1, 3, 33)]
    got = {r["id"]: r for r in metrics.true_vs_pred(table, truth).collect()}
    assert got["b"]["true_prob"] == 0.3 and got["b"]["pred_label"] == 2 and got["b"]["pred_prob"] == 0.7
    assert got["c"]["true_prob"] is None and got["c"]["true_label"] == 9


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 5)), rng.integers(0, 5, 20)
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "logits ARRAY<DOUBLE>, truth INT")
    logp = x - np.log(np.exp(x).sum(1, keepdims=True))
    nll = -logp[np.arange(20), y]
    smoothed = metrics.mean_loss(df, metrics.smoothed_loss(F.col("logits"), F.col("truth"))).first()
    assert smoothed["n_rows"] == 20
    assert smoothed["mean_loss"] == pytest.approx((0.9 * nll + 0.1 * -logp.mean(1)).mean())
    focal = metrics.mean_loss(df, metrics.focal_loss(F.col("logits"), F.col("truth"))).first()["mean_loss"]
    assert focal == pytest.approx(((1 - np.exp(-nll)) ** 2 * nll).mean())


def test_confusion_counts(spark):
    table = spark.createDataFrame([("a", 0, 1, 0, 0.9), ("a", 1, 5, 0, 0.9), ("b", 1, 5, 0, 0.5), ("c", 1, 5, 0, 0.8)], SCORES)
    truth = spark.createDataFrame(
        [("a", 0, 1), ("a", 1, 5), ("b", 1, 5), ("c", 1, 6)], "id STRING, lvl INT, label BIGINT"
    )
    got = {(r["lvl"], r["label"]): r for r in metrics.confusion_at_thresholds(table, truth).collect()}
    assert set(got) == {(0, 1), (1, 5)}  # the tie of id a goes to the shallower level
    assert got[(0, 1)]["tp_p0_8"] == 1 and got[(0, 1)]["fn_p0_9"] == 1
    assert (got[(1, 5)]["tp_p0_5"], got[(1, 5)]["fp_p0_5"], got[(1, 5)]["fn_p0_5"]) == (0, 1, 1)  # 0.5 is not above 0.5


def test_false_positive_threshold_against_sorting(spark):
    rng = random.Random(5)
    neg = [(0, rng.choice([0.0, 0.5, rng.random(), rng.random() ** 9])) for _ in range(3000)] + [(1, 0.25)] * 50
    table = spark.createDataFrame([(f"i{i}", l, 2, 0, p) for i, (l, p) in enumerate(neg)], SCORES)
    truth = spark.createDataFrame([(f"i{i}", l, 1) for i, (l, _) in enumerate(neg)], "id STRING, lvl INT, label BIGINT")
    for rate in (0.0, 0.005, 0.3, 0.9):
        got = {r["lvl"]: (r["n_negatives"], r["threshold"]) for r in metrics.fpr_thresholds(table, truth, rate).collect()}
        for lvl in (0, 1):
            values = sorted((p for l, p in neg if l == lvl), reverse=True)
            assert got[lvl] == (len(values), values[math.floor(rate * len(values))])
            assert sum(v > got[lvl][1] for v in values) <= rate * len(values)


def test_threshold_shuffles_histograms_only(spark):
    """Nearly unique values: what a level's slices need not tell apart is combined before the shuffle."""
    values = spark.range(200_000, numPartitions=4).select(F.lit(0).alias("lvl"), (F.rand(3) * 1e-3).alias("prob")).persist()
    plain = sorted((r["prob"] for r in values.collect()), reverse=True)
    for share in (0.0, 0.005, 0.999):
        found = metrics.kth_largest(values, share, rounds=2, bits=8)
        assert tuple(found.first()) == (0, 200_000, plain[math.floor(share * 200_000)])
    first = values.withColumn("slice", F.floor(F.col("prob") * 256.0)).groupBy("lvl", "slice").count()
    assert first.count() <= 256
    assert metrics.kth_largest(values.limit(0), 0.1).count() == 0


def test_prefix_counts(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 20)], "a INT, b INT")
    got = {(r["lvl"], r["a"], r["b"]): r["n_rows"] for r in metrics.prefix_counts(df, ["a", "b"]).collect()}
    assert got == {(0, 1, None): 3, (0, 2, None): 1, (1, 1, 10): 2, (1, 1, 11): 1, (1, 2, 20): 1}


def test_best_epoch_keeps_the_earliest_tie(spark):
    acc = [0.0, 0.5, 0.5, 0.4, 0.7]
    table = spark.createDataFrame([("r", i, "val", a) for i, a in enumerate(acc)], "run STRING, epoch INT, phase STRING, acc DOUBLE")
    assert [r["saved"] for r in history.best_epochs(table).orderBy("epoch").collect()] == [False, True, False, False, True]
    assert history.best_epoch(table.filter("epoch < 4")).first()["epoch"] == 1
    assert history.best_epoch(table.filter("epoch = 0")).count() == 0
    steps = spark.createDataFrame([("r", 0, "val", 2.0, True), ("r", 0, "val", 4.0, False)], "run STRING, epoch INT, phase STRING, loss DOUBLE, correct BOOLEAN")
    assert rows(history.epoch_history(steps), "n_rows", "loss", "acc") == [(2, 3.0, 0.5)]


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(scale=3, size=(3, 6))
    y = np.arange(150) % 3
    x = centres[y] + rng.normal(size=(150, 6))
    x[:, 5] = 4.0  # a constant column
    table = spark.createDataFrame(
        [(i, v.tolist(), int(10 * c)) for i, (v, c) in enumerate(zip(x, y))], "id BIGINT, vec ARRAY<DOUBLE>, label BIGINT"
    ).persist()
    return x, 10 * y, table


def test_standardise_and_components(spark, clusters, tmp_path):
    x, _, table = clusters
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    got = np.array([r["z"].toArray() for r in reduce.standardise(table).orderBy("id").collect()])
    assert np.allclose(got, z)
    model = reduce.fit(table, 3)
    loadings = reduce.loadings(model)
    assert np.allclose(loadings.T @ loadings, np.eye(3), atol=1e-9)
    assert (loadings[np.abs(loadings).argmax(axis=0), range(3)] > 0).all()
    pc = np.array([r["pc"] for r in reduce.project(table, model).orderBy("id").collect()])
    assert np.allclose(pc, z @ loadings) and np.allclose(pc.mean(axis=0), 0, atol=1e-9)
    ratio = [r["ratio"] for r in reduce.variance_table(spark, model).orderBy("component").collect()]
    assert np.allclose(ratio, pc.var(axis=0) / z.var(axis=0).sum())
    part = table.filter("id < 40")
    self_z = x[:40] - x[:40].mean(axis=0)
    self_z = self_z / np.where(x[:40].std(axis=0) == 0, 1, x[:40].std(axis=0))
    own = np.array([r["pc"] for r in reduce.project(part, model, fit_scale="self").orderBy("id").collect()])
    assert np.allclose(own, self_z @ loadings)
    models.save_models({"genus": model}, str(tmp_path), "PCA")
    loaded = models.load_models(str(tmp_path), ["genus"], "PCA")["genus"]
    again = np.array([r["pc"] for r in reduce.project(table, loaded).orderBy("id").collect()])
    assert np.allclose(again, pc)


def test_single_row_standardises_to_zero(spark):
    one = spark.createDataFrame([(1, [3.0, 4.0])], "id BIGINT, vec ARRAY<DOUBLE>")
    assert reduce.standardise(one).first()["z"].toArray().tolist() == [0.0, 0.0]


def test_regression_reaches_the_penalised_optimum(spark, clusters, tmp_path):
    x, y, table = clusters
    model = classify.fit(table)
    weights = {(r["label"], r["pos"]): r["weight"] for r in classify.coefficients(spark, model).collect()}
    w = np.array([[weights[(c, j)] for j in range(6)] for c in (0, 10, 20)])
    b = np.array([weights[(c, -1)] for c in (0, 10, 20)])
    logits = x @ w.T + b
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = (p - (y[:, None] == np.array([0, 10, 20]))).T @ x + w
    assert np.abs(gradient).max() < 0.05 * np.abs(x).sum() / 150
    scored = classify.score(table, model, lvl=2)
    got = np.zeros((150, 3))
    for r in scored.collect():
        got[r["id"], r["ord"]] = r["prob"]
        assert r["label"] == 10 * r["ord"] and r["lvl"] == 2
    assert np.allclose(got, p, atol=1e-6)
    pred = np.array([r["pred_label"] for r in classify.predict(table, model).orderBy("id").collect()])
    assert (pred == 10 * p.argmax(1)).all()
    models.save_models({"genus": model}, str(tmp_path), "logistic")
    loaded = models.load_models(str(tmp_path), ["genus"], "logistic")["genus"]
    unlabelled = table.drop("label")
    assert classify.score_levels(unlabelled, {2: loaded}).count() == 450


def test_folds_are_stratified_and_cv_reports(spark, clusters):
    _, y, table = clusters
    folded = classify.stratified_folds(table, k=4).persist()
    sizes = rows(folded.groupBy("label", "fold").count(), "label", "fold", "count")
    assert [s[2] for s in sizes] == [13, 13, 12, 12] * 3
    assert folded.select("id").distinct().count() == 150
    accuracies = classify.cross_validate(folded)
    report = classify.cv_report(spark, accuracies, 0.5).first()
    assert report["n_folds"] == 4 and report["acc_mean"] == pytest.approx(np.mean(accuracies))
    assert report["acc_std"] == pytest.approx(np.std(accuracies)) and report["validation_acc"] == 0.5
    assert report["acc_mean"] > 0.8


def test_softmax_is_linear_in_the_width(spark):
    import time

    import numpy as np

    from hierspark.functions import probs

    width = 2537
    rows = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.sin(k * 0.7 + F.col("id")) * 30).alias("x")).repartition(4).cache()
    rows.count()
    begun = time.time()
    got = rows.select("x", probs.softmax(F.col("x")).alias("p"), probs.log_sum_exp(F.col("x")).alias("l"), probs.mean_log_prob(F.col("x")).alias("m")).limit(200).collect()
    assert time.time() - begun < 20
    for r in got[:20]:
        x = np.array(r["x"])
        want = np.exp(x - x.max())
        whole = np.log(want.sum()) + x.max()
        assert np.allclose(r["p"], want / want.sum()) and np.isclose(r["l"], whole) and np.isclose(r["m"], (x - whole).mean())


def test_softmax_of_null_and_empty(spark):
    from hierspark.functions import probs

    row = spark.sql("select cast(null as array<double>) a, cast(array() as array<double>) b, array(1e308, -1e308) c").select(*(probs.softmax(F.col(c)).alias(c) for c in "abc")).first()
    assert row["a"] is None and row["b"] == [] and row["c"] == [1.0, 0.0]


def test_gradient_certifies_a_fit(spark, clusters):
    x, y, table = clusters
    rough, good = classify.fit(table, max_iter=2), classify.fit(table, max_iter=500, tol=1e-12)
    weights = {(r["label"], r["pos"]): r["weight"] for r in classify.coefficients(spark, rough).collect()}
    w = np.array([[weights[(c, j)] for j in range(6)] for c in (0, 10, 20)])
    b = np.array([weights[(c, -1)] for c in (0, 10, 20)])
    p = np.exp(x @ w.T + b)
    p /= p.sum(1, keepdims=True)
    off = p - (y[:, None] == np.array([0, 10, 20]))
    want = np.sqrt((((off.T @ x) + w) ** 2).sum(1) + off.sum(0) ** 2) / 150
    got = {r["label"]: (r["n_rows"], r["norm"]) for r in classify.gradient(table, rough).collect()}
    assert [got[c][0] for c in (0, 10, 20)] == [150] * 3
    assert np.allclose([got[c][1] for c in (0, 10, 20)], want, rtol=1e-6) and want.max() > 1e-3
    assert max(r["norm"] for r in classify.gradient(table, good).collect()) < 1e-5


def test_folds_fitted_together_are_as_fitted_alone(spark, clusters):
    _, _, table = clusters
    folded = classify.stratified_folds(table, k=3)
    alone = [classify.accuracy(folded.filter(f"fold = {f}"), classify.fit(folded.filter(f"fold <> {f}"))) for f in range(3)]
    assert classify.cross_validate(folded, parallelism=3) == classify.cross_validate(folded, parallelism=1) == alone


@pytest.mark.parametrize("fall", [0.97, 1.0])
def test_wide_components_equal_numpy(spark, fall):
    """Variances that fall off need few passes; flat ones go on until the blocks span the space."""
    rng = np.random.default_rng(4)
    n, width, k = 900, 150, 12
    x = (rng.normal(size=(n, width)) * fall ** np.arange(width)) @ np.linalg.qr(rng.normal(size=(width, width)))[0] + 3
    x[:, 7] = 2.0
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id INT, vec ARRAY<DOUBLE>").repartition(5).persist()
    fitted = wide_reduce.fit(table, k, extra=8)
    z = np.divide(x - x.mean(0), x.std(0), out=np.zeros_like(x), where=x.std(0) > 1e-9)
    values, vectors = np.linalg.eigh(z.T @ z)
    values, vectors = values[::-1], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
    assert np.abs(fitted.loadings - vectors).max() < 1e-6 and np.allclose(fitted.ratio, values[:k] / values.sum())
    assert fitted.passes < 8 if fall < 1 else fitted.passes <= 9
    got = wide_reduce.project(table.unionByName(spark.createDataFrame([(-1, None)], table.schema)), fitted).orderBy("id").collect()
    assert got[0]["pc"] is None and np.allclose([r["pc"] for r in got[1:]], z @ vectors, atol=1e-5)
    assert wide_reduce.residuals(table, fitted).where("residual < 1e-6 and n_rows = 900").count() == k
