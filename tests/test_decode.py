import random
import re

import dense
import pytest
from pyspark.sql import functions as F

from hierspark.functions import paths
from hierspark.operators import decode
from hierspark.operators import dense as arrays
from hierspark.schema import EDGES, SCORES, TRAINED

STRATEGIES = ("sorted", "window", "join")


def score_rows(id_, levels):
    return [(id_, k, x, i, float(p)) for k, probs in enumerate(levels) for i, (x, p) in enumerate(probs.items())]


def edge_rows(kids):
    return [(k, p, c, i) for k, level in enumerate(kids) for p, cs in level.items() for i, c in enumerate(cs)]


def path_list(row):
    return [(x["label"], x["prob"]) for x in row["path"]]


@pytest.fixture(scope="module")
def random_case(spark):
    rng = random.Random(7)
    widths = (4, 9, 15, 24)
    kids = dense.random_tree(rng, widths)
    photos = {f"p{i}": dense.random_scores(rng, widths) for i in range(120)}
    photos["zero"] = [{x: 0.0 for x in range(w)} for w in widths]
    scores = spark.createDataFrame([r for i, s in photos.items() for r in score_rows(i, s)], SCORES).persist()
    edges = spark.createDataFrame(edge_rows(kids), EDGES).persist()
    return photos, kids, scores, edges


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_best_path_equals_dense_decoder(random_case, strategy):
    photos, kids, scores, edges = random_case
    got = {
        r["id"]: (r["start_lvl"], path_list(r), r["conf"])
        for r in decode.best_path(scores, edges, 4, strategy).collect()
    }
    want = {i: dense.best_path(s, kids) for i, s in photos.items()}
    want = {i: w for i, w in want.items() if w}
    assert set(got) == set(want) and "zero" not in got
    for i, (start, path, conf) in want.items():
        assert got[i][0] == start and got[i][1] == path
        assert got[i][2] == pytest.approx(conf, rel=1e-12)
    assert len({w[0] for w in want.values()}) > 2


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("start", [0, 2])
def test_dense_candidates_descend_and_backfill(random_case, strategy, start):
    photos, kids, scores, edges = random_case
    want = {i: dense.walk(s, kids, start) for i, s in photos.items()}
    found = decode.candidates(scores, edges, 4, strategy).filter(F.col("start_lvl") == start).collect()
    assert {r["id"]: path_list(r) for r in found} == {i: w for i, w in want.items() if w}
    down = {r["id"]: path_list(r) for r in decode.descend(scores, edges, 4, start, strategy).collect()}
    up = {r["id"]: path_list(r) for r in decode.backfill(scores, edges, 4, start, strategy).collect()}
    for i, w in want.items():
        if w:
            assert down[i] == w[start:] and up[i] == w[: start + 1]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("thresholds", [(0.5, 0.25, 0.25, 0.25), (0.9, 0.5, 0.0, 0.5)])
def test_gated_descent_and_backfill(random_case, strategy, thresholds):
    photos, kids, scores, edges = random_case
    found = decode.gated_descent(scores, edges, thresholds, strategy)
    got = {r["id"]: r for r in found.collect()}
    filled = {r["id"]: r for r in decode.gated_backfill(found, edges, 4).collect()}
    up = dense.parents_of(kids)
    for i, s in photos.items():
        want, score = dense.gated(s, kids, thresholds)
        assert [got[i][f"l{k}"] for k in range(4)] == [w and w[0] for w in want]
        assert [got[i][f"p{k}"] for k in range(4)] == [w and w[1] for w in want]
        assert got[i]["score"] == pytest.approx(score, rel=1e-12)
        if want[0] is None and want[1] is not None:
            assert filled[i]["l0"] == up[0][want[1][0]]
        assert filled[i]["p0"] == got[i]["p0"] and filled[i]["score"] == got[i]["score"]


def test_score_arrays_equal_dense_decoder(spark, random_case):
    """Arrays share one column order, so every photo gets the order of the first."""
    photos, kids, _, edges = random_case
    order = [list(level) for level in photos["p0"]]
    aligned = {i: [{x: s[k][x] for x in order[k]} for k in range(4)] for i, s in photos.items()}
    trained = spark.createDataFrame([(k, i, x) for k, level in enumerate(order) for i, x in enumerate(level)], TRAINED)
    rows = [(i, k, [float(p) for p in level.values()]) for i, s in aligned.items() for k, level in enumerate(s)]
    stacked = arrays.stack_levels(spark.createDataFrame(rows, "id STRING, lvl INT, probs ARRAY<DOUBLE>"), 4)
    index = arrays.label_index(trained, edges, 4)
    got = {r["id"]: (r["start_lvl"], path_list(r)) for r in arrays.best_path(stacked, index).collect()}
    want = {i: dense.best_path(s, kids) for i, s in aligned.items()}
    assert got == {i: w[:2] for i, w in want.items() if w}
    gate = (0.5, 0.25, 0.0, 0.25)
    found = {r["id"]: [r[f"l{k}"] for k in range(4)] for r in arrays.gated_descent(stacked, index, gate).collect()}
    assert found == {i: [c and c[0] for c in dense.gated(s, kids, gate)[0]] for i, s in aligned.items()}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_ties_follow_column_order_then_child_order(spark, strategy):
    kids = [{1: [12, 11], 2: [21]}]
    levels = [{2: 0.5, 1: 0.5}, {11: 0.4, 12: 0.4, 21: 0.2}]
    scores = spark.createDataFrame(score_rows("a", levels), SCORES)
    edges = spark.createDataFrame(edge_rows(kids), EDGES)
    by_start = {r["start_lvl"]: path_list(r) for r in decode.candidates(scores, edges, 2, strategy).collect()}
    assert by_start[0] == [(2, 0.5), (21, 0.2)]  # label 2 comes first among the columns
    assert by_start[1] == [(1, 0.5), (11, 0.4)]  # label 11 comes first among the columns
    flipped = spark.createDataFrame(score_rows("a", [{1: 0.5, 2: 0.5}, levels[1]]), SCORES)
    down = decode.descend(flipped, edges, 2, 0, strategy).first()
    assert path_list(down) == [(1, 0.5), (12, 0.4)]  # label 12 comes first in the child list


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_equal_candidates_keep_the_shallowest_start(spark, strategy):
    kids = [{1: [11], 2: [21]}]
    scores = spark.createDataFrame(score_rows("a", [{1: 0.6, 2: 0.3}, {11: 0.3, 21: 0.6}]), SCORES)
    edges = spark.createDataFrame(edge_rows(kids), EDGES)
    best = decode.best_path(scores, edges, 2, strategy).first()
    assert best["start_lvl"] == 0 and path_list(best) == [(1, 0.6), (11, 0.3)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_dead_end_and_orphan_drop_only_their_candidate(spark, strategy):
    kids = [{1: [11]}]  # root 2 has no child, leaf 99 has no parent
    scores = spark.createDataFrame(score_rows("a", [{1: 0.1, 2: 0.9}, {11: 0.2, 99: 0.8}]), SCORES)
    edges = spark.createDataFrame(edge_rows(kids), EDGES)
    assert decode.best_path(scores, edges, 2, strategy).count() == 0
    problems = {(r["lvl"], r["label"]): r["problem"] for r in decode.unreachable(scores, edges, 2).collect()}
    assert problems == {(0, 2): "no child", (1, 99): "no parent"}
    scores = spark.createDataFrame(score_rows("a", [{1: 0.1, 2: 0.9}, {11: 0.8, 99: 0.2}]), SCORES)
    best = decode.best_path(scores, edges, 2, strategy).first()
    assert best["start_lvl"] == 1 and path_list(best) == [(1, 0.1), (11, 0.8)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_empty_scores(spark, strategy):
    scores, edges = spark.createDataFrame([], SCORES), spark.createDataFrame([], EDGES)
    assert decode.best_path(scores, edges, 3, strategy).collect() == []
    assert decode.gated_descent(scores, edges, [0.5, 0.5], strategy).collect() == []


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        decode.best_path(spark.createDataFrame([], SCORES), spark.createDataFrame([], EDGES), 2, "guess")


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_of_repeated_rows_the_first_column_counts(spark, strategy):
    rows = [("a", 0, 1, 1, 0.2), ("a", 0, 1, 0, 0.3), ("a", 0, 1, 0, 0.4), ("a", 1, 11, 0, 0.5), ("a", 1, 11, 0, 0.5), ("a", 1, 12, 1, 0.1)]
    edges = spark.createDataFrame(edge_rows([{1: [11, 12]}]), EDGES)
    found = decode.candidates(spark.createDataFrame(rows, SCORES), edges, 2, strategy).collect()
    assert sorted((r["start_lvl"], path_list(r)) for r in found) == [(k, [(1, 0.4), (11, 0.5)]) for k in (0, 1)]


@pytest.mark.parametrize("size", ["1", "7", "10000"])
def test_ids_that_span_batches(spark, random_case, size):
    """Batches smaller than an id, repeated rows, rows without an id, a score or a column, and scores that are no numbers."""
    _, _, scores, edges = random_case
    some = scores.where("id < 'p2'")
    odd = some.where("id < 'p11'").withColumns(
        {"id": F.nullif(F.concat(F.lit("odd"), "id"), F.lit("oddp1")), "prob": F.expr("CASE label % 5 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE prob END"), "ord": F.expr("nullif(ord, 2)")}
    )
    table = some.unionByName(some.withColumn("prob", F.col("prob") / 2)).unionByName(odd).persist()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        for found in (lambda s: decode.best_path(table, edges, 4, s), lambda s: decode.backfill(table, edges, 4, 3, s), lambda s: decode.gated_descent(table, edges, [0.5, 0.25, 0.25, 0.25], s)):
            got, want = ([str(r) for r in found(s).drop("conf", "score").collect()] for s in ("sorted", "window"))
            assert sorted(got) == sorted(want) and got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def cut(spark, probs, thresholds, labels=None):
    labels = labels or [10 * k for k in range(len(probs))]
    path = [(k, x, p) for k, (x, p) in enumerate(zip(labels, probs))]
    row = spark.createDataFrame([("a", path)], "id STRING, path ARRAY<STRUCT<lvl: INT, label: BIGINT, prob: DOUBLE>>")
    r = decode.apply_thresholds(row, thresholds).first()
    return r["rank_lvl"], [x["label"] for x in r["path"]], r["confidence"]


def test_thresholds_are_strict_and_only_cut_below_the_rank(spark):
    # level 1 equals its threshold and fails, level 2 passes, level 3 fails
    rank, kept, conf = cut(spark, [0.9, 0.5, 0.4, 0.1], [0.5, 0.5, 0.3, 0.2])
    assert rank == 2 and kept == [0, 10, 20, None]
    assert conf == pytest.approx((0.9 * 0.4) ** 0.5)


def test_no_level_passes(spark):
    rank, kept, conf = cut(spark, [0.3, 0.2], [0.5, 0.5])
    assert rank is None and kept == [0, 10] and conf == 0.0


def test_levels_pass_but_none_is_strong(spark):
    rank, kept, conf = cut(spark, [0.2, 0.15], [0.1, 0.1])  # 0.2 does not exceed the floor
    assert rank == 1 and kept == [0, 10] and conf is None


def test_default_thresholds_match_five_levels(spark):
    assert len(paths.DEFAULT_THRESHOLDS) == 5
    rank, kept, conf = cut(spark, [0.5, 0.3, 0.25, 0.01, 0.001], paths.DEFAULT_THRESHOLDS)
    assert rank == 3 and kept[4] is None and conf == pytest.approx((0.5 * 0.3 * 0.25) ** (1 / 3))


def test_path_score_expressions(spark):
    path = [(0, 1, 0.5), (1, 2, 0.25)]
    row = spark.createDataFrame([(path,)], "path ARRAY<STRUCT<lvl: INT, label: BIGINT, prob: DOUBLE>>")
    r = row.select(paths.path_product(F.col("path")).alias("a"), paths.path_score(F.col("path")).alias("b")).first()
    assert r["a"] == 0.125 and r["b"] == pytest.approx(0.125**0.5)


def test_tasks_follow_the_number_of_line_items(spark, tmp_path, monkeypatch):
    from hierspark.plans import blocks

    tables = {
        "region": ([(0,), (1,)], "r_regionkey int"), "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(k, k % 2) for k in range(4)], "s_suppkey bigint, s_nationkey int"), "orders": ([(k, k % 5) for k in range(40)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": ([(k % 40, k % 3, float(k % 7 + 1)) for k in range(200)], "l_orderkey bigint, l_suppkey bigint, l_quantity double"),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    def best():
        return decode.best_path(blocks.share_scores(spark, str(tmp_path)), blocks.share_edges(spark, str(tmp_path)), 3)

    few = sorted(map(str, best().collect()))
    monkeypatch.setattr(blocks, "TASK_ITEMS", 5)
    found = best()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # dealt out by id once, in 41 parts; neither the windows nor the walk deal out again
    assert re.findall(r"Exchange hashpartitioning\(id#\d+L, (\d+)\)", plan) == ["41"]
    assert len(few) == 5 and sorted(map(str, found.collect())) == few


def test_all_steps_on_line_items_follow_their_number(spark, tmp_path, monkeypatch):
    from hierspark.operators import skew
    from hierspark.plans import blocks

    tables = {
        "region": ([(0,), (1,)], "r_regionkey int"), "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "supplier": ([(k, k % 2) for k in range(4)], "s_suppkey bigint, s_nationkey int"), "orders": ([(k, k % 5) for k in range(40)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": ([(k % 40, k % 3, float(k % 7 + 1)) for k in range(200)], "l_orderkey bigint, l_suppkey bigint, l_quantity double"),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    def best():
        return decode.best_path(blocks.share_scores(spark, str(tmp_path)), blocks.share_edges(spark, str(tmp_path)), 3)

    few = sorted(map(str, best().collect()))
    monkeypatch.setattr(blocks, "TASK_ITEMS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = best()
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, found.collect()))
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
        salted = sorted(map(str, best().collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # items and orders by order, sums by id and labels, rows by id; suppliers and labels of the hierarchy stay whole, unsliced
    dealt = re.findall(r"Exchange hashpartitioning\((?:id|l_orderkey|o_orderkey)#.*, (\d+)\)", plan)
    assert dealt == ["41"] * 4 and "_salt" not in plan
    assert len(few) == 5 and rows == few and salted == few
