"""Hierarchy tables, score tables, combining, labels, skewed joins."""

import pytest
from pyspark.sql import functions as F

from hierspark.functions import ids, probs, text
from hierspark.operators import combine, hierarchy, labels, scores, skew
from hierspark.schema import EDGES, ENCODINGS, SCORES, TRAINED


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_edges_keep_first_seen_order_and_counts(spark):
    flat = spark.createDataFrame([(5, 1, 20, 7), (6, 1, 10, 8), (7, 1, 20, 7), (8, 2, 30, 9)], "pos INT, a INT, b INT, c INT")
    edges = hierarchy.edges_from_truth(flat, ["a", "b", "c"], "pos")
    assert rows(edges, "lvl", "parent", "child", "ord", "n_rows") == [
        (0, 1, 10, 6, 1), (0, 1, 20, 5, 2), (0, 2, 30, 8, 1), (1, 10, 8, 6, 1), (1, 20, 7, 5, 2), (1, 30, 9, 8, 1),
    ]
    collected = hierarchy.collect_edges(edges)
    assert (0, 1, "20,10") in rows(collected, "lvl", "parent", "children")
    back = hierarchy.explode_edges(collected)
    assert rows(back, "lvl", "parent", "child") == rows(edges, "lvl", "parent", "child")
    assert (0, 1, 20, 0) in rows(back, "lvl", "parent", "child", "ord")


def test_edges_from_backbone_need_the_rank_directly_above(spark):
    ranks = ["family", "genus", "species"]
    taxa = [
        (1, [0], "family", "F"), (2, [0, 1], "genus", "G"), (3, [0, 1, 2], "species", "G s"),
        (4, [0, 1], "species", "lost"),  # last ancestor is a family
        (5, [0, 1, 9], "species", "unknown parent"), (6, [0, 1, 2], "variety", "other rank"), (7, [0, 1, 2], "species", "not encoded"),
    ]
    backbone = spark.createDataFrame(
        [(*t, i) for i, t in enumerate(taxa)], "taxon_id BIGINT, ancestry ARRAY<BIGINT>, rank STRING, name STRING, position BIGINT"
    )
    enc = spark.createDataFrame([(0, 10, 1), (1, 20, 2), (2, 30, 3), (2, 40, 4), (2, 50, 5)], ENCODINGS)
    edges = hierarchy.edges_from_backbone(backbone, enc, ranks)
    assert rows(edges, "lvl", "parent", "child") == [(0, 10, 20), (1, 20, 30)]
    names = hierarchy.names_from_backbone(backbone, enc, ranks)
    assert rows(names, "lvl", "name", "label") == [
        (0, "F", 10), (1, "G", 20), (2, "G s", 30), (2, "lost", 40), (2, "unknown parent", 50),
    ]


def test_integrity_and_trained_labels(spark):
    edges = spark.createDataFrame([(0, 1, 10, 0), (0, 2, 10, 0), (0, 2, 20, 1)], EDGES)
    assert rows(hierarchy.check_edges(edges), "lvl", "child", "n_parents") == [(0, 10, 2)]
    with pytest.raises(ValueError, match="more than one parent"):
        hierarchy.check_edges(edges, strict=True)
    trained = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 10), (1, 1, 99)], TRAINED)
    assert rows(hierarchy.trained_edges(edges, trained), "parent", "child") == [(1, 10), (2, 10)]
    assert rows(hierarchy.dead_ends(edges, trained, 2), "lvl", "label") == [(0, 3)]
    assert rows(hierarchy.orphans(edges, trained), "lvl", "label") == [(1, 99)]
    assert rows(hierarchy.duplicates(edges, ["lvl", "parent"]), "parent", "n_rows") == [(2, 2)]


def test_top1_topk_and_floors(spark):
    table = spark.createDataFrame(
        [("a", 0, 7, 1, 0.4), ("a", 0, 9, 0, 0.4), ("a", 0, 8, 2, 0.2), ("b", 0, 7, 1, 0.1), ("b", 0, 9, 0, 0.0)], SCORES
    )
    assert rows(scores.top1(table), "id", "label", "prob") == [("a", 9, 0.4), ("b", 7, 0.1)]
    assert rows(scores.topk(table, 2), "id", "rank", "label") == [("a", 1, 9), ("a", 2, 7), ("b", 1, 7), ("b", 2, 9)]
    trained = spark.createDataFrame([(0, i, x) for i, x in enumerate((9, 7, 8, 1, 2))], TRAINED)
    assert sorted(r[0] for r in scores.floor_scores(table, 0.2).select("prob").collect()) == [0, 0, 0.2, 0.4, 0.4]
    assert sorted(r[0] for r in scores.floor_scores(table, 2, trained).select("prob").collect()) == [0, 0, 0.2, 0.4, 0.4]
    assert scores.floor_scores(table, 0) is table


def test_wide_and_back(spark):
    table = spark.createDataFrame([("a", 0, 1, 0, 0.25), ("a", 1, 5, 0, 0.5), ("b", 0, 2, 1, 1.0)], SCORES)
    columns = [(0, 1), (0, 2), (1, 5)]
    wide = scores.combine_wide(table, columns, ["class", "order"], fill=0.0)
    assert wide.columns == ["id", "class_1", "class_2", "order_5"]
    assert scores.with_dummies(wide).columns[:6] == ["id", "dum1", "dum2", "dum3", "dum4", "dum5"]
    long = scores.melt_wide(wide, ["class", "order"])
    assert rows(long.filter("prob > 0"), "id", "lvl", "label", "ord", "prob") == rows(table, *table.columns)
    assert long.count() == 6
    assert scores.combine_wide(table, columns, ["class", "order"]).filter("id = 'b'").first()["class_1"] is None


def test_arrays_and_back(spark):
    table = spark.createDataFrame([("a", 0, 5, 1, 0.25), ("a", 0, 3, 0, 0.5), ("a", 1, 9, 0, 1.0)], SCORES)
    packed = scores.to_arrays(table)
    assert rows(packed, "lvl", "labels", "probs") == [(0, [3, 5], [0.5, 0.25]), (1, [9], [1.0])]
    again = scores.from_arrays(packed.filter("lvl = 0"), "probs", 0, labels="labels")
    assert rows(again, *table.columns) == rows(table.filter("lvl = 0"), *table.columns)


def test_dedupe_and_union(spark):
    table = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z"), ("a", 3, None)], "k STRING, t INT, v STRING")
    assert rows(scores.first_wins(table, ["k"], ["t"]), "k", "v") == [("a", "x"), ("b", "z")]
    assert {tuple(r) for r in scores.last_wins(table, ["k"], ["t"]).select("k", "v").collect()} == {("a", None), ("b", "z")}
    both = scores.union_all([table, table.select("v", "t", "k")])
    assert both.columns == ["k", "t", "v"] and both.count() == 8


def test_levels_and_row_counts(spark):
    table = spark.createDataFrame([("a", 0, 1, 0, 0.5), ("a", 0, 2, 1, 0.5), ("a", 1, 1, 0, 1.0), ("b", 0, 1, 0, 1.0)], SCORES)
    assert rows(combine.level_counts(table), "id", "n_lvls") == [("a", 2), ("b", 1)]
    assert rows(combine.incomplete(table, 2), "id", "n_lvls") == [("b", 1)]
    with pytest.raises(ValueError, match="without all 2 levels"):
        combine.incomplete(table, 2, strict=True)
    levels = [table.filter(F.col("lvl") == k) for k in range(2)]
    assert {r["id"] for r in combine.combine_levels(levels).collect()} == {"a"}
    assert rows(combine.completeness(table), "n_lvls", "n_ids") == [(1, 1), (2, 1)]
    assert rows(combine.row_counts(table), "lvl", "n_ids", "parity") == [(0, 2, False), (1, 1, False)]
    with pytest.raises(ValueError, match="different numbers"):
        combine.check_row_counts(table)
    assert combine.check_row_counts(table.filter("id = 'a'")).filter("parity").count() == 2


def test_truth_of_tiles(spark):
    table = spark.createDataFrame([("1_a.jpg", 0, 1, 0, 0.5), ("1_b.jpg", 0, 1, 0, 0.6), ("2.jpg", 0, 1, 0, 0.7)], SCORES)
    truth = spark.createDataFrame([("1", 4)], "id STRING, true_label BIGINT")
    tiles = combine.with_original(table, "_")
    assert rows(combine.truth_join(tiles, truth), "id", "orig_id", "true_label", "prob") == [
        ("1_a.jpg", "1", 4, 0.5), ("1_b.jpg", "1", 4, 0.6),
    ]
    assert rows(combine.truth_unmatched(tiles, truth), "id", "orig_id") == [("2.jpg", "2")]


def test_level_tables_and_splits(spark):
    table = spark.createDataFrame([("1", 3, 4, 0.5), ("2", 3, 5, 0.25)], "id STRING, class INT, order INT, class_3 DOUBLE")
    members = spark.createDataFrame([("1", "train"), ("9", "valid")], "id STRING, split STRING")
    one = combine.keep_level(combine.assign_split(table, members), "order", ["class", "order"])
    assert one.columns == ["id", "order", "class_3", "split"] and rows(one, *one.columns) == [("1", 4, 0.5, "train")]


def test_labels(spark):
    lists = spark.createDataFrame([(0, "1,10,2")], "lvl INT, labels STRING")
    assert rows(labels.explode_label_list(lists), "pos", "label") == [(0, 1), (1, 10), (2, 2)]
    assert rows(labels.explode_label_list(lists, numeric_order=True), "pos", "label") == [(0, 1), (1, 2), (2, 10)]
    index = labels.class_index(spark.createDataFrame([(x,) for x in (2, 10, 1, 2)], "x INT"), "x")
    assert rows(index, "class_label", "class_idx") == [("1", 0), ("10", 1), ("2", 2)]
    trained, enc = labels.explode_label_list(lists), spark.createDataFrame([(0, 10, 777), (0, 1, 888)], ENCODINGS)
    out = spark.createDataFrame([("a", 0, 1)], "id STRING, lvl INT, pos INT")
    assert rows(labels.decode_output(out, trained, enc), "id", "label", "taxon_id") == [("a", 10, 777)]
    taxa = spark.createDataFrame([(0, 888), (0, 5)], "lvl INT, taxon_id BIGINT")
    assert rows(labels.encode(taxa, enc, strict=False), "taxon_id", "label") == [(888, 1)]
    with pytest.raises(Exception, match="no label for lvl=0, taxon_id=5"):
        labels.encode(taxa, enc).collect()
    with pytest.raises(Exception, match="no label for lvl=0, pos=7"):
        labels.decode_output(spark.createDataFrame([("a", 0, 7)], "id STRING, lvl INT, pos INT"), trained, enc).collect()
    assert rows(labels.missing_keys(taxa, enc, ["lvl", "taxon_id"]), "taxon_id") == [(5,)]


def test_salted_join_equals_plain_join(spark):
    large = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")  # three hot keys
    small = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "k BIGINT, v STRING")
    got = skew.salted_join(large, small, ["k"], ["id"], salts=4)
    assert rows(got, "k", "id", "v") == rows(large.join(small, "k"), "k", "id", "v")
    left = skew.salted_join(large, small, ["k"], ["id"], salts=4, how="left")
    assert left.count() == 1000 and left.filter("v IS NULL").count() == 333
    with pytest.raises(ValueError):
        skew.salted_join(large, small, ["k"], ["id"], salts=6)


def test_ids(spark):
    names = ["7_original.jpg", "7-aug12.jpg", "7_001-002.JPEG", "7.png", "a.b.txt", "noext"]
    df = spark.createDataFrame([(n,) for n in names], "f STRING")
    photo = ids.photo_id(F.col("f"))
    got = df.select(photo.alias("p"), ids.original_id(photo, "_").alias("o"), ids.strip_original(photo).alias("s"), ids.is_image(F.col("f")).alias("i")).collect()
    assert [r["p"] for r in got] == ["7_original", "7-aug12", "7_001-002", "7", "a", "noext"]
    assert [r["o"] for r in got] == ["7", "7-aug12", "7", "7", "a", "noext"]
    assert [r["s"] for r in got] == ["7", "7-aug12", "7_001-002", "7", "a", "noext"]
    assert [r["i"] for r in got] == [True, True, True, True, False, False]
    log = spark.createDataFrame([("log_inference_genus_effnet.pth",)], "f STRING")
    assert log.select(ids.log_level(F.col("f")), ids.is_score_log(F.col("f"))).first() == ("genus", True)


def test_percent_text_equals_printf(spark):
    import random

    rng = random.Random(3)
    values = [0.0, 1.0, 0.33125, 0.00125, 0.01015, 0.999999, 0.125, 0.005, 0.00005, 0.00015, 0.5, 1 / 3]
    values += [rng.random() for _ in range(300)] + [n / 640 for n in range(200)] + [rng.random() / 1000 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in df.select(text.percent_text(F.col("v"))).collect()]
    assert got == ["%.2f" % (v * 100) for v in values]
    assert spark.createDataFrame([(None,)], "v DOUBLE").select(text.percent_text(F.col("v"))).first()[0] is None
    words = spark.createDataFrame([("Acer rubrum",), ("Acer",), ("",)], "n STRING")
    assert [r[0] for r in words.select(text.last_word(F.col("n"))).collect()] == ["rubrum", "Acer", ""]


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, -2000.0],)], "x ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(probs.softmax(F.col("x"))).collect()]
    assert got == [[0.5, 0.5], [1.0, 0.0]]
    floored = spark.createDataFrame([([0.25, 0.5, 0.2, 0.05],)], "x ARRAY<DOUBLE>").select(probs.floor_uniform(F.col("x")))
    assert floored.first()[0] == [0.25, 0.5, 0.0, 0.0]


def test_a_label_with_two_parents_is_an_error(spark):
    edges = spark.createDataFrame([(0, 1, 11, 0), (0, 2, 11, 0)], "lvl INT, parent BIGINT, child BIGINT, ord INT")
    with pytest.raises(Exception, match="two parents of label 11"):
        hierarchy.nodes(edges).collect()


def test_uniform_floor_needs_trained_labels(spark):
    table = spark.createDataFrame([("a", 1, 1, 0, 0.5)], "id STRING, lvl INT, label BIGINT, ord INT, prob DOUBLE")
    with pytest.raises(Exception, match="no trained label at level 1"):
        scores.floor_uniform(table, spark.createDataFrame([(0, 0, 5)], "lvl INT, pos INT, label BIGINT")).collect()
