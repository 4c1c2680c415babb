"""Text formats, folders, reports: written or laid out here and read back."""

import os

import pytest
from pyspark.sql import functions as F

from hierspark.operators import combine, decode, hierarchy, metrics, report, scores
from hierspark.schema import EDGES, NAMES, SCORES
from hierspark.sinks import writers
from hierspark.sources import files, logs, meta, trainlog


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)


@pytest.fixture()
def log_folder(tmp_path):
    put(f"{tmp_path}/log_inference_class_a.pth", "file,pred,conf,1,10,2\nx.jpg,77,0.5,0.5,0.3,0.2\ny.jpg,77,0.6,0.1,0.6,0.3\n")
    put(f"{tmp_path}/log_inference_order_a.pth", "file,pred,conf,4,5\nx.jpg,9,0.9,0.9,0.1\ny.jpg,9,0.7,0.3,0.7\n")
    put(f"{tmp_path}/log_inference_order_b.pth", "file,pred,conf,4,5\nz.jpg,9,1.0,1.0,0.0\n")
    put(f"{tmp_path}/readme.txt", "not a log\n")
    return str(tmp_path)


def test_score_logs(spark, log_folder):
    got = logs.read_score_logs(spark, log_folder, ["class", "order"])
    assert got.schema.names == ["id", "lvl", "label", "ord", "prob"]
    assert rows(got.filter("id = 'x.jpg'"), "lvl", "label", "ord", "prob") == [
        (0, 1, 0, 0.5), (0, 2, 2, 0.2), (0, 10, 1, 0.3), (1, 4, 0, 0.9), (1, 5, 1, 0.1),
    ]
    assert got.count() == 12 and got.filter("id = 'z.jpg'").count() == 2
    trained = {"class": ["1", "10", "2"], "order": ["4", "5"]}
    arrays = logs.read_score_arrays(spark, log_folder, ["class", "order"], trained)
    assert ("y.jpg", 0, [0.1, 0.6, 0.3]) in [tuple(r) for r in arrays.collect()] and arrays.count() == 5
    with pytest.raises(ValueError, match="genus"):
        logs.read_score_logs(spark, log_folder, ["class", "genus"])


def test_every_log_has_its_own_header_and_the_first_line_wins(spark, tmp_path):
    put(f"{tmp_path}/log_inference_class_a.csv", "file,pred,conf,1,2\nx.jpg,1,0.9,0.9,0.1\n")
    put(f"{tmp_path}/log_inference_class_b.csv", "file,pred,conf,2,1\ny.jpg,1,0.8,0.2,0.8\nx.jpg,1,0.5,0.5,0.5\ny.jpg,1,0.8,0.8,0.2\n")
    put(f"{tmp_path}/log_inference_order_a.csv", "file,pred,conf,7\nx.jpg,7,1.0,1.0\n")
    got = logs.read_score_logs(spark, str(tmp_path), ["class", "order"])
    assert rows(got.filter("lvl = 0"), "id", "label", "prob") == [("x.jpg", 1, 0.9), ("x.jpg", 2, 0.1), ("y.jpg", 1, 0.8), ("y.jpg", 2, 0.2)]
    assert rows(combine.incomplete(got, 2), "id") == [("y.jpg",)]
    with pytest.raises(Exception, match="headers differ in log_inference_class_b.csv"):
        logs.read_score_arrays(spark, str(tmp_path), ["class", "order"], {"class": ["1", "2"], "order": ["7"]}).collect()


def test_merged_log_needs_trained_labels(spark, tmp_path):
    put(f"{tmp_path}/log_inference_class_m.txt", "file,pred,conf,probs\nx.jpg,7,0.5,0.5,0.5\n")
    got = logs.read_score_logs(spark, str(tmp_path), ["class"], trained={"class": ["3", "8"]})
    assert rows(got, "id", "label", "prob") == [("x.jpg", 3, 0.5), ("x.jpg", 8, 0.5)]


def test_wrong_width(spark):
    lines = spark.createDataFrame([("file,pred,conf,1,2",), ("x,7,0.5,0.5",), ("y,7,0.5,0.5,0.5",)], "value STRING")
    with pytest.raises(Exception, match="expected 5 fields, line has 4"):
        logs.parse_lines(lines, ["1", "2"], 0).collect()
    assert rows(logs.bad_width(lines, 2), "id", "n_fields") == [("x", 4)]
    assert logs.parse_lines(lines, ["1", "2"], 0, strict=False).count() == 2


def test_matrices_and_features(spark, tmp_path):
    put(f"{tmp_path}/a.csv", ",1,2\np1,0.25,0.75\n")
    put(f"{tmp_path}/b.csv", "photoid,5\np1,1.0\n")
    got = logs.read_probability_matrices(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    assert rows(got, "id", "lvl", "label", "prob") == [("p1", 0, 1, 0.25), ("p1", 0, 2, 0.75), ("p1", 1, 5, 1.0)]
    put(f"{tmp_path}/f.csv", "photoid,dum1,class_1,class_2\np1,0,0.25,0.75\np2,0,1.0,0.0\n")
    features = logs.read_features(spark, f"{tmp_path}/f.csv", ["dum1"])
    assert [tuple(r) for r in features.orderBy("id").collect()] == [("p1", "0", [0.25, 0.75]), ("p2", "0", [1.0, 0.0])]


def test_written_log_and_matrix_read_back(spark, tmp_path):
    table = spark.createDataFrame([("x", 0, 5, 0, 0.25), ("x", 0, 3, 1, 0.75), ("y", 0, 5, 0, 1.0), ("y", 0, 3, 1, 0.0)], SCORES)
    enc = spark.createDataFrame([(0, 5, 500), (0, 3, 300)], "lvl INT, label BIGINT, taxon_id BIGINT")
    writers.write_score_log(table, f"{tmp_path}/log", [5, 3], enc)
    lines = logs.read_lines(spark, f"{tmp_path}/log")
    assert rows(logs.parse_lines(lines, ["5", "3"], 0), *table.columns) == rows(table, *table.columns)
    assert "x,300,0.75,0.25,0.75" in [r["value"] for r in lines.collect()]
    writers.write_matrix(spark.createDataFrame([("p", [1.5, 2.0])], "id STRING, pc ARRAY<DOUBLE>"), f"{tmp_path}/m", "pc", ["0", "1"])
    got = logs.parse_lines(logs.read_lines(spark, f"{tmp_path}/m"), ["0", "1"], 0, logs.MATRIX_HEAD)
    assert rows(got, "id", "label", "prob") == [("p", 0, 1.5), ("p", 1, 2.0)]
    writers.write_scores(table, f"{tmp_path}/s")
    assert os.path.isdir(f"{tmp_path}/s/lvl=0") and spark.read.parquet(f"{tmp_path}/s").count() == 4
    wide = scores.with_dummies(scores.combine_wide(table, [(0, 5), (0, 3)], ["class"]))
    writers.write_wide(wide, f"{tmp_path}/w")
    assert spark.read.csv(f"{tmp_path}/w", header=True).columns[:3] == ["photoid", "dum1", "dum2"]


def test_metadata_files(spark, tmp_path):
    put(f"{tmp_path}/enc0", "1 47124\n2 47163\n")
    put(f"{tmp_path}/enc1", "1 900\n")
    assert rows(meta.read_encodings(spark, [f"{tmp_path}/enc0", f"{tmp_path}/enc1"]), "lvl", "label", "taxon_id") == [
        (0, 1, 47124), (0, 2, 47163), (1, 1, 900),
    ]
    put(f"{tmp_path}/labels", "class\t1,10,2\norder\t7\n")
    assert rows(meta.read_trained(spark, f"{tmp_path}/labels"), "lvl", "pos", "label") == [(0, 0, 1), (0, 1, 10), (0, 2, 2), (1, 0, 7)]
    assert rows(meta.read_trained(spark, f"{tmp_path}/labels", numeric_order=True), "lvl", "pos", "label")[1] == (0, 1, 2)
    put(f"{tmp_path}/truth", ",id,kingdom,phylum,class,order,family,genus,species,filename\n0,699721,1,1,1,2,3,4,5,/d/699721.jpg\n")
    wide = meta.read_truth(spark, f"{tmp_path}/truth")
    assert rows(meta.truth_long(wide), "id", "lvl", "label") == [("699721", k, k + 1) for k in range(5)]
    edges = hierarchy.edges_from_truth(wide.withColumn("pos", F.lit(0)), ["kingdom", "phylum", "class", "order"], "pos")
    assert rows(edges, "lvl", "parent", "child") == [(0, 1, 1), (1, 1, 1), (2, 1, 2)]
    put(f"{tmp_path}/names", "taxon_level\ttaxon_name\ttaxon_label\nclass\tPinopsida\t1\nphylum\tX\t1\n")
    assert rows(meta.read_names(spark, f"{tmp_path}/names"), "lvl", "label", "name") == [(0, 1, "Pinopsida")]
    put(f"{tmp_path}/names2", "taxon_level\ttaxon_name\ttaxon_label\nclass\tA\t1\nclass\tB\t1\n")
    with pytest.raises(ValueError, match="more than one name"):
        meta.read_names(spark, f"{tmp_path}/names2")
    put(f"{tmp_path}/taxa", "taxon_id\tancestry\trank_level\trank\tname\n5\t1/2\t10\tspecies\tA b\n1\t\t70\tkingdom\tK\n")
    got = {r["taxon_id"]: r for r in meta.read_backbone(spark, f"{tmp_path}/taxa").collect()}
    assert got[5]["ancestry"] == [1, 2] and got[5]["rank"] == "species"


def test_hierarchy_file_round_trip_and_errors(spark, tmp_path):
    put(f"{tmp_path}/h", "taxon_level\tlabel\tchild_labels\nphylum\t1\t1,2\nclass\t1\t3,1\nclass\t2\t2\n")
    edges = meta.read_edges(spark, f"{tmp_path}/h")
    assert rows(edges, "lvl", "parent", "child", "ord") == [(0, 1, 1, 1), (0, 1, 3, 0), (0, 2, 2, 0)]
    assert meta.read_edges(spark, f"{tmp_path}/h", ("phylum", "class")).filter("lvl = 0").count() == 2
    writers.write_hierarchy(hierarchy.collect_edges(edges), f"{tmp_path}/out", ["class"])
    assert rows(meta.read_edges(spark, f"{tmp_path}/out"), *edges.columns) == rows(edges, *edges.columns)
    put(f"{tmp_path}/twice", "taxon_level\tlabel\tchild_labels\nclass\t1\t3\nclass\t1\t4\n")
    with pytest.raises(ValueError, match="more than one line"):
        meta.read_edges(spark, f"{tmp_path}/twice")
    put(f"{tmp_path}/loose", "taxon_level\tlabel\tchild_labels\nclass\t1\t3\nclass\t2\t3\n")
    with pytest.raises(ValueError, match="more than one parent"):
        meta.read_edges(spark, f"{tmp_path}/loose")
    assert meta.read_edges(spark, f"{tmp_path}/loose", strict=False).count() == 2
    writers.write_names(spark.createDataFrame([(0, 1, "A")], NAMES), f"{tmp_path}/n", ["class"])
    assert rows(meta.read_names(spark, f"{tmp_path}/n"), "label", "name") == [(1, "A")]
    writers.write_label_lists(spark.createDataFrame([(0, "1,2")], "lvl INT, labels STRING"), f"{tmp_path}/l", ["class"])
    assert meta.read_trained(spark, f"{tmp_path}/l").count() == 2


def test_folders(spark, tmp_path):
    for name in ("flat/7_original.JPG", "flat/8.png", "flat/notes.txt", "sub/12/9.jpg", "sub/3/10.jpeg", "sub/3/11.JPG"):
        put(f"{tmp_path}/{name}", "image")
    assert rows(files.file_catalog(spark, f"{tmp_path}/flat"), "file_name", "photo_id") == [("7_original.JPG", "7_original"), ("8.png", "8")]
    assert rows(files.file_catalog(spark, f"{tmp_path}/sub", depth=1), "folder", "file_name") == [
        ("12", "9.jpg"), ("3", "10.jpeg"), ("3", "11.JPG"),
    ]
    with pytest.raises(ValueError, match="directory depth"):
        files.file_catalog(spark, f"{tmp_path}/sub", depth=2)
    assert rows(files.split_folder(spark, f"{tmp_path}/sub", "train"), "id", "label", "split") == [("9", "12", "train")]


LOG = """Epoch 0/1
----------
train Loss: 1.5000 Acc: 0.2500
val Loss: 1.2500 Acc: 0.5000
saving best model so far

Epoch 1/1
----------
train Loss: 1.0000 Acc: 0.7500
val Loss: 1.1250 Acc: 0.4000

Training complete in 0m 3s
Test Loss: 0.900000

Test Accuracy of    12: 50% ( 1/ 2)
Test Accuracy of     3: 100% (10/10)
Test Accuracy of     4: N/A (no training examples)

Test Accuracy (Overall): 91% (11/12)
"""


def test_training_log(spark, tmp_path):
    put(f"{tmp_path}/run_a", LOG)
    table = trainlog.read_logs(spark, str(tmp_path))
    assert rows(trainlog.epochs(table), "run", "epoch", "phase", "loss", "acc") == [
        ("run_a", 0, "train", 1.5, 0.25), ("run_a", 0, "val", 1.25, 0.5), ("run_a", 1, "train", 1.0, 0.75), ("run_a", 1, "val", 1.125, 0.4),
    ]
    assert rows(trainlog.class_accuracy(table), "class", "num_tp", "num_total") == [("12", 1, 2), ("3", 10, 10)]
    assert rows(trainlog.overall_accuracy(table), "num_tp", "num_total") == [(11, 12)]


def test_submission_rows(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 10, 0), (1, 10, 100, 0)], EDGES)
    table = spark.createDataFrame(
        [("a.jpg", 0, 1, 0, 0.9), ("a.jpg", 1, 10, 0, 0.5), ("a.jpg", 2, 100, 0, 0.4), ("b.jpg", 0, 1, 0, 0.9), ("b.jpg", 1, 10, 0, 0.5), ("b.jpg", 2, 100, 0, 0.1)],
        SCORES,
    )
    names = spark.createDataFrame([(0, 1, "Fagaceae, family"), (1, 10, "Quercus"), (2, 100, "Quercus alba")], NAMES)
    phyla = spark.createDataFrame([(1, "Tracheophyta")], "label BIGINT, phylum STRING")
    ranks = ("family", "genus", "species")
    best = decode.best_path(table, edges, 3)
    cut = decode.apply_thresholds(best, (0.5, 0.3, 0.3))
    out = report.submission(report.named_paths(cut, names, phyla, 3), "E7", "dir/E7/", ranks)
    assert tuple(out.columns) == report.SUBMISSION_COLUMNS and len(out.columns) == 26
    got = {r["clip_file_path"]: r for r in out.collect()}
    a, b = got["dir/E7/a.jpg"], got["dir/E7/b.jpg"]
    assert (a["phylum"], a["family"], a["genus"], a["species"]) == ("Tracheophyta", "Fagaceae, family", "Quercus", "alba")
    assert (a["scientific_name"], a["taxon_rank"]) == ("Quercus alba", "species")
    assert a["confidence_percent"] == "%.2f" % (100 * (0.9 * 0.5 * 0.4) ** (1 / 3)) and a["notes"] == "NA"
    assert (b["species"], b["scientific_name"], b["taxon_rank"]) == ("", "Quercus ", "genus")
    assert b["confidence_percent"] == "%.2f" % (100 * (0.9 * 0.5) ** 0.5) and b["class"] == ""
    short = report.submission_short(report.named_paths(best, names, phyla, 3), ranks)
    assert tuple(short.columns) == report.SHORT_COLUMNS
    assert {r["species_epithet"] for r in short.collect()} == {"alba"}
    assert report.debug_paths(best, ranks).columns == ["photoid", *ranks, *[f"p_{r}" for r in ranks]]
    writers.write_report(out, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    none = decode.apply_thresholds(best, (0.95, 0.95, 0.95))
    plain = report.submission(report.named_paths(none, names, phyla, 3), "E7", "d", ranks).first()
    assert (plain["taxon_rank"], plain["confidence_percent"], plain["species"]) == ("", "0.00", "alba")


def test_class_accuracy_file(spark, tmp_path):
    preds = spark.createDataFrame([("a", 0, 1, 1), ("b", 0, 1, 2), ("c", 0, 1, 2)], "id STRING, lvl INT, true_label BIGINT, pred_label BIGINT")
    writers.write_class_accuracy(metrics.per_class_accuracy(preds), f"{tmp_path}/acc")
    got = spark.read.csv(f"{tmp_path}/acc", header=True)
    assert got.columns == ["class", "accuracy(%)", "num_tp", "num_total"] and tuple(got.first()) == ("1", "33.33", "1", "3")


def test_split_sink(spark, tmp_path):
    table = spark.createDataFrame([("a", 0, "train", 1), ("b", 0, "valid", 2)], "id STRING, lvl INT, split STRING, label INT")
    writers.write_splits(table, f"{tmp_path}/sp")
    assert os.path.isdir(f"{tmp_path}/sp/lvl=0/split=valid")


def test_lines_of_logs_are_not_shuffled(spark):
    """Lines meet their headers by broadcasts, and only scores other than 0 are shuffled with the first line of an id."""
    made = [("x", 0, 0, 0, "file,pred,conf,7,8,9"), ("x", 0, 1, 0, "a.jpg,7,0.0,0.0, 0,0.00"), ("x", 0, 2, 0, "a.jpg,7,1,1.0,0.0,0.0"), ("x", 0, 3, 0, "b.jpg,9,-0.5,0.0,-0.5,NaN"), ("x", 0, 4, 0, "c.jpg,9,0,0,,0.0")]
    lines = spark.createDataFrame(made[:4], "file_name string, block int, line int, lvl int, value string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = logs.log_arrays(lines)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert sorted(map(str, map(tuple, found.collect()))) == ["('a.jpg', 0, [7, 8, 9], [0.0, 0.0, 0.0])", "('b.jpg', 0, [7, 8, 9], [0.0, -0.5, nan])"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for bad, message in (((("x", 0, 9, 0, "a.jpg,7,1,1.0,0.0"),), "expected 6 fields"), ((("z", 0, 9, 0, "d.jpg,7,1,1.0"),), "no header in z"), ((made[4],), "CAST_INVALID_INPUT")):
        with pytest.raises(Exception, match=message):  # lines that lose are checked as well
            logs.log_arrays(lines.unionByName(spark.createDataFrame(bad, lines.schema))).collect()


def test_lines_of_logs_meet_no_names_of_their_header(spark):
    """Without listed labels a line meets the number of its header's names; the labels are read once a header."""
    made = [("x", 0, 0, 0, "file,pred,conf,7, 8"), ("x", 0, 1, 0, "a.jpg,7,0.5, 0.5,0.0"), ("y", 0, 0, 1, "file,pred,conf,probs")]
    lines = spark.createDataFrame(made, "file_name string, block int, line int, lvl int, value string")
    found = logs.log_arrays(lines)
    assert [tuple(r) for r in found.collect()] == [("a.jpg", 0, [7, 8], [0.5, 0.0])]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [x for x in plan if "_f#" in x] and not [x for x in plan if "_names#" in x and "_f#" in x]
    bad = spark.createDataFrame([("y", 0, 1, 1, "a.jpg,7,1.0,1.0")], lines.schema)
    with pytest.raises(Exception, match="labels that are no numbers: probs"):
        logs.log_arrays(lines.unionByName(bad)).collect()
