"""Hilbert order, zone maps and hard negatives against brute force."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from hierspark.llm import hard_negatives as hn


def test_curve_goes_from_cell_to_cell():
    for dims, bits in ((2, 3), (3, 2), (2, 4), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hn.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(keys)
        walked = cells[np.argsort(np.array(keys, object))]
        assert (np.abs(np.diff(walked, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-300, 300, (50, 6)), rng.integers(-300, 300, (9, 6))
    own = hn.Zones(None, "", [(0, 0)], np.zeros((1, 2)), rows.min(0)[None], rows.max(0)[None])
    least, most = own.bounds(anchors)
    scores = anchors @ rows.T
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= most[:, 0]).all()


def test_products_are_exact():
    a, b = np.array([[1 << 24, (1 << 24) - 1]]), np.array([[1 << 24, 3], [-(1 << 24), 1]])
    big, rng = np.full((2, 200), (1 << 24) - 1, np.int64), np.random.default_rng(2)
    big[1] = rng.integers(-(1 << 24), 1 << 24, 200)
    for x, y in ((a, b), (big, big[:, ::-1].copy())):
        assert hn.products(x, y).tolist() == [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in y] for r in x]


def plain(rows, rule, every):
    good = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in (r for r in good if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][: rule.positives]:
            fits = [x for x in scored if x[2] != lab and -rule.low_percent * s <= -100 * x[0] <= -rule.high_percent * s][: rule.negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fits, 1)]
    return sorted(out)


def test_mined_rows_against_brute_force(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, rng.choice([0, 1, 2, None] if i % 9 == 0 else [0, 1, 2]), [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(400)]
    # ties and copies, one hot vector, a label of one row, awkward vectors and ids
    rows += [(1000 + i, i % 3, centres[0]) for i in range(120)] + [(2000, 77, centres[1]), (2010, 1, None), (2020, 1, [1.0, None, 0.0, 0.0, 0.0]), (2030, 1, [float("nan")] * 5), (2040, 0, [float("inf")] * 5)]
    rows += [(None, 1, centres[2]), (2050, 2, [0.0] * 5), (2060, 0, []), (2070, 1, [2.0, -1.0]), (2051, 1, [1e-9] * 5)]
    docs = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumns({"key": F.lit("x"), "span": F.lit(1)}).repartition(6)
    rounded = [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    for rule, size in ((hn.Windows(), 4096), (hn.Windows(3, 4, 50, 100), 16)):
        got = sorted(tuple(r) for r in hn.mine(docs, F.col("id") % 10 == 0, rule, block_rows=size).collect())
        assert got == plain(rounded, rule, 10) and got


def test_zone_maps_spare_blocks():
    rng = np.random.default_rng(4)
    far = np.concatenate([rng.integers(0, 10, (64, 3)) + c for c in ([0, 0, 0], [1000, 0, 0], [0, 1000, 0], [0, 0, 1000])])

    class Kept(hn.Zones):
        def read(self, at):
            part = slice(at * 64, at * 64 + 64)
            return np.arange(256)[part], np.zeros(64, np.int64), far[part]

    blocks = far.reshape(4, 64, 3)
    own = Kept(None, "", [(0, k) for k in range(4)], np.zeros((4, 2), np.int64), blocks.min(1), blocks.max(1))
    best = hn.Best(5, -(1 << 62), 1 << 62)
    assert hn.search(own, np.array([[10, 0, 0]]), [-1], np.array([0]), [[best]], True) == 1
    assert best.scores.tolist() == sorted((far @ np.array([10, 0, 0])).tolist(), reverse=True)[:5]


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert hn.mine(none, F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(10, 1, [1.0])], "vec_id bigint, label int, embedding array<float>")
    assert hn.mine(one, F.col("id") % 10 == 0).count() == 0
