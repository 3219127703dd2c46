"""Masks as tables of runs against bitmaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.functions import masks
from girder.operators import runs

RUNS = "image long, start long, stop long"


def drawn(rng, n=6, height=9, width=7):
    return {i: rng.random((height, width)) < rng.choice([0.0, 0.2, 0.6, 1.0]) for i in range(n)}


def table(spark, bitmaps):
    return spark.createDataFrame([(i, masks.encode(m)) for i, m in bitmaps.items()], "image long, runs array<long>")


def bitmap(rows, height, width):
    flat = np.zeros(height * width, int)
    for start, stop in rows:
        flat[start:stop] += 1
    return flat.reshape((height, width), order="F")


def by_image(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], []).append((r["start"], r["stop"]))
    return out


@pytest.fixture(params=[1 << 20, 5])
def block(request, monkeypatch):
    """Cuts that no mask reaches, and cuts in every mask."""
    monkeypatch.setattr(runs, "BLOCK", request.param)


def test_run_lengths_and_back(spark):
    rng = np.random.default_rng(1)
    bitmaps = drawn(rng) | {90: np.zeros((4, 3), bool), 91: np.ones((4, 3), bool), 92: np.zeros((0, 0), bool)}
    lengths = table(spark, bitmaps).repartition(3)
    rows = runs.length_runs(lengths, ["image"])
    sizes = spark.createDataFrame([(i, m.size) for i, m in bitmaps.items()], "image long, pixels long")
    got = {r["image"]: list(r["runs"]) for r in runs.run_lengths(rows, sizes, ["image"]).collect()}
    assert got == {i: masks.encode(m) for i, m in bitmaps.items()}


def test_unions_and_intersections_equal_bitmaps(spark, block):
    rng = np.random.default_rng(2)
    a, b = drawn(rng), drawn(rng) | {77: np.ones((9, 7), bool)}
    rows_a, rows_b = (runs.length_runs(table(spark, x), ["image"]) for x in (a, b))
    twice = rows_a.unionByName(rows_a).unionByName(rows_b)
    none = np.zeros((9, 7), bool)
    union = by_image(runs.united(twice, ["image"]))
    shared = by_image(runs.intersected(rows_a, rows_b, ["image"]))
    measured = {r["image"]: r for r in runs.coverage(rows_a, rows_b, ["image"]).collect()}
    ious = {r["image"]: r["iou"] for r in runs.overlaps(rows_a, rows_b, ["image"]).collect()}
    for i in a.keys() | b.keys():
        x, y = a.get(i, none), b.get(i, none)
        for got, want in ((union, x | y), (shared, x & y)):
            spans = sorted(got.get(i, []))
            assert (bitmap(spans, 9, 7) == want).all()
            assert all(p[1] < q[0] for p, q in zip(spans, spans[1:], strict=False))  # disjoint and not touching
        if (x | y).any():
            r = measured[i]
            assert (r["reference_pixels"], r["proposal_pixels"], r["shared_pixels"]) == (x.sum(), y.sum(), (x & y).sum())
            assert (r["expected"], r["signalled"]) == (x.any(), y.any()) and ious[i] == (x & y).sum() / (x | y).sum()
        else:
            assert i not in measured


def test_windows_on_a_canvas(spark, block):
    rng = np.random.default_rng(3)
    windows = [(rng.random((5, 4)) < 0.5, x, y) for x, y in [(0, 0), (3, 2), (6, 7), (8, 9), (-2, -1), (20, 0)]]
    rows = spark.createDataFrame([(1, k, x, y, masks.encode(m)) for k, (m, x, y) in enumerate(windows)], "image long, window long, x long, y long, runs array<long>")
    flat = runs.length_runs(rows, ["image", "x", "y"])
    canvas = runs.united(runs.placed(flat, F.lit(5), F.col("x"), F.col("y"), F.lit(12), F.lit(10)), ["image"])
    want = np.zeros((40, 40), bool)
    for m, x, y in windows:
        want[10 + y : 15 + y, 10 + x : 14 + x] |= m
    assert (bitmap(by_image(canvas)[1], 12, 10) == want[10:22, 10:20]).all()
    inside = [w for w in windows if w[1] >= 0 and w[1] < 10]
    only = runs.united(runs.placed(flat.where("x >= 0 and x < 10"), F.lit(5), F.col("x"), F.col("y"), F.lit(12), F.lit(10)), ["image"])
    assert (bitmap(by_image(only)[1], 12, 10) == masks.union_of_windows(12, 10, inside)).all()


def test_boxes_as_runs(spark, block):
    boxes = [(1, (0, 0, 3, 9)), (1, (2, 4, 6, 5)), (1, (2, 4, 6, 5)), (2, (1, 1, 1, 5)), (2, (0, 8, 7, 9))]
    t = spark.createDataFrame(boxes, "image long, box struct<x1:int,y1:int,x2:int,y2:int>")
    got = by_image(runs.united(runs.box_runs(t, ["image"], F.lit(9)), ["image"]))
    for i in (1, 2):
        want = np.zeros((9, 7), bool)
        for k, (x1, y1, x2, y2) in boxes:
            if k == i:
                want[y1:y2, x1:x2] = True
        assert (bitmap(got[i], 9, 7) == want).all()


def test_classes_that_overlap(spark):
    rows = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 12), (1, "b", 8, 14), (2, "a", 0, 4), (3, "b", 0, 4), (3, "c", 0, 4)], "image long, class string, start long, stop long")
    got = {r["image"]: (r["shared"], r["share"]) for r in runs.class_overlaps(rows, ["image"], "class", "a", "b").collect()}
    assert got == {1: (5, 5 / 9), 2: (0, None), 3: (0, None)}


def test_one_giant_image_is_cut_into_blocks(spark):
    n = 40 * runs.BLOCK
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("image"), (F.col("id") * (n // 20_000)).alias("start"), ((F.col("id") + 1) * (n // 20_000)).alias("stop"))
    assert by_image(runs.united(rows, ["image"])) == {1: [(0, 20_000 * (n // 20_000))]}
    assert runs.segments(rows, ["image"], {"_in": F.lit(True)}).select("_block").distinct().count() == 40


def test_no_runs(spark):
    none = spark.createDataFrame([], RUNS)
    assert runs.united(none, ["image"]).count() == runs.intersected(none, none, ["image"]).count() == runs.coverage(none, none, ["image"]).count() == 0
