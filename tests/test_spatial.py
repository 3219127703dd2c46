"""Meeting pairs and the assignment in rounds against brute force and the fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from girder.operators import integrity, matching, spatial

BOX = "box struct<x1:double,y1:double,x2:double,y2:double>"


def drawn(rng, n, size, side, images=3, grid=True):
    rows = []
    for i in range(n):
        x, y = rng.uniform(-5, size), rng.uniform(-5, size)
        w, h = rng.uniform(0, side), rng.uniform(0, side)
        box = (x, y, x + w, y + h)
        rows.append((rng.randint(1, images), i, tuple(map(float, map(round, box))) if grid else box))
    return rows


def meeting(a, b):
    inside = lambda p, q: max(p[0], q[0]) < min(p[2], q[2]) and max(p[1], q[1]) < min(p[3], q[3])
    return sorted((i, x, y) for i, x, p in a for j, y, q in b if i == j and inside(p, q))


@pytest.mark.parametrize("tried", [100_000, 200, 1])
def test_pairs_are_met_once(spark, tried):
    rng = random.Random(tried)
    a, b = drawn(rng, 150, 60, 9), drawn(rng, 150, 60, 25)
    a += [(1, 900 + i, (10.0, 10.0, 12.0, 12.0)) for i in range(30)]  # a crowd in one place
    b += [(1, 900, (-5.0, -5.0, 90.0, 90.0)), (1, 901, (3.0, 3.0, 3.0, 9.0)), (2, 902, None), (9, 903, (0.0, 0.0, 1.0, 1.0))]
    tables = [spark.createDataFrame(t, f"image long, pos long, {BOX}").withColumn("_side", F.lit("clash")).repartition(3) for t in (a, b)]
    got = spatial.meeting_pairs(*tables, ["image"], tried).select("image", "a.pos", F.col("b.pos").alias("q")).collect()
    assert sorted(map(tuple, got)) == meeting(a, [x for x in b if x[2] and x[2][0] < x[2][2]])


def test_pairs_at_the_borders_of_cells(spark):
    cells = [(1, 10 * i + j, (float(i), float(j), i + 1.0, j + 1.0)) for i in range(8) for j in range(8)]
    t = spark.createDataFrame(cells, f"image long, pos long, {BOX}")
    wide = spark.createDataFrame([(1, k, (x, y, x + 2.0, y + 1.5)) for k, (x, y) in enumerate([(0.0, 0.0), (2.0, 3.5), (6.0, 6.5), (3.5, 4.0)])], f"image long, pos long, {BOX}")
    got = spatial.meeting_pairs(t, wide, ["image"], 2).select("image", "a.pos", F.col("b.pos").alias("q")).collect()
    assert sorted(map(tuple, got)) == meeting(cells, [(r["image"], r["pos"], tuple(r["box"])) for r in wide.collect()])


def test_one_image_of_many_boxes(spark):
    def spread(n, seed):
        x, y = F.floor(F.rand(seed) * 20_000), F.floor(F.rand(seed + 1) * 20_000)
        return spark.range(n).select(F.lit(1).cast("long").alias("image"), F.lit("a").alias("class"), F.col("id").alias("pos"), F.floor(F.rand(seed + 2) * 50).alias("score"), x.alias("x"), y.alias("y")).select("image", "class", "pos", "score", F.struct(F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + 60.0).alias("x2"), (F.col("y") + 60.0).alias("y2")).alias("box"))

    a, b = (spread(100_000, k) for k in (1, 7))
    began = time.time()
    n = spatial.meeting_pairs(a, b, ["image"]).count()
    assert 0.8 * 1e10 * (120 / 20_000) ** 2 < n < 1.2 * 1e10 * (120 / 20_000) ** 2
    assert time.time() - began < 120


def rows_of(df):
    return sorted(map(tuple, df.select("image", "class", "pred_pos", "score", "ref_pos", "reason", "best_iou", "matched_iou").collect()), key=str)


@pytest.mark.parametrize(("rounds", "tried"), [(16, 100_000), (1, 20), (0, 100_000)])
def test_rounds_equal_the_fold(spark, rounds, tried):
    rng = random.Random(rounds)
    p = [(i, rng.choice("ab"), k, rng.randint(0, 6), b) for i, k, b in drawn(rng, 300, 14, 12)]
    r = [(i, rng.choice("ab"), k, b) for i, k, b in drawn(rng, 150, 14, 12)]
    p += [(5, "a", k, 3, (0.0, 0.0, 4.0, 4.0)) for k in range(40)] + [(6, "b", 1, 2, (0.0, 0.0, 1.0, 1.0))]
    r += [(5, "a", k, (0.0, 0.0, 4.0, 4.0)) for k in range(25)]
    pt = spark.createDataFrame(p, f"image long, class string, pos long, score long, {BOX}").repartition(3)
    rt = spark.createDataFrame(r, f"image long, class string, pos long, {BOX}").repartition(2)
    assert rows_of(spatial.match_boxes(pt, rt, tried=tried, rounds=rounds)) == rows_of(matching.match_boxes(pt, rt))


def test_a_chain_of_claims_is_finished_by_the_fold(spark):
    """Each prediction must wait for the one before it, so a round takes a single pair."""
    n = 400
    edges = [(1, "a", n - k, k, ref, iou) for k in range(n) for ref, iou in ((k, 0.9), (k + 1, 0.6))] + [(1, "a", n - k, k, k - 1, 0.95) for k in range(1, n)]
    table = spark.createDataFrame(edges, "image long, class string, score long, pos long, ref long, iou double")
    got = {(r["pos"], r["ref"]) for r in spatial.assigned(table, rounds=5).collect()}
    assert got == {(k, k) for k in range(n)}
    assert spatial.assigned(table.limit(0)).count() == 0


def test_a_group_of_many_predictions(spark):
    n = 50_000
    line = lambda m, score: spark.range(m).select(F.lit(1).cast("long").alias("image"), F.lit("a").alias("class"), F.col("id").alias("pos"), (F.col("id") * 7919 % 1000).alias("score"), F.struct((F.col("id") * score).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * score + 10).cast("double").alias("x2"), F.lit(10.0).alias("y2")).alias("box"))
    got = spatial.match_boxes(line(n, 3), line(n // 2, 6)).groupBy("reason").count().collect()
    by = {r["reason"]: r["count"] for r in got}
    assert sum(by.values()) == n and by["matched"] == n // 2 and set(by) <= {"matched", "duplicate", "insufficient_overlap", "no_overlap"}


def test_crops_and_lost_areas(spark):
    rng = random.Random(5)
    crops, boxes = drawn(rng, 80, 50, 9), drawn(rng, 60, 50, 9)
    c = spark.createDataFrame(crops, f"image long, crop_id long, {BOX}")
    b = spark.createDataFrame(boxes, f"image long, pos long, {BOX}")
    assert sorted(spatial.crop_conflicts(c, b, 10).collect()) == sorted(integrity.crop_conflicts(c, b).collect())
    got = {(r["analysis"], r["idx"]): r["lost"] for r in spatial.lost_areas(c.select(F.col("image").alias("analysis"), F.col("crop_id").alias("idx"), "box"), b.select(F.col("image").alias("analysis"), "box"), 10).collect()}
    want = {}
    for i, x, y in meeting(crops, boxes):
        p, q = next(k[2] for k in crops if k[1] == x), next(k[2] for k in boxes if k[1] == y)
        want[i, x] = want.get((i, x), 0) + (min(p[2], q[2]) - max(p[0], q[0])) * (min(p[3], q[3]) - max(p[1], q[1]))
    assert got == want
