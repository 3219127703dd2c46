"""Evaluations against masks, from the masks' files on."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_photos import png

from girder.functions import masks
from girder.functions.rules import Refused
from girder.operators import runs
from girder.plans import masked, photos


def rectangle(top, left, height, width, shape=(64, 64)):
    m = np.zeros(shape, bool)
    m[top : top + height, left : left + width] = True
    return m


@pytest.fixture
def external(spark, tmp_path):
    """Three records' masks as files, and the tables of files and records."""
    shapes = {"a": rectangle(0, 0, 20, 20), "b": rectangle(10, 10, 5, 7, (40, 64)), "c": np.zeros((64, 64), bool)}
    records = []
    for name, m in shapes.items():
        raw = png((m * 255).astype(np.uint8))
        (tmp_path / f"{name}.png").write_bytes(raw)
        records.append((name, f"g{name}", m.shape[1], m.shape[0], hashlib.sha256(raw).hexdigest(), int(m.sum())))
    files = photos.read_photos(spark, str(tmp_path)).withColumn("id", F.regexp_extract("id", r"([a-z]+)\.png$", 1))
    table = spark.createDataFrame(records, "id string, content_group string, width int, height int, mask_sha256 string, foreground_pixels long")
    return shapes, files, table, tmp_path


def test_an_external_source_from_bytes_to_coverage(spark, external):
    shapes, files, records, _ = external
    references = masked.reference_runs(files, records)
    sums = {r["id"]: r["n"] for r in references.groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).collect()}
    assert sums == {"a": 400, "b": 35}
    proposals = [("a", "crack", 900, rectangle(0, 0, 10, 20)), ("a", "crack", 500, rectangle(5, 0, 10, 20)), ("a", "crack", 100, rectangle(0, 0, 64, 64)), ("a", "mold", 900, rectangle(0, 0, 64, 64)), ("c", "crack", 800, rectangle(1, 1, 2, 2))]
    table = spark.createDataFrame([(i, k, s, masks.encode(m)) for i, k, s, m in proposals], "id string, class string, score long, runs array<long>")
    details, totals = masked.external_evaluation(records, references, table, "crack", 300)
    got = {r["id"]: (r["proposals"], r["retained_proposals"], r["reference_pixels"], r["proposal_pixels"], r["shared_pixels"], r["expected"], r["signalled"]) for r in details.collect()}
    assert got == {"a": (3, 2, 400, 300, 300, True, True), "b": (0, 0, 35, 0, 0, True, False), "c": (1, 1, 0, 4, 0, False, True)}
    t = totals.first()
    assert (t["photos"], t["expected"], t["found"], t["signalled"], t["without_reference"], t["photo_recall"], t["zone_precision"]) == (3, 2, 1, 2, 1, 0.5, 300 / 304)
    short = spark.createDataFrame([("b", "crack", 900, [64 * 64])], "id string, class string, score long, runs array<long>")
    with pytest.raises(Refused, match="does not match"):
        masked.external_evaluation(records, references, short, "crack", 300)


@pytest.mark.parametrize(("change", "rule"), [("value", "not_binary"), ("colour", "unsupported_mask"), ("digest", "changed"), ("count", "other_foreground"), ("size", "other_size"), ("gone", "missing")])
def test_reference_masks_must_be_what_records_say(spark, external, change, rule):
    shapes, files, records, folder = external
    raw = (shapes["a"] * 255).astype(np.uint8)
    if change == "value":
        raw[5, 5] = 128
    content = png(np.repeat(raw[..., None], 3, axis=2)) if change == "colour" else png(raw)
    (folder / "a.png").write_bytes(content)
    sha = "0" * 64 if change == "digest" else hashlib.sha256(content).hexdigest()
    a = F.col("id") == "a"
    records = records.withColumn("mask_sha256", F.when(a, sha).otherwise(F.col("mask_sha256")))
    if change == "count":
        records = records.withColumn("foreground_pixels", F.col("foreground_pixels") + a.cast("long"))
    if change == "size":
        records = records.withColumn("width", F.when(a, 63).otherwise(F.col("width")))
    if change == "gone":
        files = files.where(~a)
    with pytest.raises(Refused, match=rule):
        masked.reference_runs(files, records)


def test_photos_through_windows(spark):
    rng = np.random.default_rng(4)
    grid = [(0, 0), (30, 0), (0, 30), (30, 30)]
    rows, whole = [], {"crack": np.zeros((64, 64), bool), "mold": np.zeros((64, 64), bool)}
    for n, (x, y) in enumerate(grid):
        for k in ("crack", "mold"):
            for score in (200, 700):
                m = rng.random((34, 34)) < 0.2
                rows.append((1, 64, 64, x, y, 34, 34, k, score, len(rows), masks.encode(m), (1.0, 1.0, 20.0, 20.0)))
                if score >= 300:
                    whole[k][y : y + 34, x : x + 34] |= m
    windows = spark.createDataFrame(rows, "image long, image_width int, image_height int, x int, y int, width int, height int, class string, score long, pos long, runs array<long>, box struct<x1:double,y1:double,x2:double,y2:double>")
    truth = rectangle(10, 10, 30, 30)
    references = runs.length_runs(spark.createDataFrame([(1, "crack", masks.encode(truth))], "image long, class string, runs array<long>"), ["image", "class"])
    out = masked.windowed_evaluation(references, windows, 1, 300)
    sizes = spark.createDataFrame([(1, "crack", 4096), (1, "mold", 4096)], "image long, class string, pixels long")
    zones = {r["class"]: list(r["runs"]) for r in runs.run_lengths(out["zones"], sizes, ["image", "class"]).collect()}
    assert zones == {k: masks.encode(m) for k, m in whole.items()}
    got = {r["class"]: (r["reference_pixels"], r["proposal_pixels"], r["shared_pixels"]) for r in out["coverage"].collect()}
    assert got == {"crack": (900, whole["crack"].sum(), (whole["crack"] & truth).sum()), "mold": (0, whole["mold"].sum(), 0)}
    assert {r["class"]: r["merged_from"] for r in out["proposals"].collect()} == {"crack": 1, "mold": 1} and out["proposals"].count() == 8
    with pytest.raises(Refused, match="window"):
        masked.windowed_evaluation(references, windows.withColumn("width", F.lit(33)), 1, 300)


def test_alerts_of_patches(spark):
    patches = spark.createDataFrame([(i, f"g{i // 2}", "clear" if i < 4 else "cracked") for i in range(8)], "patch long, grp string, arm string")
    proposals = spark.createDataFrame([(0, "crack", 900), (0, "crack", 400), (1, "crack", 200), (2, "mold", 900), (4, "crack", 300), (5, "crack", 800)], "patch long, class string, score long")
    each, rates = masked.patch_alerts(patches, proposals, "crack", 300)
    assert {r["patch"]: r["alerts"] for r in each.collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, 7: 0}
    assert {r["arm"]: (r["patches"], r["groups"], r["with_alert"], r["rate"]) for r in rates.collect()} == {"clear": (4, 2, 1, 0.25), "cracked": (4, 2, 2, 0.5)}
    with pytest.raises(Refused, match="unknown patch"):
        masked.patch_alerts(patches.where("patch < 5"), proposals, "crack", 300)
