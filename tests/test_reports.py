"""Report tables, findings from photo to dossier, exporters and mask agreement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.functions import masks
from girder.functions.geometry import box
from girder.functions.rules import Refused
from girder.operators import findings, reports
from girder.sinks import exports
from girder.sources import labels

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_flags_and_totals(spark):
    t = spark.createDataFrame([(0, [0.9, None], 0, 0.0), (2, [0.8, None], 3, 0.95), (1, [0.85], 0, None)], "n int, ious array<double>, away int, overlap double")
    got = [r[0] for r in t.select(reports.review_flags(F.col("n"), F.col("ious"), F.col("away"), F.col("overlap"))).collect()]
    assert got == [["empty_annotations"], ["mask_iou_below_review_threshold", "mask_difference_away_from_boundary", "source_classes_almost_fully_overlap"], []]
    assert tuple(reports.disagreement_totals(spark.createDataFrame([(1, 0), (2, 5)], "id int, differing int")).first()) == (2, 1, 5)


def test_partitions_cards_and_credits(spark):
    p = spark.createDataFrame([("a", "train", "g1", False, "candidate"), ("b", "train", "g1", False, "negative"), ("c", "train", "g2", True, "candidate"), ("d", "valid", "g3", False, "candidate")], "id string, split string, content_group string, is_crop boolean, decision string")
    b = spark.createDataFrame([("a", "mold", (0.0, 0.0, 1.0, 1.0)), ("a", "mold", (2.0, 0.0, 3.0, 1.0)), ("d", "paint", (0.0, 0.0, 1.0, 1.0))], f"id string, class string, box {BOX}")
    got = {r["split"]: tuple(r)[1:] for r in reports.partition_summary(p, b, ["mold", "paint"]).collect()}
    assert got == {"train": (3, 2, 1, 1, 2, 0, 1, 0), "valid": (1, 1, 0, 0, 0, 1, 0, 1)}
    notes = spark.createDataFrame([("b", "dark"), ("b", "blurred"), ("b", "dark")], "id string, note string")
    cards = {r["id"]: r for r in reports.photo_cards(p, b, notes).collect()}
    assert cards["a"]["n_boxes"] == 2 and cards["b"]["notes"] == ["blurred", "dark"] and cards["c"]["boxes"] == []
    credit = spark.createDataFrame([("a", ("Wall", "N. N.", "CC0", "https://s.example", "https://l.example"))], "id string, credit struct<title:string,author:string,license:string,source_url:string,license_url:string>")
    assert reports.attribution(credit).first()["line"] == "a: Wall — N. N. — CC0 <https://l.example> <https://s.example>"


def test_runs_are_whole(spark):
    runs = [("a", "completed", "m", "m", "k", "k", [("p", "1")]), ("b", "failed", "m", "m", "k", "k", [("p", "1")]), ("c", "completed", "x", "m", "k", "k", [("p", "1")]), ("d", "completed", "m", "m", "j", "k", [("p", "1")]), ("e", "completed", "m", "m", "k", "k", [("p", "2")]), ("f", "completed", "m", "m", "k", "k", [("q", "1")]), ("g", "completed", "m", "m", "k", "k", [])]
    t = spark.createDataFrame(runs, "run string, status string, model string, expected_model string, classes string, expected_classes string, files array<struct<path:string,sha256:string>>")
    got = dict(map(tuple, reports.run_problems(t, spark.createDataFrame([("p", "1")], "path string, sha256 string")).collect()))
    assert got == {"b": "not_completed", "c": "other_model", "d": "other_classes", "e": "file_changed", "f": "file_missing", "g": "no_checkpoint"}


def test_from_photo_to_dossier(spark):
    found = [("p", 0, "crack", 0.8, (10.0, 20.0, 60.0, 90.0), []), ("p", 1, "crack", 0.9, (10.0, 20.0, 60.0, 90.0), []), ("p", 2, "moisture_trace", 0.9, (0.0, 0.0, 5.0, 5.0), []), ("q", 0, "crack", 0.2, (0.0, 0.0, 5.0, 5.0), [])]
    d = spark.createDataFrame(found, f"analysis string, idx int, class string, score double, box {BOX}, lost_regions array<struct<x:double,y:double,width:double,height:double>>")
    a = spark.createDataFrame([(x, "0f" * 32, 128, 128, verdict, "site", "run", "1e" * 32, 0.3) for x, verdict in (("p", "partial"), ("q", "partial"), ("r", "usable"), ("s", "unusable"))], "analysis string, photo_sha256 string, width int, height int, verdict string, site string, run string, checkpoint string, threshold double")
    made, outcomes = findings.built_findings(d, a, ["crack"])
    rows = made.collect()
    assert len(rows) == 1 and rows[0]["score"] == 0.9 and rows[0]["label"] == "Fissures" and len(rows[0]["finding"]) == 32 and rows[0]["box_normalized"][0] == 10 / 128
    assert dict((r[0], r[1]) for r in outcomes.collect()) == {"p": "defects_found", "q": "partial_analysis", "r": "no_target_defect_in_readable_area", "s": "not_assessable"}
    again = findings.built_findings(d.withColumn("score", F.lit(0.7)), a, ["crack"])[0].first()["finding"]
    other = findings.built_findings(d, a.withColumn("site", F.lit("elsewhere")), ["crack"])[0].first()["finding"]
    assert again == rows[0]["finding"] != other
    stored = outcomes.collect()
    assert reports.rebuilt_differences(spark.createDataFrame(stored, outcomes.schema), outcomes).isEmpty()
    changed = spark.createDataFrame(stored, outcomes.schema).withColumn("n_findings", F.col("n_findings") + 1)
    assert reports.rebuilt_differences(changed, outcomes).count() == 8
    for bad in (d.withColumn("score", F.lit(1.5)), d.withColumn("class", F.lit("rust")), d.withColumn("box", box(0, 0, 129, 5))):
        with pytest.raises(Refused):
            findings.built_findings(bad, a, ["crack"])


def test_origins(spark):
    good = ("s", None, None, "r", "ab" * 32, 0.3)
    cases = {None: good, "no_site": (" s", *good[1:]), "bad_context": ("s", "", None, *good[3:]), "bad_model": (*good[:4], "ab", 0.3), "bad_threshold": (*good[:5], 1.0)}
    t = spark.createDataFrame([c for c in cases.values()], "site string, zone string, task string, run string, sha string, threshold double")
    got = [r[0] for r in t.select(findings.origin_problem(*[F.col(c) for c in t.columns])).collect()]
    assert got == list(cases)


def test_label_files_are_written_as_they_are_read(spark):
    i = spark.createDataFrame([("a", 100, 50), ("b", 10, 10)], "id string, width int, height int")
    n = spark.createDataFrame([("a", 1, (10.0, 5.0, 30.0, 25.0)), ("a", 0, (0.0, 0.0, 100.0, 50.0))], f"image string, class_id int, box {BOX}")
    files = exports.label_documents(i, n)
    assert {r["id"]: r["text"] for r in files.collect()} == {"a": "0 0.500000 0.500000 1.000000 1.000000\n1 0.200000 0.300000 0.200000 0.400000", "b": ""}
    assert sorted(tuple(r)[2:] for r in labels.boxes(files, 2).collect()) == [(0, 0.5, 0.5, 1.0, 1.0), (1, 0.2, 0.3, 0.2, 0.4)]


def test_documents_keep_polygons_and_areas(spark):
    import json

    i = spark.createDataFrame([("a", "train", "a.jpg", 64, 64)], "id string, split string, file_name string, width int, height int")
    n = spark.createDataFrame([("a", 1, (1.0, 1.0, 20.0, 20.0), [[1.0, 1.0, 20.0, 1.0, 20.0, 20.0]], 180.0)], f"image string, category_id int, box {BOX}, segmentation array<array<double>>, area double")
    d = json.loads(exports.coco_documents(i, n, [(1, "crack")]).first()["document"])
    assert d["annotations"] == [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1.0, 1.0, 19.0, 19.0], "area": 180.0, "iscrowd": 0, "segmentation": [[1.0, 1.0, 20.0, 1.0, 20.0, 20.0]]}]


def test_masks_agree_with_their_palette():
    rgb = np.zeros((10, 10, 3), np.uint8)
    rgb[2:6, 2:6] = (255, 0, 0)
    crack = np.zeros((10, 10), bool)
    crack[2:6, 2:7] = True
    got = masks.palette_agreement(rgb, [crack, None])
    assert got == {"differing": 4, "iou": {0: 16 / 20, 1: None}}
    rgb[0, 0] = (1, 2, 3)
    with pytest.raises(ValueError, match="colours"):
        masks.palette_agreement(rgb, [crack, None])
    with pytest.raises(ValueError, match="draws nothing"):
        masks.palette_agreement(rgb * 0, [crack & False, None])
    whole = masks.union_of_windows(6, 6, [(np.ones((4, 4), bool), 0, 0), (np.ones((4, 4), bool), 4, 3)])
    assert whole.sum() == 16 + 6
