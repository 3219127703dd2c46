"""Preparations and evaluations end to end, on small tables."""

import numpy as np
import pytest

from girder.functions import images, rules
from girder.plans import evaluation, preparation


def test_import_needs_every_companion(spark):
    names = [f"{d}/{r}/E ({k}).x" for d in ("Easy", "Hard") for r in ("Images", "Mask") for k in (1, 2)]
    t = spark.createDataFrame([(n, False) for n in names], "name string, is_dir boolean")
    pattern = r"^(Easy|Hard)/(Images|Mask)/E \((\d+)\)\.x$"
    got = preparation.imported(t, pattern, ["Images", "Mask"]).orderBy("id").collect()
    assert [r["id"] for r in got] == ["easy_0001", "easy_0002", "hard_0003", "hard_0004"] and got[2]["Mask"] == "Hard/Mask/E (1).x"
    with pytest.raises(rules.Refused):
        preparation.imported(t.where("name <> 'Easy/Mask/E (1).x'"), pattern, ["Images", "Mask"])


def test_preparation_keeps_groups_whole(spark, tmp_path):
    data = [(f"p{i:02}", f"d{i if i != 2 else 1}", "Easy", [0, 1]) for i in range(30)]
    records = spark.createDataFrame(data, "id string, digest string, difficulty string, classes array<int>")
    links = spark.createDataFrame([("p03", "p04")], "a string, b string")
    excluded = spark.createDataFrame([("p04", "blurred")], "id string, reason string")
    tables = preparation.prepared(records, links, excluded)
    m = {r["id"]: (r["content_group"], r["split"]) for r in tables["manifest"].collect()}
    assert m["p01"] == m["p02"] and "p03" not in m and len(m) == 28
    assert {r["id"]: r["reason"] for r in tables["withheld"].collect()} == {"p03": "linked to a withheld item", "p04": "blurred"}
    assert sum(r["images"] for r in tables["summary"].collect()) == 28
    preparation.publish_corpus(tables, str(tmp_path / "corpus"))
    assert preparation.open_split(spark, str(tmp_path / "corpus"), "valid").count() == sum(s == "valid" for _, s in m.values())
    with pytest.raises(PermissionError):
        preparation.open_split(spark, str(tmp_path / "corpus"), "test")
    together = spark.createDataFrame([(["p01", "zz"],)], "members array<string>")
    bad = preparation.policy_violations(records.select("id"), spark.createDataFrame([("p01", ""), ("q", "x")], "id string, reason string"), together)
    assert sorted(r["problem"] for r in bad.collect()) == ["no_reason", "unknown_excluded", "unknown_linked"]


def test_evaluation_and_study(spark):
    kind = "struct<x1:double,y1:double,x2:double,y2:double>"
    refs = spark.createDataFrame([(1, "a", 0, (0.0, 0.0, 10.0, 10.0)), (2, "a", 0, (0.0, 0.0, 10.0, 10.0))], f"image long, class string, pos long, box {kind}")
    preds = spark.createDataFrame([(1, "a", 0, 900, (0.0, 0.0, 10.0, 10.0)), (2, "a", 0, 200, (0.0, 0.0, 10.0, 10.0)), (3, "a", 0, 100, (5.0, 5.0, 5.0, 9.0))], f"image long, class string, pos long, score long, box {kind}")
    e = evaluation.evaluate(preds, refs, 3, 300)
    t = e["totals"].first()
    assert (t["tp"], t["fp"], t["fn"]) == (1, 0, 1) and e["coverage"].first()["zone_recall"] == 0.5
    assert e["precision"].where("abs(ap - 1) > 1e-9").isEmpty()
    s = evaluation.study(preds, refs, [50, 150, 500], 300)
    assert [r["threshold"] for r in s["best"].collect()] == [150] and s["missed"].count() == 1
    for bad in ([], [2, 1], [5, 5000]):
        with pytest.raises(rules.Refused):
            evaluation.checked_grid(bad)
    with pytest.raises(rules.Refused):
        evaluation.comparable({"protocol": 1}, {"protocol": 2})


def test_pair_measures_turn_the_right_side():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 256, (20, 30, 3), np.uint8)
    mask = left[..., 0] > 99
    right, right_mask = np.fliplr(left), np.fliplr(mask)
    assert images.pair_measures(left, right, 1, mask, right_mask) == {"error": 0.0, "iou": 1.0, "review_required": False}
    assert images.pair_measures(left, right, 0, mask, right_mask)["review_required"]
    assert images.pair_measures(left, np.rot90(right), 0, mask, np.rot90(right_mask))["error"] is None


def test_columns_are_pruned_and_filters_pushed(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 10").select("l_orderkey")
    plan = t._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
