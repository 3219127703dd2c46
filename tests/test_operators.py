"""The traps of the semantics, one test each, on literal inputs."""

import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.functions import images, masks, rules
from girder.functions.geometry import box, clip_status, lost_share, shifted, sound
from girder.functions.ratios import f1, precision
from girder.operators import confusion, coverage, findings, groups, integrity, matching, precision as ap, selection, similarity, splits, windows
from girder.operators.components import connected_components
from girder.sinks import exports
from girder.sources import archives, documents, labels
from girder.streaming import journal

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_of_paths_and_repeats(spark):
    rng = random.Random(1)
    ids = list(range(200))
    rng.shuffle(ids)
    links = [*itertools.pairwise(ids[:150]), (ids[0], ids[1]), (ids[1], ids[0]), (7, 7), *itertools.pairwise(ids[150:160])]
    got = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long"))))
    expected = {i: min(ids[:150]) for i in ids[:150]} | {i: min(ids[150:160]) for i in ids[150:160]}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    text = spark.createDataFrame([("c", "b"), ("a", "b")], "a string, b string")
    everyone = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert dict(rows(groups.content_groups(everyone, text))) == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert [(r["content_group"], r["members"]) for r in groups.groups_of_several(groups.content_groups(everyone, text)).collect()] == [("a", ["a", "b", "c"])]
    with pytest.raises(rules.Refused):
        groups.content_groups(everyone, spark.createDataFrame([("a", "z")], "a string, b string"), strict=True)


def test_close_pairs_equal_the_full_comparison(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(40)]
    table = [(i, b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 12)))) for i, b in enumerate(base * 5)]
    expected = sorted((a, b, (x ^ y).bit_count()) for (a, x), (b, y) in itertools.combinations(table, 2) if (x ^ y).bit_count() <= 8)
    df = spark.createDataFrame([*table, (None, 5), (999, None)], "id long, hash long")
    assert rows(similarity.close_pairs(df, 8)) == expected
    one = dict(rows(connected_components(similarity.similarity_links(df, 8))))
    two = dict(rows(connected_components(spark.createDataFrame([e[:2] for e in expected], "a long, b long"))))
    assert one == two


def boxes(spark, data, scored=False):
    kind = f"image long, class string, pos long, {'score long, ' if scored else ''}box {BOX}"
    return spark.createDataFrame([(*r[:-1], tuple(map(float, r[-1]))) for r in data], kind)


def test_greedy_matching_takes_the_first_best_free_reference(spark):
    refs = boxes(spark, [(1, "c", 0, (0, 0, 10, 10)), (1, "c", 1, (0, 0, 10, 10)), (1, "c", 2, (50, 0, 60, 10))])
    preds = boxes(spark, [(1, "c", 0, 900, (0, 0, 10, 10)), (1, "c", 1, 900, (0, 0, 10, 10)), (1, "c", 2, 800, (0, 0, 10, 10)), (1, "c", 3, 700, (58, 0, 68, 10)), (2, "c", 0, 100, (0, 0, 1, 1))], True)
    m = matching.match_boxes(preds, refs)
    assert [(r["image"], r["pred_pos"], r["ref_pos"], r["reason"]) for r in m.orderBy("image", "pred_pos").collect()] == [
        (1, 0, 0, "matched"), (1, 1, 1, "matched"), (1, 2, None, "duplicate"), (1, 3, None, "insufficient_overlap"), (2, 0, None, "no_overlap")]
    t = confusion.totals(confusion.image_counts(m, refs), 4, "class").first()
    assert (t["tp"], t["fp"], t["fn"], t["recall"], t["false_proposals_per_image"]) == (2, 3, 1, 2 / 3, 0.75)
    swept = {r["threshold"]: r for r in confusion.sweep(m, refs, [50, 850]).collect()}
    assert (swept[850]["tp"], swept[850]["fp"], swept[850]["precision"]) == (2, 0, 1.0)
    assert [r["threshold"] for r in confusion.best_thresholds(confusion.sweep(m, refs, [50, 750, 850])).collect()] == [850]


def test_null_images_and_classes_are_met_by_no_reference(spark):
    data = [(None, "c", 0, 900, (0, 0, 10, 10)), (1, None, 0, 900, (0, 0, 10, 10)), (1, "c", 0, 900, (0, 0, 10, 10))]
    preds, refs = boxes(spark, data, True), boxes(spark, data, True).drop("score")
    both = preds.withColumn("predicted", F.lit(True)).unionByName(preds.withColumns({"predicted": F.lit(False), "score": F.lit(None).cast("long")}))
    for m in (matching.match_boxes(preds, refs), matching.match_sides(both)):
        assert sorted((r["image"] is None, r["class"] is None, r["score"], r["ref_pos"], r["reason"]) for r in m.collect()) == [(False, False, 900, 0, "matched"), (False, True, 900, None, "no_overlap"), (True, False, 900, None, "no_overlap")]


def test_undefined_ratios_are_null(spark):
    r = spark.range(1).select(precision(F.lit(0), F.lit(0)).alias("p"), f1(F.lit(0), F.lit(0), F.lit(3)).alias("f"), f1(F.lit(0), F.lit(1), F.lit(3)).alias("z")).first()
    assert r["p"] is None and r["f"] is None and r["z"] == 0
    none = confusion.totals(confusion.image_counts(matching.match_boxes(boxes(spark, [], True), boxes(spark, [(1, "c", 0, (0, 0, 1, 1))])), boxes(spark, [(1, "c", 0, (0, 0, 1, 1))])), 1, "class").first()
    assert none["recall"] == 0 and none["precision"] is None


def test_merging_uses_the_smaller_box_and_grows(spark):
    data = [(1, "crack", 0, 900, (0, 0, 100, 20)), (1, "crack", 1, 500, (80, 0, 120, 20)), (1, "other", 2, 400, (0, 0, 100, 20)), (1, "crack", 3, 300, (110, 0, 140, 20))]
    got = [(r["class"], r["score"], tuple(r["box"]), r["merged_from"]) for r in matching.merge_proposals(boxes(spark, data, True)).collect()]
    assert sorted(got) == [("crack", 900, (0, 0, 140, 20), 3), ("other", 400, (0, 0, 100, 20), 1)]
    flat = matching.merge_proposals(boxes(spark, [(1, "c", 0, 9, (0, 0, 5, 5)), (1, "c", 1, 8, (1, 1, 1, 4))], True))
    assert flat.count() == 2


def test_average_precision_of_perfect_and_empty(spark):
    refs = boxes(spark, [(1, "a", 0, (0, 0, 10, 10)), (1, "b", 1, (0, 0, 10, 10)), (2, "a", 0, (5, 5, 9, 9))])
    perfect = boxes(spark, [(1, "a", 0, 900, (0, 0, 10, 10)), (2, "a", 0, 800, (5, 5, 9, 9))], True)
    got = {r["class"]: r["ap"] for r in ap.average_precision(perfect, refs, [0.5]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0
    half = boxes(spark, [(1, "a", 0, 900, (50, 50, 60, 60)), (2, "a", 0, 800, (5, 5, 9, 9))], True)
    assert {r["class"]: r["ap"] for r in ap.average_precision(half, refs, [0.5]).collect()}["a"] == pytest.approx(51 * 0.5 / 101)


def test_coverage_keeps_photos_and_zones_apart(spark):
    refs = boxes(spark, [(1, "c", 0, (10, 8, 20, 20)), (1, "c", 1, (30, 8, 40, 20)), (2, "c", 0, (0, 0, 2, 2))])
    pros = boxes(spark, [(1, "c", 0, 500, (10, 8, 40, 20)), (3, "c", 0, 500, (0, 0, 2, 2))], True)
    t = coverage.coverage_totals(coverage.zone_coverage(refs, pros), 5).first()
    assert (t["photos"], t["expected"], t["found"], t["signalled"], t["without_reference"]) == (5, 2, 1, 2, 1)
    assert t["photo_recall"] == t["photo_precision"] == 0.5 and t["zone_recall"] == 240 / 244 and t["zone_precision"] == 240 / 364


def test_grouped_split_rounds_half_to_even_and_keeps_small_strata(spark):
    data = [(str(i), str(i), "Easy", [0, 1]) for i in range(25)] + [("x1", "x1", "Hard", [0]), ("x2", "x2", "Hard", [0])] + [("y1", "0", "Easy", [0, 1])]
    t = spark.createDataFrame(data, "id string, content_group string, difficulty string, classes array<int>")
    got = {r["id"]: r["split"] for r in splits.grouped_split(t, seed=1).collect()}
    n = {s: sum(v == s for k, v in got.items() if k != "y1") for s in splits.SPLITS}
    assert n == {"valid": 2, "test": 2, "train": 23} and got["y1"] == got["0"] and got["x1"] == got["x2"] == "train"
    assert got == {r["id"]: r["split"] for r in splits.grouped_split(t.repartition(3), seed=1).collect()}
    assert got != {r["id"]: r["split"] for r in splits.grouped_split(t, seed=2).collect()}
    with pytest.raises(rules.Refused):
        splits.refuse_thin_splits(t.where("id < '2'"), splits.grouped_split(t.where("id = '0'"), seed=1))


def test_budget_skips_what_does_not_fit(spark):
    data = [(f"{g}{k}", g, "Easy" if g < "c" else "Hard", [0]) for g, n in (("a", 3), ("b", 1), ("c", 3), ("d", 2), ("e", 9)) for k in range(n)]
    t = spark.createDataFrame(data, "id string, content_group string, difficulty string, classes array<int>")
    got = rows(splits.budget_selection(t, 4, 1))
    assert sum(n for _, n in got) <= 4 and got

    def plain(maximum):
        line, total, kept = splits.strata(t).collect(), 0, []
        order = {r["content_group"]: splits_key(r["content_group"]) for r in line}
        buckets = {}
        for r in sorted(line, key=lambda r: order[r["content_group"]]):
            buckets.setdefault(r["stratum"], []).append(r)
        while any(buckets.values()):
            for k in sorted(buckets):
                if buckets[k]:
                    r = buckets[k].pop(0)
                    if total + r["n"] <= maximum:
                        total += r["n"]
                        kept.append((r["content_group"], r["n"]))
        return sorted(kept)

    import hashlib

    splits_key = lambda g: hashlib.sha256(f"1:{g}".encode()).hexdigest()
    for maximum in (1, 4, 6, 18):
        assert rows(splits.budget_selection(t, maximum, 1)) == plain(maximum)


def test_label_readers_differ(spark):
    f = spark.createDataFrame([("a", "0 0.5 0.5 0.2 0.2\n\n2 0.1 0.1 0.05 0.05\n"), ("b", "0 0.5 0.5 0 0.1\n3 0.5 0.5 0.1 0.1\n1 1.5 0.5 0.1 0.1\n1 0.95 0.5 0.2 0.1\n0 0 0\nx 0.1 0.1 0.1 0.1\n0 0.05 0.5 0.1000019 0.1")], "id string, text string")
    assert [(r["line"], r["class_id"]) for r in labels.boxes(f.where("id = 'a'"), 3).collect()] == [(1, 0), (3, 2)]
    assert [r["reason"] for r in labels.rejects(f, 3).orderBy("line").collect()] == ["empty_box", "unknown_class", "outside", "ends_outside", "unexpected_line", "invalid_number"]
    g = spark.createDataFrame([("a", "0 0.5 0.5 0.5 0.5\n1 0.2 0.2 0.1 0.1\n0 0.95 0.5 0.1000001 0.2\n2 0.95 0.5 0.2 0.2\n9 0.5 0.5 0.1 0.1")], "id string, text string")
    got = labels.mapped_boxes(g, ["m", "n", "o"], {"0": "mold"}).orderBy("line").collect()
    assert [r["verdict"] for r in got] == ["box", "skipped", "box", "outside", "unknown_class"] and got[2]["x2"] == 1.0


def test_instances_agree_to_a_pixel(spark):
    docs = spark.createDataFrame([("a", 100, 100, [(0, [[10.0, 10.0, 30.0, 10.0]]), (1, [[1.0, 2.0, 3.0, 4.0]])])], "id string, width int, height int, annotations array<struct<category_id:int,segmentation:array<array<double>>>>")
    text = spark.createDataFrame([("a", "0 0.1 0.105 0.3 0.1\n1 0.01 0.02 0.03 0.08\n1 0 0 0 0\n")], "id string, text string")
    assert [r["verdict"] for r in labels.instance_pairs(docs, text).orderBy("n").collect()] == ["agrees", "points_differ", "count_differs"]


def test_windows_end_at_the_edge(spark):
    t = spark.createDataFrame([(1, 1000, 400), (2, 1001, 400), (3, 100, 80)], "image int, width int, height int")
    got = windows.window_grid(t, 400, 100)
    assert [sorted({r["x"] for r in got.where(f"image = {i}").collect()}) for i in (1, 2)] == [[0, 300, 600], [0, 300, 600, 601]]
    assert rows(got.where("image = 3")) == [(3, 0, 0, 100, 80)]


def test_findings_are_strict_and_say_why(spark):
    lost = [(0.0, 0.0, 50.0, 50.0)]
    d = [(1, 0, "crack", 0.5, (10, 20, 60, 90), []), (1, 1, "moisture", 0.9, (10, 20, 60, 90), []), (1, 2, "crack", 0.3, (1, 1, 9, 9), []), (1, 3, "crack", 0.8, (10, 20, 60, 90), []), (1, 4, "crack", 0.8, (10, 20, 60, 90), []), (1, 5, "crack", 0.7, (1, 1, 9, 9), lost)]
    d = [(*r[:4], tuple(map(float, r[4])), r[5]) for r in d]
    t = spark.createDataFrame(d, f"analysis int, idx int, class string, score double, box {BOX}, lost_regions array<struct<x:double,y:double,width:double,height:double>>")
    found, withheld = findings.findings_and_withheld(t, ["crack"], 0.3)
    assert [(r["slot"], r["idx"], r["score"]) for r in found.collect()] == [(0, 3, 0.8)]
    assert rows(withheld.select("idx", "reason")) == [(0, "duplicate_geometry"), (1, "class_not_enabled"), (2, "below_or_equal_threshold"), (4, "duplicate_geometry"), (5, "unreadable_region")]
    r = findings.finding_record(found).first()
    assert r["severity"] is None and r["conformity"] == "not_assessed" and r["confidence"]["is_not_a_severity"]


EVENTS = "analysis long, revision long, request_id string, finding long, kind string, decision string, class string, status string, recorded_at timestamp, occurred_at timestamp"


def events(spark, data):
    import datetime as dt

    at = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(1, i + 1, f"r{i}", 0, *e, at + dt.timedelta(minutes=i), None) for i, e in enumerate(data)], EVENTS)


@pytest.mark.parametrize(("history", "expected"), [
    ([], ("proposed", None, "not_assessed", 0)),
    ([("correction", None, None, "resolved")], ("proposed", None, "not_assessed", 1)),
    ([("review", "confirmed", None, None), ("correction", None, None, "planned")], ("confirmed", "crack", "planned", 0)),
    ([("review", "confirmed", None, None), ("correction", None, None, "planned"), ("review", "confirmed", None, None)], ("confirmed", "crack", "planned", 0)),
    ([("review", "confirmed", "other", None), ("correction", None, None, "planned"), ("review", "confirmed", None, None)], ("confirmed", "crack", "not_assessed", 0)),
    ([("review", "confirmed", None, None), ("correction", None, None, "planned"), ("review", "rejected", None, None), ("correction", None, None, "resolved")], ("rejected", "crack", "not_assessed", 1)),
])
def test_replay_resets_corrections(spark, history, expected):
    known = spark.createDataFrame([(1, 0, "crack")], "analysis long, finding long, class string")
    r = journal.replay(known, events(spark, history)).first()
    assert (r["state"], r["effective_class"], r["correction"], r["refused"]) == expected
    state = ("proposed", None, "not_assessed", 0, 0, 0)
    for kind, decision, chosen, status in history:
        state = journal.apply_event(state, kind, decision, (chosen or "crack") if kind == "review" else None, status)
    assert (state[0], state[1], state[2], state[5]) == expected


def test_journal_violations_and_append(spark):
    e = events(spark, [("review", "confirmed", None, None), ("oops", None, None, None), ("review", "rejected", "x", None)])
    e = e.withColumn("revision", F.when(F.col("revision") == 3, 4).otherwise(F.col("revision")).cast("long"))
    assert rows(journal.violations(e).select("problem")) == [("broken_sequence",), ("unknown_kind",)]
    j = spark.createDataFrame([(1, 1, "a", "d1")], "analysis long, revision long, request_id string, digest string")
    q = spark.createDataFrame([(1, "a", "d1", 0), (1, "a", "d2", 1), (1, "b", "d3", 0), (1, "c", "d4", 1), (2, "x", "d", 0)], "analysis long, request_id string, digest string, expected_revision long")
    assert [r["outcome"] for r in journal.appended(j, q).orderBy("analysis", "digest").collect()] == ["no_op", "conflict", "stale", "append", "append"]


def test_stream_replays_like_the_batch(spark, tmp_path):
    known = spark.createDataFrame([(1, 0, "crack")], "analysis long, finding long, class string")
    e = events(spark, [("review", "confirmed", None, None), ("correction", None, None, "planned"), ("note", None, None, None), ("review", "confirmed", None, None)])
    ready = e.join(known.withColumnRenamed("class", "own_class"), ["analysis", "finding"])
    ready.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ready.schema).parquet(str(tmp_path / "in"))
    q = journal.replay_stream(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("states")) == rows(journal.replay(known, e))


def test_geometry(spark):
    b = box(10, 20, 30, 40)
    regions = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(20).alias("width"), F.lit(100).alias("height")))
    r = spark.range(1).select(shifted(b, F.lit(100), F.lit(200)).alias("s"), clip_status(box(90, 90, 120, 120), F.lit(100), F.lit(100)).alias("c"), clip_status(box(100, 0, 120, 9), F.lit(100), F.lit(100)).alias("e"), lost_share(b, regions).alias("l"), sound(box(float("nan"), 0, 1, 1)).alias("n"), sound(box(0, 0, 1, 1), F.lit(1), F.lit(1)).alias("ok")).first()
    assert tuple(r["s"]) == (110, 220, 130, 240) and r["c"] == "clipped" and r["e"] == "empty_after_clipping" and r["l"] == 0.5 and r["n"] is False and r["ok"] is True


def test_scalar_rules(spark):
    t = spark.createDataFrame([("2026-01-02T03:04:05+02:00", "ok"), ("2026-01-02T03:04:05", " x"), ("2026-01-02T03:04:05.5Z", "a\x00")], "at string, text string")
    got = [(r[0], r[1]) for r in t.select(rules.utc_text(F.col("at")), rules.is_text(F.col("text"))).collect()]
    assert got == [("2026-01-02T01:04:05.000000Z", True), (None, False), ("2026-01-02T03:04:05.500000Z", False)]
    with pytest.raises(rules.Refused):
        rules.refuse_over(t, 2, "rows")
    assert rules.set_difference(t, t).count() == 0 and rules.set_difference(t, t.limit(2)).count() == 1
    q = spark.createDataFrame([(0.39, 99.0), (0.94, 99.0), (0.95, 11.9), (0.95, 12.0)], "r double, s double")
    assert [r[0] for r in q.select(rules.photo_verdict(F.col("r"), F.col("s"))).collect()] == ["unusable", "partial", "partial", "usable"]


def test_masks_round_trip_and_algebra():
    rng = np.random.default_rng(3)
    for _ in range(60):
        h, w = rng.integers(1, 12, 2)
        a, b = rng.random((2, h, w)) < rng.random()
        ra, rb = masks.encode(a), masks.encode(b)
        assert (masks.decode(ra, h, w) == a).all() and masks.area(ra) == a.sum()
        assert masks.from_text(masks.to_text(ra), h, w) == ra
        assert masks.combined(ra, rb, True) == masks.encode(a & b) and masks.combined(ra, rb, False) == masks.encode(a | b)
        where = np.argwhere(a)
        expected = None if not len(where) else (where[:, 1].min(), where[:, 0].min(), np.ptp(where[:, 1]) + 1, np.ptp(where[:, 0]) + 1)
        assert masks.bounds(ra, h) == expected
        union = (a | b).sum()
        assert masks.overlap(ra, rb) == ((a & b).sum() / union if union else 0)
    for bad in ("", "~~", "0", "P" * 9):
        with pytest.raises(ValueError):
            masks.from_text(bad, 40, 40)
    r = masks.rasterised([[10, 10, 30, 10, 30, 20, 10, 20]], 64, 64)
    assert r.sum() == 200 and masks.bounds(masks.encode(r), 64) == (10, 10, 20, 10)
    assert masks.compared(r, np.roll(r, 1, axis=1))["beyond_border"] == 0


def test_mask_columns(spark):
    a, b = masks.encode(np.eye(4) > 0), masks.encode(np.ones((4, 4)) > 0)
    t = spark.createDataFrame([(a, b, masks.to_text(a)), (a, None, "??")], "a array<int>, b array<int>, t string")
    got = t.select(masks.mask_iou("a", "b"), masks.mask_runs("t", F.lit(4), F.lit(4))).collect()
    assert got[0][0] == 0.25 and list(got[0][1]) == a and got[1][0] is None and got[1][1] is None


def test_image_kernels():
    rng = np.random.default_rng(4)
    rgb = rng.integers(0, 256, (64, 48, 3), np.uint8)
    prints = images.fingerprint(rgb)
    assert len(prints) == 8 and len({p[1] for p in prints}) == 8
    flipped = images.fingerprint(np.fliplr(rgb))
    assert prints[1] == flipped[0] and all(len(p[1]) == 3072 for p in prints)
    lost, m = images.exposure(np.zeros((32, 32), np.uint8))
    assert len(lost) == 256 and m["readable_fraction"] == 0 and lost[0]["reason"] == "too_dark"
    lost, m = images.exposure(np.full((7, 5), 130, np.uint8))
    assert not lost and m["readable_fraction"] == 1
    assert images.sharpness(np.full((40, 40), 9, np.uint8)) == 0 and images.sharpness(images.gray(rgb)) > 100
    small, factor = images.averaged(np.zeros((3000, 3000), np.uint8))
    assert factor == 2 and small.shape == (1500, 1500)
    for k in range(1, 9):
        assert images.oriented(rgb, k).size == rgb.size


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("W/CW/7001-1.jpg", b"x"), ("W/UW/7002-2.jpg", b"y"), ("w/cw/7001-1.JPG", b"z"), ("../up", b""), ("big", b"\0" * 3_000_000)):
            z.writestr(name, data)
    m = archives.zip_members(spark, str(tmp_path / "*.zip"), content=True)
    assert rows(archives.member_violations(m, 10, 1 << 30).select("name", "problem")) == [("../up", "unsafe_name"), ("W/CW/7001-1.jpg", "names_collide"), ("big", "packed_too_tightly"), ("w/cw/7001-1.JPG", "names_collide")]
    assert archives.member_violations(m, 2, 1 << 30).where("problem = 'too_many_members'").count() == 5
    assert [(r["label"], r["photo"]) for r in archives.patch_index(m).orderBy("photo").collect()] == [("cracked", "7001"), ("clear", "7002")]
    pins = spark.createDataFrame([("W/CW/7001-1.jpg", "0" * 64), ("none", "0" * 64)], "name string, sha256 string")
    assert not any(r["ok"] for r in archives.pinned_members(m, pins).collect())


def test_strict_json_and_coco(spark, tmp_path):
    good = {"images": [{"id": 1, "file_name": "a", "width": 64, "height": 64}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 19, 19], "area": 361, "iscrowd": 0, "segmentation": []}, {"id": 1, "image_id": 9, "category_id": 7, "bbox": [60, 1, 19, 19], "area": 1, "iscrowd": 1, "segmentation": []}], "categories": [{"id": 1, "name": "crack"}], "schema_version": 1}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "twice.json").write_text('{"images": [], "images": []}')
    i, a, c = documents.coco_tables(spark, str(tmp_path / "good.json"))
    assert {r["problem"] for r in documents.coco_violations(i, a, c).collect()} == {"repeated_annotation", "unknown_image", "unknown_category", "crowd"}
    with pytest.raises(Exception, match=r"(?i)duplicate|variant"):
        documents.json_documents(spark, str(tmp_path / "twice.json"), documents.COCO).collect()
    with pytest.raises(rules.Refused):
        documents.json_documents(spark, str(tmp_path / "good.json"), documents.COCO, version=2)
    with pytest.raises(rules.Refused, match="unknown category"):
        documents.projected_categories(a, {1: 1})
    kept = documents.projected_categories(a, {1: 1, 7: None}).collect()
    assert [(r["id"], r["category_id"]) for r in kept] == [(1, 1)]


def test_metrics_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("epoch,loss,map\n0,1.5,\n0,,0.25\n1,0.5,\n")
    assert documents.metric_summary(spark, str(tmp_path / "m.csv"), "map") == {"epoch": 0, "values": {"epoch": 1, "loss": 0.5, "map": 0.25}}
    for bad in ("loss,map\nNaN,1\n", "epoch\n1\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(rules.Refused):
            documents.metric_summary(spark, str(tmp_path / "b.csv"), "map")
    with pytest.raises(rules.Refused):
        documents.CorpusConfig.of({"sed": 1})


def test_publishing_is_whole_or_nothing(spark, tmp_path):
    t = spark.range(5)
    exports.publish(t, f"{tmp_path}/out")
    with pytest.raises(rules.Refused):
        exports.publish(t, f"{tmp_path}/out")
    with pytest.raises(Exception, match="(?i)boom"):
        exports.publish(t.select(F.raise_error(F.lit("boom")).cast("int").alias("x")), f"{tmp_path}/bad")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]
    exports.new_version(t, f"{tmp_path}/state")
    exports.new_version(t.where("id > 1"), f"{tmp_path}/state")
    assert exports.current_version(spark, f"{tmp_path}/state").count() == 3


def test_coco_document(spark):
    i = spark.createDataFrame([("b", "train", "b.jpg", 9, 9), ("a", "train", "a.jpg", 9, 9), ("c", "test", "c.jpg", 9, 9)], "id string, split string, file_name string, width int, height int")
    a = spark.createDataFrame([("b", 1, (1.0, 1.0, 3.0, 4.0))], f"image string, category_id int, box {BOX}")
    got = {r["split"]: json.loads(r["document"]) for r in exports.coco_documents(i, a, [(1, "crack")]).collect()}
    assert [x["file_name"] for x in got["train"]["images"]] == ["a.jpg", "b.jpg"] and got["train"]["annotations"][0]["image_id"] == 2
    assert got["train"]["annotations"][0]["bbox"] == [1, 1, 2, 3] and got["test"]["annotations"] == []


def test_quarantine_and_integrity(spark):
    g = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, content_group string")
    got = rows(groups.with_quarantine(g, spark.createDataFrame([("b", "blurred")], "id string, reason string")).select("id", "quarantined", "reason").where("quarantined"))
    assert got == [("a", True, "linked to a withheld item"), ("b", True, "blurred")]
    f = spark.createDataFrame([("x", 1, "s"), ("y", 2, "t"), ("z", 3, "u")], "path string, size long, sha256 string")
    p = spark.createDataFrame([("x", 1, "s"), ("y", 9, "t"), ("w", 3, "u")], "path string, size long, sha256 string")
    assert rows(integrity.integrity_mismatches(f, p)) == [("w", "missing"), ("y", "wrong_size"), ("z", "unpinned")]


def test_dense_ids_over_all(spark):
    t = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id")).repartition(7)
    got = sorted((r["id"], r["number"]) for r in selection.dense_ids(t, ["id"]).collect())
    assert got == [(i, i + 1) for i in range(1000)]


def test_metrics_of_many_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "m.csv").write_text("epoch,loss,map\n" + "".join(f"{i},{i / 7:.6f},{'' if i > 4990 else i / 9}\n" for i in range(5000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert spark.read.csv(str(tmp_path / "m.csv"), header=True).rdd.getNumPartitions() > 10
        got = documents.metric_summary(spark, str(tmp_path / "m.csv"), "map")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {"epoch": 4990.0, "values": {"epoch": 4999.0, "loss": round(4999 / 7, 6), "map": 4990 / 9}}
