"""Manifests, lineage, crops and safe reads against rows that break one rule each."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.functions import masks
from girder.functions.rules import Refused
from girder.operators import precision, similarity, splits
from girder.sinks import exports
from girder.sources import documents, manifests


def test_probe_samples(spark):
    good = ("a", "a.jpg", "s1", 10, 10, "s1", 10, 10, [(0.0, 0.0, 5.0, 5.0)], "seen")
    rows = [good, ("b c", *good[1:]), ("d", "d.jpg", "s2", 10, 10, "s3", 10, 10, [], "x"), ("e", "e.jpg", "s4", 10, 9, "s4", 10, 10, [], "x"), ("f", "f.jpg", "s5", 10, 10, "s5", 10, 10, [(0.0, 0.0, 11.0, 5.0)], "x"), ("g", "g.jpg", "s6", 10, 10, "s6", 10, 10, [], " "), ("h", "h.jpg", "s7", 9, 9, "s7", 9, 9, [], "x"), ("h", "h.jpg", "s8", 9, 9, "s8", 9, 9, [], "x"), ("i", None, "s9", 9, 9, "s9", 9, 9, [], "x")]
    t = spark.createDataFrame(rows, "id string, file string, sha256 string, width int, height int, real_sha256 string, real_width int, real_height int, reference_boxes array<struct<x1:double,y1:double,x2:double,y2:double>>, review_note string")
    got = sorted((r["id"], r["problem"]) for r in manifests.probe_violations(t).collect())
    assert got == [("a", "repeated_content"), ("b c", "bad_id"), ("d", "content_differs"), ("e", "size_differs"), ("f", "bad_box"), ("g", "no_note"), ("h", "repeated_id"), ("h", "repeated_id"), ("i", "no_file")]
    p = spark.createDataFrame([("a" * 40, "find damp.", 0.25, 32), ("a" * 39, "find damp.", 0.25, 32), ("a" * 40, "find damp", 0.25, 32), ("a" * 40, "find damp.", 1.0, 32), ("a" * 40, "find damp.", 0.25, 65)], "r string, p string, t double, n int")
    said = [r[0] for r in p.select(manifests.protocol_problem(F.col("r"), F.col("p"), [F.col("t")], F.col("n"))).collect()]
    assert said == [None, "bad_revision", "bad_prompt", "bad_threshold", "bad_bound"]


def test_external_masks(spark):
    r = spark.createDataFrame([("1", "valid", 4, 4, 6, "g1"), ("2", "valid", 4, 4, 6, "g1"), ("3", "test", 4, 4, 6, "g2"), ("4", "test", 4, 4, 6, "g3"), ("5", "test", 4, 4, 6, "g3")], "id string, split string, width int, height int, foreground_pixels long, content_group string")
    m = spark.createDataFrame([("1", 4, 4, 6, 0), ("2", 4, 5, 6, 0), ("3", 4, 4, 6, 1), ("4", 4, 4, 5, 0)], "id string, width int, height int, foreground long, other long")
    assert sorted(map(tuple, manifests.external_violations(r, m).collect())) == [("2", "size_differs"), ("3", "not_binary"), ("4", "foreground_differs"), ("5", "no_mask")]
    assert sorted(map(tuple, manifests.external_counts(r).collect())) == [("test", 3, 2, 18), ("valid", 2, 1, 12)]


def test_public_links(spark):
    links = {"https://a.example/x?y=1": True, "HTTPS://a.example": True, "http://a.example": False, "https://u:p@a.example": False, "https:///x": False, "script:alert(1)": False, "": False, None: False, "https://a b": False}
    t = spark.createDataFrame([(u,) for u in links], "u string")
    assert {r[0]: r[1] for r in t.select("u", manifests.public_link(F.col("u"))).collect()} == links


def test_lineage(spark):
    schema = "run string, mode string, parent string, pinned string, checkpoint string, status string, classes string, corpus string, engine string"
    rows = [("a", "official", None, None, "ca", "completed", "k", "c", "e"), ("b", "fine_tune", "a", "ca", "cb", "completed", "k", "c", "e"), ("c", "fine_tune", "a", "cx", "cc", "completed", "k", "c", "e"), ("d", "extend", "zz", "ca", "cd", "completed", "k", "c", "e"), ("e", "fine_tune", "b", "cb", "ce", "failed", "k", "c2", "e"), ("f", "extend", "e", "ce", "cf", "completed", "k", "c2", "e"), ("g", "resume", None, None, None, "completed", "k", "c", "e"), ("h", "resume", None, None, None, "interrupted", "k", "c", "e"), ("i", "official", "a", None, None, "completed", "k", "c", "e"), ("j", "guess", None, None, None, "completed", "k", "c", "e"), ("l", "extend", "l", "cl", "cl", "completed", "k", "c", "e")]
    got = dict(map(tuple, splits.lineage_problems(spark.createDataFrame(rows, schema)).collect()))
    assert got == {"c": "checkpoint_differs", "d": "unknown_parent", "e": "settings_differ", "f": "parent_not_completed", "g": "not_interrupted", "i": "official_with_parent", "j": "unknown_mode", "l": "own_parent"}


def test_crops_become_rows(spark):
    photos = spark.createDataFrame([("p", 100, 80, "g", "valid", ["x"])], "id string, width int, height int, content_group string, split string, boxes array<string>")
    crops = spark.createDataFrame([("p_c", "p", 0.65, 0.5, 1.0, 1.0)], "id string, parent string, x1 double, y1 double, x2 double, y2 double")
    rows = {r["id"]: r for r in splits.with_crops(photos, crops).collect()}
    assert rows["p"]["crop"] is None and not rows["p"]["is_crop"] and rows["p_c"]["boxes"] is None
    assert (rows["p_c"]["crop"], rows["p_c"]["width"], rows["p_c"]["height"], rows["p_c"]["split"], rows["p_c"]["content_group"]) == ([65, 40, 100, 80], 35, 40, "train", "g")
    for bad in (crops.withColumn("x1", F.lit(0.9)), crops.withColumn("parent", F.lit("q"))):
        with pytest.raises(Refused):
            splits.with_crops(photos, bad)


def test_reads_stay_inside_their_folder(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"aa")
    (root / "sub" / "b.txt").write_bytes(b"b" * 50)
    (tmp_path / "secret.txt").write_bytes(b"s")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r["name"]: bytes(r["content"]) for r in documents.read_inside(spark, str(root), names("a.txt", "sub/b.txt"), 50).collect()}
    assert got == {"a.txt": b"aa", "sub/b.txt": b"b" * 50}
    for bad in ("../secret.txt", "/etc/passwd", "sub/./b.txt", "none.txt", None, ""):
        with pytest.raises(Refused):
            documents.read_inside(spark, str(root), names(bad), 50)
    with pytest.raises(Refused):
        documents.read_inside(spark, str(root), names("sub/b.txt"), 49)


def test_versions_are_announced_and_never_replaced(spark, tmp_path):
    folder = f"{tmp_path}/state"
    with pytest.raises(Refused):
        exports.current_version(spark, folder)
    for n in (1, 2, 3):
        exports.new_version(spark.range(n), folder)
    assert exports.current_version(spark, folder).count() == 3 and [n for n, _ in exports.versions(spark, folder)] == [1, 2, 3]
    # A version that was written but not announced is not seen.
    spark.range(9).write.parquet(f"{folder}/v{'0' * 32}")
    assert exports.current_version(spark, folder).count() == 3


def test_dossiers_read_back_before_they_are_published(spark, tmp_path):
    analyses = spark.createDataFrame([(1, "crack"), (2, "x")], "analysis long, outcome string")
    events = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "analysis long, revision long, note string")
    exports.publish_dossier(exports.dossier(analyses, events, 1), f"{tmp_path}/one")
    back = spark.read.json(f"{tmp_path}/one").first()
    assert '"revision":1,"note":"a"' in back["document"]
    many = spark.range(1001).select(F.lit(1).cast("long").alias("analysis"), F.col("id").alias("revision"), F.lit("n").alias("note"))
    with pytest.raises(Refused):
        exports.publish_dossier(exports.dossier(analyses, many, 1), f"{tmp_path}/two")


def test_saved_predictions_and_their_masks(spark):
    mask = np.zeros((40, 50), bool)
    mask[5:20, 7:30] = True
    text = masks.to_text(masks.encode(mask))
    assert masks.from_text(text, 40, 50) == masks.encode(mask)
    rows = [(1, 0, "crack", 0.9, (0.0, 0.0, 5.0, 5.0), ([40, 50], text)), (2, 0, "crack", 0.9, (0.0, 0.0, 5.0, 5.0), ([50, 40], text)), (3, 0, "crack", 0.9, (0.0, 0.0, 5.0, 5.0), ([40, 50], text[:-1])), (4, 0, "loss", 0.9, (0.0, 0.0, 5.0, 5.0), ([40, 50], text)), (201, 0, "crack", 0.9, (0.0, 0.0, 5.0, 5.0), ([40, 50], text)), (6, 0, "crack", 0.01, (0.0, 0.0, 5.0, 5.0), ([40, 50], text)), (7, 0, "crack", 0.9, (0.0, 0.0, 51.0, 5.0), ([40, 50], text)), (8, 0, "crack", 0.9, (0.0, 0.0, 5.0, 5.0), ([40, 50], text)), (8, 0, "crack", 0.9, (0.0, 0.0, 5.0, 5.0), ([40, 50], text))]
    t = spark.createDataFrame(rows, "id int, class_id int, class_name string, score double, box struct<x1:double,y1:double,x2:double,y2:double>, mask_rle struct<size:array<int>,counts:string>")
    got = {r["id"]: r["problem"] for r in documents.prediction_violations(t, 50, 40, ["crack", "loss"], 0.05).collect()}
    assert got.keys() == {2, 3, 4, 201, 6, 7, 8}
    assert (got[2], got[4], got[201], got[6], got[7], got[8]) == ("mask_size_differs", "class_and_name_differ", "id_outside", "score_outside", "bad_box", "repeated_id")


def test_every_mask_text_reads_back():
    rng = np.random.default_rng(3)
    for _ in range(300):
        h, w = rng.integers(1, 40, 2)
        runs = masks.encode(rng.random((h, w)) < rng.random())
        assert masks.from_text(masks.to_text(runs), h, w) == runs
    for bad in ("", "o", "0", "\x7f", "P" * 9, "oooooooo1"):
        with pytest.raises(ValueError, match="mask text"):
            masks.from_text(bad, 3, 3)


def test_average_precision_of_masks(spark):
    whole = np.zeros((20, 20), bool)
    whole[2:12, 2:12] = True
    half = np.zeros((20, 20), bool)
    half[2:12, 2:8] = True
    runs = lambda m: [int(x) for x in masks.encode(m)]
    refs = spark.createDataFrame([(1, "a", 0, runs(whole)), (2, "a", 0, runs(whole)), (3, "b", 0, runs(whole))], "image int, class string, pos long, mask array<int>")
    preds = spark.createDataFrame([(1, "a", 0, 90, runs(whole)), (2, "a", 0, 80, runs(half))], "image int, class string, pos long, score long, mask array<int>")
    got = {(r["class"], round(r["threshold"], 2)): (r["ap"], r["recall"]) for r in precision.average_precision(preds, refs, shape="mask", overlap=masks.mask_iou).collect()}
    assert len(got) == 20 and got["a", 0.5] == (pytest.approx(1.0), 1.0) and got["a", 0.6][1] == 1.0
    assert got["a", 0.65] == (pytest.approx(51 / 101), 0.5) and got["b", 0.5] == (0.0, 0.0)


def test_similar_classes_hold_the_pairs_of_their_members(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    rows = [(i, base[i % 40] ^ (sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 10)))) if i >= 40 else 0)) for i in range(160)] + [(1000 + i, base[0]) for i in range(5)]
    t = spark.createDataFrame(rows, "id long, hash long")
    for d in (0, 2, 3, 6, 8):
        expected = sorted((min(a, b), max(a, b), (x ^ y).bit_count()) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if (x ^ y).bit_count() <= d)
        assert sorted(map(tuple, similarity.close_pairs(t, d).collect())) == expected


def test_pairs_are_measured_in_full_size(spark):
    photo = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    mask = (photo > 100).astype(np.uint8)
    row = lambda i, a, m: (i, a.shape[1], a.shape[0], a.tobytes(), m.tobytes())
    t = spark.createDataFrame([row(1, photo, mask), row(2, np.fliplr(photo).copy(), np.fliplr(mask).copy()), row(3, photo, 1 - mask)], "id int, width int, height int, luma binary, mask binary")
    pairs = spark.createDataFrame([(1, 2, 1), (1, 2, 0), (1, 3, 0)], "left int, right int, view int")
    got = {(r["left"], r["right"], r["review_required"], r["iou"]) for r in similarity.measured_pairs(pairs, t).collect()}
    assert (1, 2, False, 1.0) in got and (1, 3, True, 0.0) in got and len(got) == 3


def test_identities_of_samples(spark):
    t = spark.createDataFrame([("hard_0042",)], "id string").select(*[c.alias(k) for k, c in manifests.sample_identity(F.col("id")).items()])
    assert tuple(t.first()) == ("images/hard_0042.jpg", "masks/hard_0042.png", "Hard", "Damage Segmentaion/Hard/Images/H (42).jpg")
