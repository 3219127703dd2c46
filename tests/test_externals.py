"""An external source from its files to records, pairs and roles."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_photos import exif, png

from girder.functions import images, masks
from girder.functions.rules import Refused
from girder.plans import externals, photos

Y, X = np.mgrid[0:48, 0:64]


def scene(seed):
    rng = np.random.default_rng(seed)
    big = rng.integers(0, 256, (6, 8, 3))
    return np.kron(big, np.ones((8, 8, 1))).astype(np.uint8)


def label(top, left, gray=255):
    m = np.zeros((48, 64), np.uint8)
    m[top : top + 10, left : left + 12] = gray
    m[top, left : left + 12] = 130
    m[top + 1, left : left + 12] = 100
    return m


def write(folder, name, photo, mask, turn=1, mask_turn=1):
    """Files of a sample; photos lie turned so that the tag turns them back. Returns its row of the inventory."""
    undo = {1: 1, 6: 8, 3: 3}
    row = [name]
    for kind, a, k in (("image", photo, turn), ("mask", mask, mask_turn)):
        raw = png(np.ascontiguousarray(images.oriented(a, undo[k])), exif(k) if k != 1 else None)
        (folder / f"{name}_{kind}.png").write_bytes(raw)
        row.append((f"{name}_{kind}.png", hashlib.sha256(raw).hexdigest()))
    return (name, row[1][0], row[2][0], row[1][1], row[2][1], turn, mask_turn)


SCHEMA = "id string, image string, mask string, image_sha256 string, mask_sha256 string, exif_orientation int, mask_exif_orientation int"


@pytest.fixture
def source(spark, tmp_path):
    rows = [
        write(tmp_path, "a", scene(1), label(5, 5), 6, 3),
        write(tmp_path, "b", scene(1), label(5, 5)),  # the same view
        write(tmp_path, "c", scene(2), label(20, 20)),
        write(tmp_path, "d", images.oriented(scene(2), 3), images.oriented(label(25, 20), 3)),  # turned, and another mask
        write(tmp_path, "e", scene(3), label(1, 40)),
    ]
    files = photos.read_photos(spark, str(tmp_path)).withColumn("id", F.element_at(F.split("id", "/"), -1))
    return tmp_path, rows, lambda r=rows: spark.createDataFrame(r, SCHEMA), files


def test_records_pairs_and_roles(source):
    _, _, inventory, files = source
    out = externals.prepared_external(inventory(), files)
    rows = {r["id"]: r for r in out["records"].collect()}
    assert {i: (r["content_group"], r["split"]) for i, r in rows.items()} == {"a": ("a", "candidate"), "b": ("a", "variant"), "c": ("c", "quarantine"), "d": ("c", "quarantine"), "e": ("e", "candidate")}
    a = rows["a"]
    assert (a["width"], a["height"], a["orientation"], a["mask_orientation"], a["scene_group"]) == (64, 48, 6, 3, None)
    assert (a["foreground_pixels"], a["foreground_at_low"], a["foreground_at_high"], a["band_pixels"]) == (108, 120, 96, 24) and a["band_share"] == 24 / 108
    assert list(a["runs"]) == list(rows["b"]["runs"]) == masks.encode(label(5, 5) >= 128)
    pairs = {(r["left"], r["right"]): r for r in out["pairs"].collect()}
    assert set(pairs) == {("a", "b"), ("c", "d")}
    assert pairs["a", "b"]["native_error"] == 0 and pairs["a", "b"]["iou"] == 1 and not pairs["a", "b"]["review_required"]
    assert pairs["c", "d"]["native_error"] == 0 and pairs["c", "d"]["iou"] < 0.98 and pairs["c", "d"]["review_required"]
    assert {r["split"]: (r["photos"], r["groups"]) for r in out["counts"].collect()} == {"candidate": (2, 2), "variant": (1, 1), "quarantine": (2, 1)}


@pytest.mark.parametrize(("change", "rule"), [("digest", "pins"), ("gone", "pins"), ("orientation", "inspected"), ("empty", "empty_or_full"), ("size", "sizes_differ"), ("small", "too_small")])
def test_what_cannot_be_prepared_is_refused(spark, source, change, rule):
    folder, rows, inventory, _ = source
    if change == "digest":
        rows[4] = (*rows[4][:3], "0" * 64, *rows[4][4:])
    if change == "gone":
        rows[4] = (rows[4][0], "absent.png", *rows[4][2:])
    if change == "orientation":
        rows[0] = (*rows[0][:5], 1, 3)
    if change == "empty":
        rows[4] = write(folder, "e", scene(3), np.zeros((48, 64), np.uint8))
    if change == "size":
        rows[4] = write(folder, "e", scene(3)[:40], label(1, 40))
    if change == "small":
        rows[4] = write(folder, "e", scene(3)[:20, :20], label(1, 1)[:20, :20])
    files = photos.read_photos(spark, str(folder)).withColumn("id", F.element_at(F.split("id", "/"), -1))
    with pytest.raises(Refused, match=rule):
        externals.prepared_external(inventory(rows), files)
