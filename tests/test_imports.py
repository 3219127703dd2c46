"""A segmentation source, written as its archive holds it, imported and reviewed as a whole."""

import json

import numpy as np
import pytest
from test_photos import jpeg, png

from girder.functions import masks
from girder.functions.rules import Refused
from girder.plans import imports, preparation

SQUARE = [[10.0, 10.0, 30.0, 10.0, 30.0, 20.0, 10.0, 20.0, 10.0, 10.0]]
OTHER = [[100.0, 100.0, 300.0, 100.0, 300.0, 400.0, 100.0, 400.0]]


@pytest.fixture(scope="module")
def plain(spark):
    """A JPEG of one grey, and one with a bright corner."""
    small = np.full((8, 8, 3), 130, np.uint8)
    jvm = spark.sparkContext._jvm

    def large(corner):
        image = jvm.java.awt.image.BufferedImage(640, 640, 1)
        pen = image.createGraphics()
        for grey, side in ((130, 640), *corner):
            pen.setColor(jvm.java.awt.Color(grey, grey, grey))
            pen.fillRect(0, 0, side, side)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        return bytes(out.toByteArray())

    assert jpeg(spark, small)[:2] == b"\xff\xd8"
    return {"grey": large([]), "corner": large([(220, 300), (20, 100)])}


def write(root, photo, index=1, level="Easy", shapes=((0, SQUARE),), paint=None, text=None, **changed):
    base = root / "Damage Segmentaion" / level
    stem = f"{level[0]} ({index})"
    mask = np.zeros((640, 640, 3), np.uint8)
    for k, polygons in paint if paint is not None else shapes:
        mask[masks.rasterised(polygons, 640, 640)] = masks.MASK_COLOURS[k]
    document = {"image": {"file_name": f"{stem}.jpg", "width": 640, "height": 640}, "annotations": [{"category_id": k, "segmentation": p, "bbox": [10, 10, 20, 10], "iscrowd": 0} for k, p in shapes]} | changed
    lines = "\n".join(" ".join([str(k), *[repr(v / 640) for v in p[0]]]) for k, p in shapes) if text is None else text
    for folder, name, content in (("Images", f"{stem}.jpg", photo), ("Labels/Mask", f"{stem}_mask.png", png(mask)), ("Labels/Pascal VOC", f"{stem}.json", json.dumps(document).encode()), ("Labels/Yolo", f"{stem}.txt", lines.encode())):
        (base / folder).mkdir(parents=True, exist_ok=True)
        (base / folder / name).write_bytes(content)


def test_a_source_is_imported_and_reviewed(spark, tmp_path, plain):
    root = tmp_path / "source"
    write(root, plain["grey"])
    write(root, plain["corner"], 12, "Hard", [(0, OTHER), (1, OTHER)])
    write(root, plain["corner"], 3, "Medium", [(1, OTHER)], paint=[])
    write(root, plain["grey"], 2, shapes=[], paint=[])
    tables = imports.imported(spark, str(root))
    rows = {r["id"]: r for r in tables["records"].collect()}
    assert set(rows) == {"easy_0001", "easy_0002", "hard_0012", "medium_0003"}
    first = rows["easy_0001"]
    assert (first["annotation_count"], first["differing"], first["beyond_border"], list(first["ious"])) == (1, 0, 0, [1.0, None]) and first["split"] is first["scene_group"] is None
    assert rows["medium_0003"]["differing"] == 200 * 300 and rows["medium_0003"]["beyond_border"] > 0 and list(rows["medium_0003"]["ious"]) == [None, 0.0]
    assert rows["hard_0012"]["shared"] == 200 * 300 and rows["hard_0012"]["share"] == 1.0 and rows["hard_0012"]["differing"] == 0
    made = [(r["annotation_id"], r["image_id"], r["id"], r["category_id"], r["bbox"], r["area"]) for r in tables["annotations"].orderBy("annotation_id").collect()]
    assert made == [(1, 1, "easy_0001", 1, [10, 10, 20, 10], 200), (2, 3, "hard_0012", 1, [100, 100, 200, 300], 60000), (3, 3, "hard_0012", 2, [100, 100, 200, 300], 60000), (4, 4, "medium_0003", 2, [100, 100, 200, 300], 60000)]
    assert tables["summary"].first().asDict() == {"images": 4, "annotations": 4, "mask_disagreement_images": 1, "mask_disagreement_pixels": 60000, "empty_annotation_images": 1, "approved_for_training": False}
    assert sorted(map(tuple, tables["classes"].collect())) == [(0, 2), (1, 2)]
    assert {(r["n"], r["id"]) for r in tables["duplicates"].collect()} == {(2, i) for i in rows}
    assert [r["file_name"] for r in tables["images"].orderBy("image_id").collect()] == [f"images/{i}.jpg" for i in sorted(rows)]
    review = imports.reviewed(spark, str(root), tables)
    flags = {r["id"]: list(r["flags"]) for r in review["records"].collect()}
    assert flags == {"easy_0001": [], "easy_0002": ["empty_annotations"], "hard_0012": ["source_classes_almost_fully_overlap"], "medium_0003": ["mask_iou_below_review_threshold", "mask_difference_away_from_boundary"]}
    assert {(r["left"], r["right"]) for r in review["pairs"].collect()} == {("easy_0001", "easy_0002"), ("hard_0012", "medium_0003")}
    assert {r["id"] for r in review["sample_decisions"].where("decision = 'pending'").collect()} == {"easy_0002", "hard_0012", "medium_0003"}
    with pytest.raises(Refused, match="inside"):
        preparation.publish_corpus(tables, f"{root}/corpus", [str(root)])
    preparation.publish_corpus(tables, f"file://{tmp_path}/corpus", [str(root)])
    assert spark.read.parquet(f"{tmp_path}/corpus/annotations").count() == 4


def spoil(kind, root, photo):
    base = root / "Damage Segmentaion" / "Easy"
    match kind:
        case "orphan":
            (base / "Images" / "notes.md").write_text("x")
        case "companion":
            (base / "Labels/Yolo/E (1).txt").unlink()
        case "letter":
            (base / "Images/E (1).jpg").rename(base / "Images/M (1).jpg")
        case "labels":
            write(root, photo, text="0 0.5 0.5 0.6 0.5 0.6 0.6")
        case "class":
            write(root, photo, shapes=[(0, SQUARE)], annotations=[{"category_id": 2, "segmentation": SQUARE, "bbox": [1, 1, 1, 1], "iscrowd": 0}])
        case "document":
            write(root, photo, image={"file_name": "other.jpg", "width": 640, "height": 640})
        case "colour":
            mask = np.zeros((640, 640, 3), np.uint8)
            mask[5, 5] = (0, 255, 0)
            (base / "Labels/Mask/E (1)_mask.png").write_bytes(png(mask))
        case "size":
            (base / "Labels/Mask/E (1)_mask.png").write_bytes(png(np.zeros((320, 320, 3), np.uint8)))
        case "broken":
            (base / "Images/E (1).jpg").write_bytes(photo[:3000])


@pytest.mark.parametrize(("kind", "rule"), [("orphan", "no sample"), ("companion", "all of their files"), ("letter", "no sample"), ("labels", "labels differ"), ("class", "unknown class"), ("document", "not its photo"), ("colour", "colours that no class has"), ("size", "other_size")])
def test_what_breaks_a_rule_is_refused(spark, tmp_path, plain, kind, rule):
    write(tmp_path, plain["grey"])
    spoil(kind, tmp_path, plain["grey"])
    with pytest.raises(Refused, match=rule):
        imports.imported(spark, str(tmp_path))
