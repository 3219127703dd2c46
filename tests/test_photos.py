"""Photos as bytes: headers, orientation, and the stage from bytes to measures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.functions import images
from girder.plans import photos


def exif(orientation, order="<", kind=3, count=1, before=2):
    """A TIFF block whose first directory has some other entries and the orientation."""
    entries = [(256 + i, 4, 1, struct.pack(order + "I", 7)) for i in range(before)]
    entries.append((274, kind, count, struct.pack(order + ("H2x" if kind == 3 else "I"), orientation)))
    head = b"II*\0" if order == "<" else b"MM\0*"
    out = head + struct.pack(order + "IH", 8, len(entries))
    for tag, k, n, value in entries:
        out += struct.pack(order + "HHI", tag, k, n) + value
    return out + struct.pack(order + "I", 0)


def png(rgb, block=None, extra=()):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    gray = rgb.ndim == 2
    lines = b"".join(b"\0" + row.tobytes() for row in rgb)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 0 if gray else 2, 0, 0, 0))
    for name, body in extra:
        out += chunk(name, body)
    if block is not None:
        out += chunk(b"eXIf", block)
    return out + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def jpeg(spark, rgb, block=None):
    """A JPEG as the JVM writes it, with an EXIF segment put in."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(rgb.shape[1], rgb.shape[0], 1)
    for y in range(rgb.shape[0]):
        for x in range(rgb.shape[1]):
            r, g, b = map(int, rgb[y, x])
            image.setRGB(x, y, (r << 16 | g << 8 | b) - (1 << 24))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    raw = bytes(out.toByteArray())
    if block is None:
        return raw
    body = b"Exif\0\0" + block
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + raw[2:]


@pytest.mark.parametrize("order", ["<", ">"])
def test_orientation_is_found_in_the_directory(order):
    for k in range(1, 9):
        assert images.exif_orientation(exif(k, order)) == images.exif_orientation(exif(k, order, kind=4)) == k
    assert images.exif_orientation(exif(9, order)) == 9
    assert images.exif_orientation(exif(3, order, kind=2)) == images.exif_orientation(exif(3, order, count=2)) == 0
    whole = exif(6, order)
    for cut in range(len(whole)):
        assert images.exif_orientation(whole[:cut]) in (1, 6)
    assert images.exif_orientation(whole[:4] + struct.pack(order + "I", 1 << 31)) == 1
    assert images.exif_orientation(b"") == images.exif_orientation(b"no TIFF at all") == 1


def test_headers_say_why_a_photo_is_refused():
    rgb = np.zeros((40, 50, 3), np.uint8)
    say = lambda content, **how: images.header_problem(images.photo_header(content), **how)
    assert say(png(rgb)) is None and say(png(rgb[..., 0])) is None
    assert images.photo_header(png(rgb, exif(6))) == images.Header("png", 50, 40, 3, 8, 1, 6)
    assert say(png(rgb, exif(9))) == say(png(rgb, exif(0))) == "invalid_orientation"
    assert say(png(rgb[:20])) == "too_small" and say(png(np.zeros((40, 0, 3), np.uint8))) == "no_image_header"
    assert say(png(rgb, extra=[(b"acTL", struct.pack(">II", 3, 0))])) == "several_frames"
    wide = bytearray(png(rgb))
    wide[16:24] = struct.pack(">II", 4001, 4000)
    assert say(bytes(wide)) == "too_many_pixels"
    wide[25] = 6
    wide[16:24] = struct.pack(">II", 50, 40)
    assert say(bytes(wide)) == "unsupported_mode"
    assert say(png(rgb), source=True) == "other_size"
    large = np.zeros((640, 640, 3), np.uint8)
    assert say(png(large), source=True) is None and say(png(large, exif(3)), source=True) == "turned" and say(png(large[..., 0]), source=True) == "unsupported_mode"
    assert say(b"") == say(b"GIF89a") == say(b"\xff\xd8\xff\xe0") == "no_image_header"
    assert say(b"\xff\xd8\xff\xe2\x00\x08MPF\0xx" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 100, 90) + b"\x03" + bytes(9)) == "several_frames"


@pytest.fixture(scope="module")
def scene():
    """A picture without any symmetry."""
    y, x = np.mgrid[0:48, 0:64]
    r = (3 * x + y) % 256
    g = np.where((x - 20) ** 2 + (y - 12) ** 2 < 90, 220, 60)
    b = np.where(y > 30, x * 2, 30)
    return np.stack([r, g, b], axis=-1).astype(np.uint8)


def test_all_orientations_from_bytes_to_measures(spark, tmp_path, scene):
    undo = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}
    for k in range(1, 9):
        stored = images.oriented(scene, undo[k])  # so that the tag turns it back
        (tmp_path / f"turn{k}.png").write_bytes(png(stored, exif(k, "<" if k % 2 else ">")))
        (tmp_path / f"turn{k}.jpg").write_bytes(jpeg(spark, stored, exif(k)))
    (tmp_path / "plain.png").write_bytes(png(scene))
    (tmp_path / "gray.png").write_bytes(png(images.gray(scene)))
    (tmp_path / "cut.png").write_bytes(png(scene)[:200])
    (tmp_path / "cut.jpg").write_bytes(jpeg(spark, scene)[:60])
    (tmp_path / "text.png").write_bytes(b"not a photo")
    (tmp_path / "odd.png").write_bytes(png(scene, exif(11)))
    table = photos.read_photos(spark, str(tmp_path))
    got = {r["id"].rpartition("/")[2]: r for r in photos.photo_measures(table).collect()}
    assert len(got) == 22
    luma = images.gray(scene)
    lost, shares = images.exposure(luma)
    for k in range(1, 9):
        r = got[f"turn{k}.png"]
        assert r["problem"] is None and (r["orientation"], r["width"], r["height"]) == (k, 64, 48)
        assert (r["across"], r["down"]) == images.difference_hash(luma) and r["readable_fraction"] == shares["readable_fraction"]
        assert r["sharpness"] == pytest.approx(images.sharpness(luma)) and [x.asDict() for x in r["lost_regions"]] == lost
        assert r["views"] == got["plain.png"]["views"] and len(r["views"]) == 8 and r["verdict"] == got["plain.png"]["verdict"]
        j = got[f"turn{k}.jpg"]
        assert j["problem"] is None and (j["form"], j["width"], j["height"]) == ("jpeg", 64, 48)
        # A JPEG is not exact; it must be the same picture the same way round.
        apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        assert apart(j["across"], r["across"]) + apart(j["down"], r["down"]) <= 10
    assert got["gray.png"]["problem"] is None and got["gray.png"]["across"] == got["plain.png"]["across"]
    assert {k: got[k]["problem"] for k in ("cut.jpg", "text.png", "odd.png")} == {"cut.jpg": "no_image_header", "text.png": "no_image_header", "odd.png": "invalid_orientation"}
    assert got["cut.png"]["problem"] in ("not_decoded", None) and got["text.png"]["verdict"] is None and got["text.png"]["views"] is None
    assert {r["sha256"] for r in table.collect() if r["id"].endswith("plain.png")} == {__import__("hashlib").sha256(png(scene)).hexdigest()}


def test_turned_copies_are_similar_photos(spark, tmp_path, scene):
    rng = np.random.default_rng(2)
    (tmp_path / "a.png").write_bytes(png(scene))
    (tmp_path / "b.png").write_bytes(png(images.oriented(scene, 6)))
    (tmp_path / "c.png").write_bytes(png(np.clip(scene.astype(int) + rng.integers(-2, 3, scene.shape), 0, 255).astype(np.uint8)))
    (tmp_path / "d.png").write_bytes(png(rng.integers(0, 256, scene.shape).astype(np.uint8)))
    rows = photos.measured(photos.read_photos(spark, str(tmp_path))).withColumn("id", F.element_at(F.split("id", "/"), -1))
    got = {(r["left"], r["right"]): (r["view"], r["error"]) for r in photos.similar_photos(rows, 10, 4.0).collect()}
    assert set(got) == {("a.png", "b.png"), ("a.png", "c.png"), ("b.png", "c.png")}
    assert got["a.png", "c.png"][0] == 0 and got["a.png", "b.png"][0] != 0 and got["a.png", "b.png"][1] < 1
