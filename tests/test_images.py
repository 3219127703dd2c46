"""Image measures against loops over pixels."""

import numpy as np
import pytest

from girder.functions import images
from girder.functions.rules import QUALITY_LIMITS as LIMITS


def cuts(n):
    at = [round(n * k / 16) for k in range(17)]
    return [range(a, b) for a, b in zip(at, at[1:], strict=False) if b > a]


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (3, 3), (7, 40), (33, 50), (300, 517)])
def test_lost_tiles_are_those_of_the_rule(shape):
    rng = np.random.default_rng(0)
    luma = rng.integers(0, 256, shape).astype(np.uint8)
    luma[: shape[0] // 2] = rng.choice([0, 255, 100])
    luma[:, : shape[1] // 3] = 255
    found, m = images.exposure(luma)
    expected, gone = [], 0
    for rows in cuts(shape[0]):
        for columns in cuts(shape[1]):
            cell = [int(luma[y, x]) for y in rows for x in columns]
            dark, bright = sum(v <= LIMITS["dark_level"] for v in cell), sum(v >= LIMITS["bright_level"] for v in cell)
            if (dark + bright) / len(cell) >= LIMITS["block_lost_fraction"]:
                gone += len(cell)
                expected.append({"x": columns[0], "y": rows[0], "width": len(columns), "height": len(rows), "reason": "too_dark" if dark >= bright else "too_bright"})
    assert found == expected
    assert m["readable_fraction"] == pytest.approx(1 - gone / luma.size) and m["mean_luminance"] == pytest.approx(luma.mean())
    assert images.sharpness(luma) == pytest.approx(brute_sharpness(luma), rel=1e-4)


def brute_sharpness(luma):
    best, side = 0.0, min(256, *luma.shape)
    if side < 3:
        return best
    for i in range(4):
        for j in range(4):
            top, left = round((luma.shape[0] - side) * i / 3), round((luma.shape[1] - side) * j / 3)
            w = luma[top : top + side, left : left + side].astype(float)
            best = max(best, (4 * w[1:-1, 1:-1] - w[:-2, 1:-1] - w[2:, 1:-1] - w[1:-1, :-2] - w[1:-1, 2:]).var())
    return best


def test_large_images_are_averaged_over_squares():
    luma = np.random.default_rng(1).integers(0, 256, (11, 7)).astype(np.uint8)
    small, side = images.averaged(luma, most=20)
    assert side == 2 and small.shape == (6, 4)
    for y in range(6):
        for x in range(4):
            cell = luma[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].astype(float)
            assert small[y, x] == int(cell.mean() + 0.5)
    boxes = images.Tiles.of(small.shape).boxes(side, luma.shape)
    assert boxes[-1, -1].tolist() == [6, 10, 1, 1] and boxes[..., 2].sum(axis=1).tolist() == [7] * 6
    assert images.averaged(luma, most=77)[1] == 1


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"


def jpeg(width, height):
    app = b"\xff\xe0" + (16).to_bytes(2, "big") + b"x" * 14
    table = b"\xff\xc4" + (6).to_bytes(2, "big") + b"\xff\xc0\x00\x00"
    return b"\xff\xd8" + app + table + b"\xff\xff\xc2" + (17).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03"


def test_sizes_are_read_from_headers():
    assert images.size_in_header(png(640, 480)) == (640, 480) and images.size_in_header(jpeg(321, 123)) == (321, 123)
    assert images.size_in_header(b"GIF89a") is None and images.size_in_header(jpeg(5, 5)[:30]) is None and images.size_in_header(b"") is None
    problem = lambda c, **k: images.size_problem(c, 100, **k)
    assert problem(png(640, 640), source=True) is None and problem(jpeg(4000, 4000)) is None
    assert (problem(jpeg(4001, 4000)), problem(png(640, 480), source=True), problem(b"x" * 101), problem(b"x"), problem(png(0, 5))) == ("too_many_pixels", "other_size", "too_many_bytes", "no_image_header", "no_image_header")
