"""Measures of decoded images as NumPy kernels (PRJ-09, 10, 22, 23; SRC-18)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from girder.functions.rules import QUALITY_LIMITS

GRID = 16
COUNTED_PIXELS = 4_000_000
SHARP_WINDOWS, SHARP_SIDE = 4, 256


#: Fixed limits of a photo: pixels of any, and the one size of the segmentation source's.
MOST_PIXELS, SOURCE_SIZE = 16_000_000, (640, 640)


def size_in_header(content: bytes) -> tuple[int, int] | None:
    """Width and height as a PNG's or JPEG's header says, before any pixel is decoded; None for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR":
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind = content[at + 1]
        # The frame headers are C0 to CF but for the tables C4, C8 and CC.
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def size_problem(content: bytes, most_bytes: int, source: bool = False) -> str | None:
    """Why a photo may not be decoded, None if it may; ``source``: it must have the one size of the segmentation source."""
    if len(content) > most_bytes:
        return "too_many_bytes"
    size = size_in_header(content)
    if size is None or min(size) < 1:
        return "no_image_header"
    if size[0] * size[1] > MOST_PIXELS:
        return "too_many_pixels"
    return "other_size" if source and size != SOURCE_SIZE else None


@dataclass(frozen=True)
class Header:
    """What a photo's bytes say before any pixel is decoded; orientation is EXIF's, 1 where none is given."""

    form: str | None = None
    width: int = 0
    height: int = 0
    channels: int = 0
    bits: int = 8
    frames: int = 1
    orientation: int = 1


#: EXIF's tag for the orientation; how its numbers may be stored.
ORIENTATION_TAG, SHORT, LONG = 274, 3, 4


def exif_orientation(block: bytes) -> int:
    """The orientation in a block of EXIF (a TIFF header and directories): 1 if it has none, 0 if it has one that is no whole number.

    Only the first directory counts. An offset beyond the block, or bytes that are no TIFF, leave the photo as it is.
    """
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(block[:4])
    if order is None:
        return 1
    number = lambda at, n: int.from_bytes(block[at : at + n], order)
    at = number(4, 4)
    for entry in range(at + 2, min(at + 2 + 12 * number(at, 2), len(block) - 11), 12):
        if number(entry, 2) == ORIENTATION_TAG:
            kind = number(entry + 2, 2)
            return number(entry + 8, 2 if kind == SHORT else 4) if kind in (SHORT, LONG) and number(entry + 4, 4) == 1 else 0
    return 1


def png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(content):
        long = int.from_bytes(content[at : at + 4], "big")
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + long]
        at += 12 + long


def jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Markers and their contents up to the first scan."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        if content[at + 1] == 0xFF:
            at += 1
            continue
        long = int.from_bytes(content[at + 2 : at + 4], "big")
        yield content[at + 1], content[at + 4 : at + 2 + long]
        at += 2 + max(long, 2)


def photo_header(content: bytes) -> Header:
    """The header of a PNG or JPEG, an empty one of anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 29:
        width, height = (int.from_bytes(content[k : k + 4], "big") for k in (16, 20))
        frames, turn = 1, 1
        for kind, body in png_chunks(content):
            if kind == b"acTL":
                frames = int.from_bytes(body[:4], "big")
            elif kind == b"eXIf":
                turn = exif_orientation(body)
            elif kind == b"IDAT" and turn != 1:
                break
        return Header("png", width, height, {0: 1, 2: 3}.get(content[25], 0), content[24], frames, turn)
    if content[:2] != b"\xff\xd8":
        return Header()
    found, turn, frames = None, None, 1
    for kind, body in jpeg_segments(content):
        if kind == 0xE1 and body[:6] == b"Exif\0\0" and turn is None:
            turn = exif_orientation(body[6:])
        elif kind == 0xE2 and body[:4] == b"MPF\0":
            frames = 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) >= 6 and found is None:
            found = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), body[5], body[0]
    return Header("jpeg", *found, frames, 1 if turn is None else turn) if found else Header()


#: Fixed least side of a photo that is analysed.
LEAST_PHOTO_SIDE = 32


def header_problem(h: Header, source: bool = False) -> str | None:
    """Why a photo of this header may not be decoded, None if it may (SRC-18).

    ``source``: a photo of the segmentation source, whose annotations fit one size, colours and no turn only.
    """
    if h.form is None or min(h.width, h.height) < 1:
        return "no_image_header"
    if source:
        return "other_size" if (h.width, h.height) != SOURCE_SIZE else "unsupported_mode" if h.channels != 3 or h.bits != 8 else "turned" if h.orientation != 1 else None
    if min(h.width, h.height) < LEAST_PHOTO_SIDE:
        return "too_small"
    if h.width * h.height > MOST_PIXELS:
        return "too_many_pixels"
    if h.channels not in (1, 3) or h.bits != 8:
        return "unsupported_mode"
    if h.frames != 1:
        return "several_frames"
    return None if 1 <= h.orientation <= 8 else "invalid_orientation"


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of an RGB image in whole numbers, by the usual 299, 587, 114 weights with 16-bit rounding."""
    if rgb.ndim == 2:
        return rgb.astype(np.uint8)
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned as the EXIF orientation (1 to 8) says."""
    flips = {1: lambda a: a, 2: np.fliplr, 3: lambda a: np.rot90(a, 2), 4: np.flipud, 5: lambda a: np.swapaxes(a, 0, 1), 6: lambda a: np.rot90(a, -1), 7: lambda a: np.rot90(np.swapaxes(a, 0, 1), 2), 8: lambda a: np.rot90(a, 1)}
    return flips[orientation](image)


def lanczos(size_in: int, size_out: int, lobes: int = 3) -> np.ndarray:
    """Weights (out, in) of a Lanczos resampling along one axis."""
    scale = size_in / size_out
    reach = lobes * max(scale, 1.0)
    out = np.zeros((size_out, size_in))
    for i in range(size_out):
        centre = (i + 0.5) * scale
        x = (np.arange(size_in) + 0.5 - centre) / max(scale, 1.0)
        w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        w[np.abs(np.arange(size_in) + 0.5 - centre) > reach] = 0.0
        out[i] = w / w.sum()
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.tensordot(lanczos(image.shape[0], height), image.astype(float), axes=(1, 0))
    both = np.moveaxis(np.tensordot(lanczos(image.shape[1], width), rows, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def difference_hash(luma: np.ndarray) -> tuple[int, int]:
    """64 bits of left-to-right and 64 of top-to-bottom rises on small grids, as two signed longs."""
    across, down = resized(luma, 8, 9).astype(int), resized(luma, 9, 8).astype(int)
    bits = [(across[:, :-1] > across[:, 1:]).ravel(), (down[:-1] > down[1:]).ravel()]
    return tuple(int(np.packbits(b).view(">i8")[0]) for b in bits)  # type: ignore[return-value]


def views(image: np.ndarray) -> list[np.ndarray]:
    """The image and its seven turned and mirrored views."""
    return [oriented(image, k) for k in (1, 2, 4, 3, 5, 8, 6, 7)]


def fingerprint(rgb: np.ndarray, thumb: int = 32) -> list[tuple[tuple[int, int], bytes]]:
    """Hash and thumbnail bytes of every view."""
    return [(difference_hash(gray(v)), resized(v, thumb, thumb).tobytes()) for v in views(rgb)]


def pair_measures(left: np.ndarray, right: np.ndarray, view: int, left_mask: np.ndarray, right_mask: np.ndarray, error: float = 2.0, overlap: float = 0.98) -> dict:
    """A similar pair looked at in full size: error and mask IoU with the right side turned as its view says, and whether a person must look (JN-15)."""
    turned, mask = views(right)[view], views(right_mask)[view]
    if turned.shape != left.shape or mask.shape != left_mask.shape:
        return {"error": None, "iou": None, "review_required": True}
    far = float(np.abs(left.astype(float) - turned).mean())
    union = int((left_mask | mask).sum())
    iou = float((left_mask & mask).sum() / union) if union else 1.0
    return {"error": far, "iou": iou, "review_required": far > error or iou < overlap}


@dataclass(frozen=True)
class Tiles:
    """An image's sides cut into up to ``GRID`` stretches each, at whole pixels nearest to even cuts (halves to even)."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, shape: tuple[int, int], parts: int = GRID) -> Tiles:
        # Cuts of a short side that fall together, or on its end, are one, so no stretch is empty.
        cuts = [np.unique(np.rint(np.arange(parts) * side / parts).astype(int)) for side in shape]
        return cls(*[c[c < side] for c, side in zip(cuts, shape, strict=True)], shape)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.add.reduceat(values, self.rows, axis=0, dtype=np.int64), self.columns, axis=1)

    def boxes(self, scale: int, bounds: tuple[int, int]) -> np.ndarray:
        """(rows, columns, 4): x, y, width, height of every tile in an image ``scale`` times as large that ends at ``bounds``."""
        at = [np.minimum(np.append(cuts, side) * scale, most) for cuts, side, most in zip((self.rows, self.columns), self.shape, bounds, strict=True)]
        y, x = np.meshgrid(at[0][:-1], at[1][:-1], indexing="ij")
        height, width = np.meshgrid(np.diff(at[0]), np.diff(at[1]), indexing="ij")
        return np.stack([x, y, width, height], axis=-1)


def averaged(luma: np.ndarray, most: int = COUNTED_PIXELS) -> tuple[np.ndarray, int]:
    """An image averaged over the smallest squares that leave at most ``most`` of them, about, and the side of a square."""
    side = math.isqrt((luma.size - 1) // most) + 1
    if side == 1:
        return luma, 1
    tall, wide = (-(-n // side) for n in luma.shape)
    # Squares at the lower and right edge hold fewer pixels, so pixels are summed and counted in the same way.
    spare = [(0, tall * side - luma.shape[0]), (0, wide * side - luma.shape[1])]
    total, number = (np.pad(a.astype(np.int64), spare).reshape(tall, side, wide, side).sum(axis=(1, 3)) for a in (luma, np.ones_like(luma)))
    return ((2 * total + number) // (2 * number)).astype(np.uint8), side


def exposure(luma: np.ndarray, limits: dict = QUALITY_LIMITS) -> tuple[list[dict], dict[str, float]]:
    """Tiles lost to dark or bright, in pixels of the image, and the shares they come from."""
    small, scale = averaged(luma)
    tiles = Tiles.of(small.shape)
    masks = {"too_dark": small <= limits["dark_level"], "too_bright": small >= limits["bright_level"]}
    area = tiles.sums(np.ones_like(small))
    share = np.stack([tiles.sums(m) / area for m in masks.values()])
    lost = share.sum(axis=0) >= limits["block_lost_fraction"]
    reason = np.array(list(masks))[share.argmax(axis=0)[lost]]  # of equal shares the first, dark
    found = [dict(zip(("x", "y", "width", "height"), box, strict=True)) | {"reason": str(r)} for box, r in zip(tiles.boxes(scale, luma.shape)[lost].tolist(), reason, strict=True)]
    dark, bright = (float(np.count_nonzero(m)) / small.size for m in masks.values())
    return found, {"mean_luminance": float(small.mean()), "dark_fraction": dark, "bright_fraction": bright, "readable_fraction": 1.0 - float(area[lost].sum()) / small.size, "counting_scale": float(scale)}


def sharpness(luma: np.ndarray) -> float:
    """The largest variance of the four-neighbour Laplacian over a grid of windows, none if a side has fewer than three pixels."""
    side = min(SHARP_SIDE, *luma.shape)
    if side < 3:
        return 0.0
    signal = luma.astype(np.float32)
    # The sum of second differences along both sides is that Laplacian with its sign turned, taken once for all windows.
    bent = np.diff(signal, 2, axis=0)[:, 1:-1] + np.diff(signal, 2, axis=1)[1:-1]
    views = np.lib.stride_tricks.sliding_window_view(bent, (side - 2, side - 2))
    rows, columns = (np.unique(np.rint(np.linspace(0, n - 1, SHARP_WINDOWS)).astype(int)) for n in views.shape[:2])
    return float(views[np.ix_(rows, columns)].var(axis=(-2, -1)).max())


def assess(images: DataFrame) -> DataFrame:
    """Measures of each row of Spark's image source: origin, mean_luminance, readable_fraction, sharpness, lost_regions."""
    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    schema = "origin string, mean_luminance double, dark_fraction double, bright_fraction double, readable_fraction double, sharpness double, lost_regions array<struct<x:int,y:int,width:int,height:int,reason:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                luma = gray(a[..., 2::-1]) if r.nChannels >= 3 else gray(a[..., 0])
                lost, m = exposure(luma)
                out.append((r.origin, m["mean_luminance"], m["dark_fraction"], m["bright_fraction"], m["readable_fraction"], sharpness(luma), lost))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return flat.mapInPandas(run, schema)
