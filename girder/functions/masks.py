"""Run-length masks in column order: kernels on arrays of run lengths, the first run empty pixels (PRJ-12, 16 to 21; SRC-17, AG-20).

Kernels are NumPy functions; the column functions wrap them for Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def encode(mask: np.ndarray) -> list[int]:
    """Run lengths of a two-dimensional mask read column by column."""
    flat = np.asarray(mask, bool).ravel(order="F")
    if not len(flat):
        return []
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.r_[0, edges, len(flat)]).tolist()
    return [0, *runs] if flat[0] else runs


def decode(runs: list[int], height: int, width: int) -> np.ndarray:
    if sum(runs) != height * width or any(r < 0 for r in runs):
        raise ValueError("runs do not cover the image")
    flat = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    return flat.reshape((height, width), order="F")


def area(runs: list[int]) -> int:
    return int(sum(runs[1::2]))


def bounds(runs: list[int], height: int) -> tuple[int, int, int, int] | None:
    """x, y, width, height of the tightest box; none for an empty mask."""
    ends = np.cumsum(runs)
    spans = [(int(e - r), int(e)) for r, e in zip(runs[1::2], ends[1::2], strict=True) if r]
    if not spans:
        return None
    x1, x2 = spans[0][0] // height, (spans[-1][1] - 1) // height
    tall = any(a // height != (b - 1) // height for a, b in spans)
    y1 = 0 if tall else min(a % height for a, _ in spans)
    y2 = height - 1 if tall else max((b - 1) % height for _, b in spans)
    return x1, y1, x2 - x1 + 1, y2 - y1 + 1


def combined(a: list[int], b: list[int], both: bool) -> list[int]:
    """Intersection or union of two masks of one size, run by run."""
    cuts = np.unique(np.r_[0, np.cumsum(a), np.cumsum(b)])
    if cuts[-1] == 0:
        return []
    inside = lambda runs: np.searchsorted(np.cumsum(runs), cuts[:-1], side="right") % 2 == 1
    x, y = inside(a), inside(b)
    keep = x & y if both else x | y
    edges = np.flatnonzero(np.diff(keep)) + 1
    at = np.r_[cuts[0], cuts[edges], cuts[-1]]
    runs = np.diff(at).tolist()
    return [0, *runs] if keep[0] else runs


def overlap(a: list[int], b: list[int]) -> float:
    """Intersection over union; 0 for two empty masks."""
    union = area(combined(a, b, both=False))
    return area(combined(a, b, both=True)) / union if union else 0.0


def to_text(runs: list[int]) -> str:
    """The compressed text of runs: from the fourth on as differences to the run two before, five bits a character, low bits first."""
    out = []
    for i, run in enumerate(runs):
        x = run - runs[i - 2] if i > 2 else run
        more = True
        while more:
            low, x = x & 31, x >> 5
            more = x != (-1 if low & 16 else 0)
            out.append(chr((low | 32 if more else low) + 48))
    return "".join(out)


def from_text(text: str, height: int, width: int, most: int = 1_000_000) -> list[int]:
    """Runs of a compressed text; anything that does not cover the image exactly is refused.

    All characters are read at once: those without the sixth bit end a number, numbers are sums of their shifted five bits, and from the
    fourth run on a number adds to the run two places before, so odd and even runs are running sums.
    """
    if not isinstance(text, str) or not 1 <= len(text) <= most:
        raise ValueError("mask text is empty or too long")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - 48
    last = np.flatnonzero(codes & 32 == 0)
    first = np.concatenate([[0], last[:-1] + 1])
    digits = np.diff(np.append(first, len(codes))) if len(last) else np.zeros(1, int)
    if codes.min() < 0 or codes.max() > 63 or not len(last) or last[-1] + 1 < len(codes) or digits.max() > 6:
        raise ValueError("mask text has an unknown character or an endless run")
    place = 5 * (np.arange(len(codes)) - np.repeat(first, digits))
    runs = np.add.reduceat((codes & 31) << place, first) - np.where(codes[last] & 16, 1 << 5 * digits, 0)
    runs[1::2], runs[2::2] = np.cumsum(runs[1::2]), np.cumsum(runs[2::2])
    if (runs < 0).any() or (runs[1:] == 0).any():
        raise ValueError("mask text has an impossible run")
    if runs.sum() != height * width:
        raise ValueError("mask text does not cover the image")
    return runs.tolist()


#: Fixed limits of a saved mask's photo.
LEAST_SIDE, MOST_PIXELS = 32, 16_000_000


def rle_problem(width: int, height: int):
    """A column function of a mask's size (height, width) and text: what is wrong with them, null if nothing is (SRC-17)."""

    @F.pandas_udf("string")
    def found(size: pd.Series, text: pd.Series) -> pd.Series:
        def one(s, t) -> str | None:
            if min(width, height) < LEAST_SIDE or width * height > MOST_PIXELS:
                return "bad_photo_size"
            if s is None or list(s) != [height, width]:
                return "mask_size_differs"
            try:
                from_text(t, height, width)
            except ValueError as e:
                return str(e)
            return None

        return pd.Series([one(s, t) for s, t in zip(size, text, strict=True)], dtype=object)

    return found


def rasterised(polygons: list[list[float]], height: int, width: int) -> np.ndarray:
    """A mask of the pixels whose centre lies in any of the polygons, even-odd in each."""
    out = np.zeros((height, width), bool)
    ys = np.arange(height) + 0.5
    xs = np.arange(width) + 0.5
    for flat in polygons:
        p = np.asarray(flat, float).reshape(-1, 2)
        q = np.roll(p, -1, axis=0)
        for row, y in enumerate(ys):
            crosses = (p[:, 1] <= y) != (q[:, 1] <= y)
            if crosses.any():
                a, b = p[crosses], q[crosses]
                at = np.sort(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))
                out[row] |= np.searchsorted(at, xs, side="right") % 2 == 1
    return out


#: Fixed colours of the source's masks, by class; black is none.
MASK_COLOURS = ((255, 0, 0), (0, 0, 255))


def palette_agreement(source: np.ndarray, drawn: list[np.ndarray]) -> dict:
    """An RGB mask held against its classes' drawn masks, later ones on top: differing pixels and IoU by class, null where a class is on neither (PRJ-16).

    Refused are colours that no class has and a class's empty drawing.
    """
    place = np.array([65536, 256, 1])
    codes = source.astype(np.int64) @ place
    known = np.concatenate([[0], np.array(MASK_COLOURS) @ place])
    if not np.isin(codes, known).all():
        raise ValueError("mask has colours that no class has")
    order = np.argsort(known)
    if any(not m.any() for m in drawn if m is not None):
        raise ValueError("a polygon draws nothing")
    labels = order[np.searchsorted(known[order], codes)]
    made = np.zeros_like(labels)
    for k, m in enumerate(drawn):
        if m is not None:
            made[m] = k + 1
    ious = {}
    for k in range(1, len(MASK_COLOURS) + 1):
        a, b = labels == k, made == k
        union = int((a | b).sum())
        ious[k - 1] = float((a & b).sum() / union) if union else None
    return {"differing": int((labels != made).sum()), "iou": ious}


def union_of_windows(height: int, width: int, windows: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
    """All windows' masks (mask, x, y) or-ed into one canvas (AG-20)."""
    out = np.zeros((height, width), bool)
    for mask, x, y in windows:
        out = placed(out, mask, x, y)
    return out


def placed(canvas: np.ndarray, window: np.ndarray, x: int, y: int) -> np.ndarray:
    """The canvas with a window's mask or-ed in at an offset, cut at the edges."""
    h, w = (min(window.shape[0], canvas.shape[0] - y), min(window.shape[1], canvas.shape[1] - x))
    out = canvas.copy()
    out[y : y + h, x : x + w] |= window[:h, :w]
    return out


def compared(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Differing pixels, those of them farther than a 3 by 3 neighbourhood from the other mask's border, and IoU."""

    def wide(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, 1)
        return np.any([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)

    border = wide(b) & wide(~b)
    differ = a != b
    union = int((a | b).sum())
    return {"differing": int(differ.sum()), "beyond_border": int((differ & ~border).sum()), "iou": float((a & b).sum() / union) if union else 0.0}


def binarised(gray: np.ndarray, level: int = 128, low: int = 96, high: int = 160) -> dict[str, int]:
    """Foreground pixels at a level and at two others, which show how much depends on it."""
    return {"foreground": int((gray >= level).sum()), "foreground_low": int((gray >= low).sum()), "foreground_high": int((gray >= high).sum())}


def class_overlap(masks: list[np.ndarray]) -> tuple[int, float | None]:
    """Pixels that two classes share and their part of the smaller class, undefined if that is empty."""
    shared, least = int((masks[0] & masks[1]).sum()), min(int(m.sum()) for m in masks)
    return shared, shared / least if least else None


@pandas_udf(DoubleType())
def mask_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """IoU of two columns of run arrays."""
    return pd.Series([None if x is None or y is None else overlap(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Float64")


@pandas_udf(ArrayType(IntegerType()))
def mask_runs(text: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Runs of compressed texts; null where the text is refused."""

    def one(t, h, w):
        try:
            return from_text(t, int(h), int(w))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(*x) for x in zip(text, height, width, strict=True)], dtype="object")
