"""Boxes as structs (x1, y1, x2, y2) of doubles in pixels, and the frames they come in (PRJ-03, 04, 12 to 15, 20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[(F.lit(v) if not isinstance(v, Column) else v).cast("double").alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Centre and size, as label files hold them, to corners in the same unit."""
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def scaled(b: Column, width: Column, height: Column) -> Column:
    """Corners as shares of the image to pixels."""
    return box(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)


def normalised(b: Column, width: Column, height: Column) -> Column:
    return box(b["x1"] / width, b["y1"] / height, b["x2"] / width, b["y2"] / height)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def to_xywh(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    """From a window's frame to the photo's."""
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def clipped(b: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    inside = lambda v, most: F.least(F.greatest(v, zero), most.cast("double"))
    return box(inside(b["x1"], width), inside(b["y1"], height), inside(b["x2"], width), inside(b["y2"], height))


def clip_status(b: Column, width: Column, height: Column) -> Column:
    """kept, clipped or empty_after_clipping."""
    c = clipped(b, width, height)
    return F.when(area(c) <= 0, "empty_after_clipping").when(c.eqNullSafe(b), "kept").otherwise("clipped")


def area(b: Column) -> Column:
    """Width times height; no pixel is added. Not positive if the box is flat."""
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = shared_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def smaller_overlap(a: Column, b: Column) -> Column:
    """The shared part of the smaller of two boxes; 0 where one is flat."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, shared_area(a, b) / least).otherwise(F.lit(0.0))


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def union_area(boxes: Column) -> Column:
    """The area that an array of boxes covers together, slab by slab between neighbouring x; 0 for none and for flat ones."""

    def of(b: Column, xs: Column) -> Column:
        def covered(i: Column) -> Column:
            left, right = F.get(xs, i), F.get(xs, i + 1)
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
            more = lambda s, y: F.struct((s["sum"] + F.greatest(F.lit(0.0), y["y2"] - F.greatest(s["end"], y["y1"]))).alias("sum"), F.greatest(s["end"], y["y2"]).alias("end"))
            run = F.aggregate(b, start, lambda s, y: F.when((y["x1"] <= left) & (y["x2"] >= right), more(s, y)).otherwise(s))
            return (right - left) * run["sum"]

        return F.when(F.size(xs) > 1, F.aggregate(F.sequence(F.lit(0), F.size(xs) - 2), F.lit(0.0), lambda s, i: s + covered(i))).otherwise(F.lit(0.0))

    by_y = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y1"].alias("y1"), b["y2"].alias("y2"), b["x1"].alias("x1"), b["x2"].alias("x2"))))
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(boxes, lambda b: b["x1"]), F.transform(boxes, lambda b: b["x2"]))))
    once = F.transform(F.array(F.struct(by_y.alias("b"), xs.alias("xs"))), lambda v: of(v["b"], v["xs"]))
    return F.element_at(once, 1)


def meets(a: Column, b: Column) -> Column:
    """Whether the interiors share a point; a common edge is none."""
    return (F.greatest(a["x1"], b["x1"]) < F.least(a["x2"], b["x2"])) & (F.greatest(a["y1"], b["y1"]) < F.least(a["y2"], b["y2"]))


def lost_share(b: Column, regions: Column) -> Column:
    """The part of a box that disjoint lost regions (x, y, width, height) cover, 1 at most."""
    lost = F.aggregate(regions, F.lit(0.0), lambda s, r: s + shared_area(b, from_xywh(r["x"], r["y"], r["width"], r["height"])))
    return F.when(area(b) > 0, F.least(F.lit(1.0), lost / area(b))).otherwise(F.lit(0.0))


def sound(b: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Whether a box has finite corners, a positive size and, if sizes are given, lies in the image."""
    ok = F.lit(True)
    for n in ("x1", "y1", "x2", "y2"):
        ok = ok & b[n].isNotNull() & ~F.isnan(b[n]) & (F.abs(b[n]) < float("inf"))
    ok = ok & (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])
    if width is not None:
        ok = ok & (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= width) & (b["y2"] <= height)
    return F.coalesce(ok, F.lit(False))


def mask_pixels(b: Column, width: Column, height: Column) -> Column:
    """Pixels of the rectangular mask of an (x, y, w, h) box, clipped to the image; null if nothing is left (PRJ-20)."""
    n = area(clipped(b, width, height))
    return F.when(n > 0, n)
