"""A grid of overlapping windows over an image (WN-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offsets(size: Column, window: int, step: int) -> Column:
    """Starts along one side, the last one at the edge."""
    last = F.greatest(size.cast("int") - window, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))))


def window_grid(images: DataFrame, window: int = 640, overlap: int = 128) -> DataFrame:
    """image, x, y, width, height of all windows of images (image, width, height)."""
    step = window - overlap
    rows = images.select("image", "width", "height", F.explode(offsets(F.col("height"), window, step)).alias("y")).select("*", F.explode(offsets(F.col("width"), window, step)).alias("x"))
    side = lambda at, whole: (F.least(F.col(at) + window, F.col(whole).cast("int")) - F.col(at)).alias(whole)
    return rows.select("image", "x", "y", side("x", "width"), side("y", "height"))
