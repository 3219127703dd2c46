"""Ratios that are null where they are undefined (PRJ-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Null if precision or recall is, 0 without a hit."""
    return F.when((tp + fp > 0) & (tp + fn > 0), 2.0 * tp / (2 * tp + fp + fn))


def finite_mean(x: Column) -> Column:
    """The mean of values that are defined, which negative ones are not; null if there are none."""
    return F.avg(F.when((x >= 0) & ~F.isnan(x), x))


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f %%", x * 100))
