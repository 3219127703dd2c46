"""Scalar rules: a value is sound or refused, never mended (PRJ-05, 06, 08, 24, 25; ST-01, ST-04; WN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """Data that break a rule; the message has the rule and examples."""


def is_text(x: Column, most: int = 160) -> Column:
    """Trimmed, not empty, at most so long, without control characters but newline and tab."""
    return F.coalesce((F.length(x).between(1, most)) & (F.trim(x) == x) & ~x.rlike(r"[\x00-\x08\x0B-\x1F\x7F]") & ~x.rlike(r"^\s|\s$"), F.lit(False))


def is_hex(x: Column, digits: int) -> Column:
    return F.coalesce(x.rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


#: ISO 8601 with an offset or Z.
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def utc_text(x: Column) -> Column:
    """A timestamp with an offset as UTC text with microseconds, which sorts as time does; null if it has no offset."""
    at = F.when(x.rlike(STAMP), F.try_to_timestamp(x))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def refuse(violations: DataFrame, rule: str, examples: int = 5) -> None:
    """Raise if there is any row; the rows are the examples."""
    found = violations.limit(examples).collect()
    if found:
        raise Refused(f"{rule}: {[r.asDict(recursive=True) for r in found]}")


def refuse_over(table: DataFrame, most: int, what: str) -> None:
    """A cap refuses; it never cuts rows off."""
    if table.limit(most + 1).count() > most:
        raise Refused(f"more than {most} {what}")


def repeated(table: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as often as they exceed the other side, with the side that has them; empty if the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


#: Fixed limits of photo quality.
QUALITY_LIMITS = {
    "dark_level": 16.0,
    "bright_level": 245.0,
    "block_lost_fraction": 0.80,
    "partial_fraction": 0.95,
    "unusable_fraction": 0.40,
    "low_detail_floor": 12.0,
}


def lost_reason(dark: Column, bright: Column, pixels: Column, limits: dict = QUALITY_LIMITS) -> Column:
    """too_dark or too_bright where a cell is lost, else null; a tie is dark."""
    lost = dark / pixels + bright / pixels >= limits["block_lost_fraction"]
    return F.when(lost & (dark >= bright), "too_dark").when(lost, "too_bright")


def photo_verdict(readable: Column, sharpness: Column, limits: dict = QUALITY_LIMITS) -> Column:
    """unusable only for what cannot be read; lack of detail makes a photo partial at most."""
    part = (readable < limits["partial_fraction"]) | (sharpness < limits["low_detail_floor"])
    return F.when(readable < limits["unusable_fraction"], "unusable").when(part, "partial").otherwise("usable")


def photo_reasons(readable: Column, sharpness: Column, limits: dict = QUALITY_LIMITS) -> Column:
    lost = F.when(readable < limits["partial_fraction"], "lost_regions")
    return F.array_compact(F.array(lost, F.when(sharpness < limits["low_detail_floor"], "low_detail")))


def analysis_outcome(verdict: Column, n_findings: Column) -> Column:
    """What an analysis may claim: a photo that cannot be read says nothing, and no finding is not an absence."""
    return F.when(verdict == "unusable", "not_assessable").when(n_findings > 0, "defects_found").when(verdict == "partial", "partial_analysis").otherwise("no_target_defect_in_readable_area")
