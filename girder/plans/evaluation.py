"""Evaluations of a table of predictions (ENG-04, AG-19, PRJ-27, PRJ-28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.rules import Refused
from girder.operators import confusion, coverage, matching, precision
from girder.operators.digests import table_digest
from girder.shared import staged


def checked_grid(thresholds: list[int], least: int = 0, most: int = 1000) -> list[int]:
    """Thresholds that ascend strictly within bounds; anything else is refused."""
    if not thresholds or sorted(set(thresholds)) != list(thresholds) or not least <= thresholds[0] <= thresholds[-1] <= most:
        raise Refused(f"thresholds must ascend from {least} to {most}: {thresholds}")
    return list(thresholds)


def evaluate(predictions: DataFrame, references: DataFrame, n_images: int, shown: int, overlap: float = 0.5) -> dict[str, DataFrame]:
    """matches, counts, totals, coverage and average precision at a display threshold, which the scores shown reach."""
    visible = predictions.where(F.col("score") >= shown)
    m = staged(matching.match_boxes(visible, references, overlap), "matches")
    counts = staged(confusion.image_counts(m, references), "counts")
    return {
        "matches": m,
        "counts": counts,
        "totals": confusion.totals(counts, n_images, "class"),
        "coverage": coverage.coverage_totals(coverage.zone_coverage(references, visible), n_images),
        "precision": precision.average_precision(predictions, references),
    }


def study(predictions: DataFrame, references: DataFrame, thresholds: list[int], baseline: int) -> dict[str, DataFrame]:
    """A sweep from one matching, its best thresholds, and what each best one changes against the baseline."""
    m = staged(matching.match_boxes(predictions, references), "matches")
    swept = staged(confusion.sweep(m, references, checked_grid(thresholds)), "sweep")
    return {"sweep": swept, "best": confusion.best_thresholds(swept), "missed": confusion.missed_references(references, m.where(F.col("score") >= baseline))}


def comparable(one: dict, two: dict) -> None:
    """Refuse a comparison of evaluations whose protocol, classes or references differ."""
    if differ := [k for k in ("protocol", "classes", "references_sha256", "images_sha256") if one.get(k) != two.get(k)]:
        raise Refused(f"evaluations differ in {differ}")


def described(protocol: str, classes: list[str], references: DataFrame, images: DataFrame) -> dict:
    """An evaluation's descriptor with the digests of its tables, for ``comparable``."""
    return {"protocol": protocol, "classes": list(classes), "references_sha256": table_digest(references), "images_sha256": table_digest(images)}
