"""From detections to findings, nothing dropped without its reason (WN-06, PRJ-15, PRJ-25, PRJ-29, ENG-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.categories import family, is_class, label
from girder.functions.geometry import lost_share, sound
from girder.functions.rules import analysis_outcome, is_finite, is_hex, is_text, refuse

#: Fixed limit of a photo.
MOST_PIXELS = 16_000_000


def findings_and_withheld(detections: DataFrame, enabled: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Findings (analysis, slot, idx, class, score, box) and withheld detections (analysis, idx, reason).

    detections: (analysis, idx, class, score, box, lost_regions). Reasons are asked in turn: class_not_enabled,
    below_or_equal_threshold, unreadable_region; of what is left, equal class and box are one finding, of the highest
    score and there the earliest, in the place of the earliest; the others are withheld as duplicate_geometry.
    """
    share = lost_share(F.col("box"), F.col("lost_regions"))
    first = F.when(~F.col("class").isin(*enabled), "class_not_enabled").when(F.col("score") <= threshold, "below_or_equal_threshold").when(share >= 1, "unreadable_region")
    t = detections.withColumn("reason", first)
    same = Window.partitionBy("analysis", "class", "box", F.col("reason").isNull())
    t = t.withColumns({"nth": F.row_number().over(same.orderBy(F.desc("score"), "idx")), "slot": F.min("idx").over(same)})
    findings = t.where("reason is null and nth = 1").select("analysis", "slot", "idx", "class", "score", "box")
    reason = F.coalesce("reason", F.when(F.col("nth") > 1, "duplicate_geometry"))
    return findings, t.withColumn("reason", reason).where("reason is not null").select("analysis", "idx", "reason")


def finding_record(findings: DataFrame) -> DataFrame:
    """Findings as records: a score is neither a severity nor a probability, and what was not assessed is null."""
    return findings.select(
        "analysis", "idx", F.lit("model").alias("origin"), F.lit("proposed").alias("state"), "class", "box",
        F.struct(F.col("score").alias("model_score"), F.lit(True).alias("is_not_a_severity"), F.lit(False).alias("is_calibrated_probability")).alias("confidence"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("measurement"), F.lit("not_assessed").alias("conformity"),
    )


def detection_problem(name: Column, score: Column, corners: Column, width: Column, height: Column) -> Column:
    """What keeps a detection from becoming a finding, null if nothing: a known class, a score from 0 to 1, a photo within the limits and a box inside it (PRJ-29)."""
    return (
        F.when(~is_class(name), "unknown_class").when(~F.coalesce(is_finite(score) & score.between(0, 1), F.lit(False)), "score_outside")
        .when(~F.coalesce((width >= 1) & (height >= 1) & (width.cast("long") * height <= MOST_PIXELS), F.lit(False)), "bad_photo_size").when(~sound(corners, width, height), "bad_box")
    )


def origin_problem(site: Column, zone: Column, task: Column, run: Column, checkpoint: Column, threshold: Column) -> Column:
    """What is wrong with the context and model that findings carry, null if nothing: a site, and a run with its checkpoint's digest and a threshold between 0 and 1 (PRJ-29)."""
    optional = lambda c: c.isNull() | is_text(c)
    return (
        F.when(~is_text(site), "no_site").when(~(optional(zone) & optional(task)), "bad_context").when(~is_text(run) | ~is_hex(checkpoint, 64), "bad_model")
        .when(~F.coalesce(is_finite(threshold) & (threshold > 0) & (threshold < 1), F.lit(False)), "bad_threshold")
    )


def built_findings(detections: DataFrame, analyses: DataFrame, enabled: list[str]) -> tuple[DataFrame, DataFrame]:
    """From photo to dossier (ENG-06): findings with identity, family, label and place, and (analysis, outcome, n_findings) of every analysis.

    detections: as of ``findings_and_withheld``; analyses: analysis, photo_sha256, width, height, verdict, site, run, checkpoint, threshold (one for
    all). A local name is the digest of photo, class and whole pixels; an identity adds site and model. Detections against the rules are refused.
    """
    threshold = analyses.agg(F.max("threshold")).first()[0]
    all_of = detections.join(analyses.select("analysis", "width", "height"), "analysis")
    refuse(all_of.withColumn("problem", detection_problem(F.col("class"), F.col("score"), F.col("box"), F.col("width"), F.col("height"))).where("problem is not null").select("analysis", "idx", "problem"), "a detection breaks the rules")
    t = findings_and_withheld(detections, enabled, threshold)[0].join(analyses, "analysis")
    corners = [F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")]
    name = F.sha2(F.to_json(F.struct("photo_sha256", "class", F.array(*[F.rint(c).cast("long") for c in corners]).alias("pixels"))), 256)
    identity = F.substring(F.sha2(F.to_json(F.struct(name.alias("local"), "site", "run", "checkpoint", "threshold")), 256), 1, 32)
    size = ["width", "height", "width", "height"]
    made = t.select("analysis", identity.alias("finding"), "class", family(F.col("class")).alias("family"), label(F.col("class")).alias("label"), "score", "box", F.array(*[c / F.col(n) for c, n in zip(corners, size, strict=True)]).alias("box_normalized"), "photo_sha256")
    counts = made.groupBy("analysis").agg(F.count(F.lit(1)).alias("n_findings"))
    outcomes = analyses.join(counts, "analysis", "left").na.fill(0, ["n_findings"])
    return made, outcomes.select("analysis", analysis_outcome(F.col("verdict"), F.col("n_findings")).alias("outcome"), "n_findings")
