"""Counts of hits and errors, by image, class and threshold (AG-01 to 04, AG-08 to 10, JN-10, JN-13, AG-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.ratios import f1, precision, ratio, recall

REASONS = ("duplicate", "insufficient_overlap", "no_overlap")


def image_counts(matches: DataFrame, references: DataFrame) -> DataFrame:
    """image, class, tp, fp, fn and a count for each error reason, for every pair that has a prediction or reference."""
    found = matches.groupBy("image", "class").agg(
        F.count_if(F.col("reason") == "matched").alias("tp"), F.count_if(F.col("reason") != "matched").alias("fp"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    )
    had = references.groupBy("image", "class").agg(F.count(F.lit(1)).alias("refs"))
    both = found.join(had, ["image", "class"], "full_outer").na.fill(0)
    return both.select("image", "class", "tp", "fp", (F.col("refs") - F.col("tp")).alias("fn"), *REASONS)


def totals(counts: DataFrame, n_images: int | Column, *by: str) -> DataFrame:
    """Sums over images with precision, recall and false proposals per image; all images count, also those without rows."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", *REASONS)])
    n = n_images if isinstance(n_images, Column) else F.lit(n_images)
    return with_ratios(sums).withColumns({"reference_instances": F.col("tp") + F.col("fn"), "false_proposals_per_image": ratio(F.col("fp"), n)})


def with_ratios(t: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def sweep(matches: DataFrame, references: DataFrame, thresholds: list[int]) -> DataFrame:
    """class, threshold, tp, fp, fn, ratios and images_with_false_proposals, from one matching.

    Matching goes by falling score, so what it found above a threshold is what a matching above the threshold finds. The grid is a literal array: a row is
    added to the thresholds at or under its score and aggregated before any shuffle.
    """
    grid = F.array(*[F.lit(t).cast("long") for t in sorted(thresholds)])
    under = lambda score: F.explode(F.filter(grid, lambda t: t <= F.col(score))).alias("threshold")
    hit = F.col("reason") == "matched"
    counts = matches.select("class", "reason", under("score")).groupBy("class", "threshold").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    # An image has false proposals up to the score of its highest one, so it is one row and not one a threshold.
    worst = matches.where(~hit).groupBy("class", "image").agg(F.max("score").alias("score"))
    images = worst.select("class", under("score")).groupBy("class", "threshold").agg(F.count(F.lit(1)).alias("images_with_false_proposals"))
    found = counts.join(images, ["class", "threshold"], "left")
    had = references.groupBy("class").agg(F.count(F.lit(1)).alias("refs")).withColumn("threshold", F.explode(grid))
    both = had.join(found, ["class", "threshold"], "full_outer").na.fill(0)
    return with_ratios(both.select("class", "threshold", "tp", "fp", (F.col("refs") - F.col("tp")).alias("fn"), "images_with_false_proposals"))


def target_study(matches: DataFrame, references: DataFrame, thresholds: list[int], target: str, baseline: int, n_images: int) -> DataFrame:
    """What the target class's threshold does, the other classes left alone: a row for each threshold (AG-09).

    threshold, tp, fp, fn, f1, a count for each error reason, images_with_false_proposals, images without a reference of the target and the false
    proposals there, and changed_images, in which some proposal is shown by one of threshold and baseline alone.
    """
    grid = F.array(*[F.lit(t).cast("long") for t in sorted(thresholds)])
    own = matches.where(F.col("class") == target)
    has = references.where(F.col("class") == target).groupBy("image").agg(F.count(F.lit(1)).alias("refs"))
    at = own.select("image", "reason", F.explode(F.filter(grid, lambda t: t <= F.col("score"))).alias("threshold"))
    hit = F.col("reason") == "matched"
    one = at.groupBy("threshold", "image").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    one = one.join(has, "image", "left")
    found = one.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", *REASONS)], F.count_if(F.col("fp") > 0).alias("images_with_false_proposals"), F.sum(F.when(F.col("refs").isNull(), F.col("fp")).otherwise(0)).alias("false_without_target"))
    moved = F.filter(grid, lambda t: (t <= F.col("score")) != (F.lit(baseline) <= F.col("score")))
    changed = own.select("image", F.explode(moved).alias("threshold")).distinct().groupBy("threshold").agg(F.count(F.lit(1)).alias("changed_images"))
    total = has.agg(F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"), (F.lit(n_images) - F.count(F.lit(1))).alias("images_without_target")).withColumn("threshold", F.explode(grid))
    both = total.join(found, "threshold", "left").join(changed, "threshold", "left").na.fill(0)
    return with_ratios(both.withColumn("fn", F.col("refs") - F.col("tp"))).drop("refs", "precision", "recall")


def best_thresholds(swept: DataFrame) -> DataFrame:
    """All thresholds of the largest F1 of each class; undefined ones take no part."""
    nth = F.rank().over(Window.partitionBy("class").orderBy(F.desc("f1")))
    return swept.where("f1 is not null").withColumn("nth", nth).where("nth = 1").drop("nth")


def threshold_changes(matches: DataFrame, baseline: int, other: int) -> DataFrame:
    """Predictions that one threshold shows and the other does not: image, class, pred_pos, reason, change."""
    shown = lambda t: F.col("score") >= t
    change = F.when(shown(other) & ~shown(baseline), "added").when(shown(baseline) & ~shown(other), "removed")
    return matches.select("image", "class", "pred_pos", "reason", change.alias("change")).where("change is not null")


def missed_references(references: DataFrame, matches: DataFrame) -> DataFrame:
    hit = matches.where("ref_pos is not null").select("image", "class", F.col("ref_pos").alias("pos"))
    return references.join(hit, ["image", "class", "pos"], "left_anti").select("image", "class", "pos")


def compare_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """image, class with both sides' counts and their differences; a pair absent on a side has zeros there."""
    keys = ["image", "class"]
    a = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in ("tp", "fp", "fn")])
    b = after.select(*keys, *[F.col(c).alias(f"{c}_after") for c in ("tp", "fp", "fn")])
    both = a.join(b, keys, "full_outer").na.fill(0)
    return both.withColumns({f"{c}_delta": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("tp", "fp", "fn")})
