"""The tables behind reports: duplicates, leaks, summaries, flags, attribution and run integrity (AG-11, AG-15, AG-17, PRJ-25, SNK-04, SNK-07, SRC-22, EV-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.rules import set_difference

#: Fixed values of the corpus review.
IOU_REVIEW, OVERLAP_REVIEW = 0.85, 0.9


def duplicate_groups(records: DataFrame, digest: str = "digest") -> DataFrame:
    """digest, n and ids (ascending) of contents that several records share."""
    shared = records.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return records.join(shared, digest).groupBy(digest, "n").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def disagreement_totals(evidence: DataFrame) -> DataFrame:
    """images, differing_images, differing_pixels of masks held against what their polygons draw (evidence: id, differing)."""
    return evidence.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("differing") > 0).alias("differing_images"), F.coalesce(F.sum("differing"), F.lit(0)).alias("differing_pixels"))


def leaking_groups(records: DataFrame, one: str = "train", other: str = "val") -> DataFrame:
    """content_group, n of groups whose source splits include both, and the ids of their members (AG-15)."""
    both = records.groupBy("content_group").agg(F.count_if(F.col("source_split") == one).alias("a"), F.count_if(F.col("source_split") == other).alias("b")).where("a > 0 and b > 0")
    return records.join(both.select("content_group"), "content_group").groupBy("content_group").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def collection_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """images, with_source_boxes, to_annotate, quarantined, turned, groups, and approved_for_training, which a collection never is.

    records: id, n_boxes, decision, exif_orientation, content_group.
    """
    sums = [
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("n_boxes") > 0).alias("with_source_boxes"), F.count_if(F.coalesce("n_boxes", F.lit(0)) == 0).alias("to_annotate"),
        F.count_if(F.col("decision") == "quarantine").alias("quarantined"), F.count_if(F.col("exif_orientation") != 1).alias("turned"), F.count_distinct("content_group").alias("groups"), F.lit(0).cast("long").alias("approved_for_training"),
    ]
    return records.groupBy(*by).agg(*sums) if by else records.agg(*sums)


def review_outcomes(audit: DataFrame, reviewed: DataFrame) -> DataFrame:
    """outcome, n over all source boxes, and new for reviewed boxes that refer to none (AG-17)."""
    new = reviewed.where(F.size("source_indices") == 0).agg(F.count(F.lit(1)).alias("n")).select(F.lit("new").alias("outcome"), "n")
    return audit.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(new)


def partition_summary(photos: DataFrame, boxes: DataFrame, classes: list[str]) -> DataFrame:
    """split, images, groups, negative_crops, negative_photos, and boxes and groups of each class (AG-17).

    photos: id, split, content_group, is_crop, decision; boxes: id, class. A class that a split lacks has zeros there.
    """
    each = boxes.groupBy("id").agg(*[F.count_if(F.col("class") == c).alias(f"boxes_{c}") for c in classes])
    t = photos.join(each, "id", "left").na.fill(0, [f"boxes_{c}" for c in classes])
    sums = [F.sum(f"boxes_{c}").alias(f"boxes_{c}") for c in classes] + [F.count_distinct(F.when(F.col(f"boxes_{c}") > 0, F.col("content_group"))).alias(f"groups_{c}") for c in classes]
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("content_group").alias("groups"), F.count_if("is_crop").alias("negative_crops"), F.count_if(F.col("decision") == "negative").alias("negative_photos"), *sums)


def review_flags(n_annotations: Column, class_ious: Column, away_from_border: Column, overlap: Column) -> Column:
    """What a person should look at in an imported sample: its annotations, masks against polygons (an array of IoUs, nulls for absent classes), and classes that cover each other."""
    return F.array_compact(F.array(
        F.when(n_annotations == 0, "empty_annotations"),
        F.when(F.exists(class_ious, lambda x: F.coalesce(x < IOU_REVIEW, F.lit(False))), "mask_iou_below_review_threshold"),
        F.when(away_from_border > 0, "mask_difference_away_from_boundary"),
        F.when(overlap >= OVERLAP_REVIEW, "source_classes_almost_fully_overlap"),
    ))


def photo_cards(photos: DataFrame, boxes: DataFrame, notes: DataFrame) -> DataFrame:
    """One row a photo, with what a page would show of it: its boxes in order, its notes, and how many there are (SNK-07).

    photos: id, ...; boxes: id, class, box; notes: id, note.
    """
    b = boxes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("class", "box"))).alias("boxes"))
    n = notes.groupBy("id").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    t = photos.join(b, "id", "left").join(n, "id", "left")
    empty = F.array().cast(b.schema["boxes"].dataType)
    return t.withColumns({"boxes": F.coalesce("boxes", empty), "notes": F.coalesce("notes", F.array().cast("array<string>"))}).withColumns({"n_boxes": F.size("boxes"), "n_notes": F.size("notes")})


def attribution(photos: DataFrame) -> DataFrame:
    """id, line: the credit of each photo (id, credit struct<title, author, license, source_url, license_url>) as a line of text, for a file beside the corpus."""
    c = lambda name: F.col(f"credit.{name}")
    return photos.select("id", F.concat(F.col("id"), F.lit(": "), c("title"), F.lit(" — "), c("author"), F.lit(" — "), c("license"), F.lit(" <"), c("license_url"), F.lit("> <"), c("source_url"), F.lit(">")).alias("line"))


def run_problems(runs: DataFrame, files: DataFrame) -> DataFrame:
    """run, problem of training runs (run, status, model, expected_model, classes, expected_classes, files array<struct<path, sha256>>) that may not be used (SRC-22).

    files: path, sha256 as they are now. A run must be completed, of the model and classes asked for, and every file that it recorded unchanged.
    """
    listed = runs.select("run", F.explode("files").alias("f")).select("run", F.col("f.path").alias("path"), F.col("f.sha256").alias("recorded"))
    bad = listed.join(files.select("path", "sha256"), "path", "left").where(~F.col("recorded").eqNullSafe(F.col("sha256"))).groupBy("run").agg(F.max(F.col("sha256").isNull()).alias("missing"))
    t = runs.join(bad, "run", "left")
    problem = (
        F.when(~F.col("status").eqNullSafe(F.lit("completed")), "not_completed").when(~F.col("model").eqNullSafe(F.col("expected_model")), "other_model").when(~F.col("classes").eqNullSafe(F.col("expected_classes")), "other_classes")
        .when(F.size("files") < 1, "no_checkpoint").when(F.col("missing"), "file_missing").when(F.col("missing").isNotNull(), "file_changed")
    )
    return t.select("run", problem.alias("problem")).where("problem is not null")


def rebuilt_differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows in which a stored table differs from the one derived anew, with the side that has them (EV-07)."""
    return set_difference(stored.select(*sorted(stored.columns)), rebuilt.select(*sorted(rebuilt.columns)))
