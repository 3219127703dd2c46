"""Pins, companions and reviews: joins that must come out even (SRC-02, JN-02, 06 to 09, 11, 12, ST-01, AG-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.geometry import meets


def integrity_mismatches(files: DataFrame, pins: DataFrame) -> DataFrame:
    """path, problem of files (path, size, sha256) against pins: missing, unpinned, wrong_size or wrong_digest; empty if all is well."""
    a = files.select("path", F.col("size").alias("size_a"), F.col("sha256").alias("sha_a"))
    b = pins.select("path", F.col("size").alias("size_b"), F.col("sha256").alias("sha_b"))
    problem = (
        F.when(F.col("sha_a").isNull(), "missing")
        .when(F.col("sha_b").isNull(), "unpinned")
        .when(F.col("size_a") != F.col("size_b"), "wrong_size")
        .when(F.col("sha_a") != F.col("sha_b"), "wrong_digest")
    )
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null")


def companions(members: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of members (stem, role, name): stems with one name for every role, and the names that belong to no such stem."""
    counts = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles]
    names = [F.max(F.when(F.col("role") == r, F.col("name"))).alias(r) for r in roles]
    each = members.groupBy("stem").agg(*counts, *names)
    whole = each.where(" and ".join(f"n_{r} = 1" for r in roles)).select("stem", *roles)
    used = whole.select(F.explode(F.array(*roles)).alias("name"))
    return whole, members.join(used, "name", "left_anti")


def with_labels(photos: DataFrame, labels: DataFrame) -> DataFrame:
    """Photos with their labels, an empty list where there are none."""
    empty = F.array().cast(labels.schema["labels"].dataType)
    return photos.join(labels, "id", "left").withColumn("labels", F.coalesce("labels", empty))


def two_way_coverage(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """id, side of ids that only one of the tables has; empty if each review has its source and the other way round."""
    a, b = reviews.select("id", F.lit(1).alias("r")), sources.select("id", F.lit(1).alias("s"))
    both = a.join(b, "id", "full_outer").where("r is null or s is null")
    return both.select("id", F.when(F.col("r").isNull(), "not_reviewed").otherwise("unknown_source").alias("side"))


def review_audit(sources: DataFrame, reviewed: DataFrame, removed: DataFrame) -> DataFrame:
    """id, source_index, outcome, targets for every source box (id, source_index, class, box).

    reviewed: (id, review_index, class, box, source_indices); removed: (id, source_index, reason). A box is kept if one reviewed
    box alone refers to it and equals it, revised if any other do, removed if it is listed so, and
    else, or if it is both, unresolved, which a sound review never has.
    """
    links = reviewed.select("id", "review_index", F.col("class").alias("c"), F.col("box").alias("b"), F.explode("source_indices").alias("source_index"))
    to = links.groupBy("id", "source_index").agg(F.sort_array(F.collect_list("review_index")).alias("targets"), F.first("c").alias("c"), F.first("b").alias("b"))
    gone = removed.select("id", "source_index", F.lit(True).alias("gone"))
    t = sources.join(to, ["id", "source_index"], "left").join(gone, ["id", "source_index"], "left")
    linked = F.col("targets").isNotNull()
    same = (F.size("targets") == 1) & (F.col("class") == F.col("c")) & (F.col("box") == F.col("b"))
    outcome = F.when(F.col("gone") & linked, "unresolved").when(F.col("gone"), "removed").when(linked & same, "kept").when(linked, "revised").otherwise("unresolved")
    return t.select("id", "source_index", outcome.alias("outcome"), F.coalesce("targets", F.array().cast("array<int>")).alias("targets"))


def crop_conflicts(crops: DataFrame, boxes: DataFrame) -> DataFrame:
    """crop_id of crops (crop_id, image, box) whose interior meets a box of their image; such crops are no negatives."""
    b = boxes.select("image", F.col("box").alias("other"))
    return crops.join(b, "image").where(meets(F.col("box"), F.col("other"))).select("crop_id").distinct()


def alert_rates(patches: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per arm, patches, groups and the rate of patches with an alert; and the patches without a count, which is an error and not a zero."""
    t = patches.join(alerts, "patch", "left")
    missing = t.where("alerts is null").select("patch")
    rates = t.groupBy("arm").agg(F.count(F.lit(1)).alias("patches"), F.count_distinct("grp").alias("groups"), F.count_if(F.col("alerts") > 0).alias("with_alert"))
    return rates.withColumn("rate", F.col("with_alert").cast("double") / F.col("patches")), missing
