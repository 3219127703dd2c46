"""Manifests and their rules, as tables of what breaks them (SRC-08, SRC-14, SRC-19, SRC-20, AG-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.geometry import sound
from girder.functions.rules import is_finite, is_hex, is_text

#: Fixed values. The folder's spelling is the source's own.
SAMPLE = r"^(easy|medium|hard)_([0-9]{4})$"
SOURCE_FOLDER = "Damage Segmentaion"
MOST_RECORDS = 5000
COLLECTION_ID = r"^[a-z0-9_]{1,80}$"
COLLECTION_SPLITS = ("train", "val", "unassigned")
COLLECTION_DECISIONS = ("review", "quarantine")
IMAGE_POLICIES = ("single_frame", "mpo_primary_of_two")
PROBE_ID = r"^[A-Za-z0-9_-]{1,80}$"
MOST_BOXES = 200


def first_problem(table: DataFrame, rules: list[tuple[str, Column]], key: str = "id") -> DataFrame:
    """key, problem: the first rule in order whose condition a row meets, or whose condition is unknown."""
    found = F
    for name, broken in rules:
        found = found.when(F.coalesce(broken, F.lit(True)), name)
    return table.select(key, found.alias("problem")).where("problem is not null")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def uses(table: DataFrame, key: str) -> DataFrame:
    """Add how often each key stands, joined from its counts, so that a key that stands very often is no task's work."""
    counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return table.join(counts, table[key].eqNullSafe(counts[key])).drop(counts[key])


def sample_identity(sample: Column) -> dict[str, Column]:
    """What an import's manifest must say of a sample, derived anew from its id."""
    level, number = F.regexp_extract(sample, SAMPLE, 1), F.regexp_extract(sample, SAMPLE, 2)
    title = F.initcap(level)
    file = F.concat(F.substring(title, 1, 1), F.lit(" ("), number.try_cast("int").cast("string"), F.lit(").jpg"))
    return {
        "image": F.concat(F.lit("images/"), sample, F.lit(".jpg")),
        "mask": F.concat(F.lit("masks/"), sample, F.lit(".png")),
        "difficulty": title,
        "source_path": F.concat_ws("/", F.lit(SOURCE_FOLDER), title, F.lit("Images"), file),
    }


def sample_violations(records: DataFrame) -> DataFrame:
    """id, problem of an import's records (id, image, mask, difficulty, source_path, scene_group, split) that are not what their ids say (SRC-08)."""
    wrong = F.lit(False)
    for name, value in sample_identity(F.col("id")).items():
        wrong = wrong | differs(F.col(name), value)
    return first_problem(uses(records, "id"), [
        ("bad_id", ~F.col("id").rlike(SAMPLE)), ("repeated_id", F.col("uses") > 1), ("identity_differs", wrong),
        ("already_grouped_or_split", F.col("scene_group").isNotNull() | F.col("split").isNotNull()),
    ])


def public_link(url: Column) -> Column:
    """Whether a link is an HTTPS one with a host and without a name or password in it."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    return F.coalesce(is_text(url, 2000) & (F.lower(part("PROTOCOL")) == "https") & (F.length(part("HOST")) > 0) & part("USERINFO").isNull(), F.lit(False))


def collection_violations(records: DataFrame, sources: DataFrame) -> DataFrame:
    """id, problem of a collection's records (SRC-14).

    records: id, source_id, source_split, image_policy (null for a single frame), credit struct<title, author, license, source_url,
    license_url>, decision, note, asset struct<url, size, sha256>; sources: source_id.
    """
    known = sources.select("source_id", F.lit(True).alias("known")).distinct()
    t = uses(records, "id").join(known, "source_id", "left")
    credit = lambda name: F.col(f"credit.{name}")
    return first_problem(t, [
        ("bad_id", ~F.col("id").rlike(COLLECTION_ID)), ("repeated_id", F.col("uses") > 1), ("unknown_source", F.col("known").isNull()),
        ("reserved_split", ~F.col("source_split").isin(*COLLECTION_SPLITS)),
        ("bad_asset", ~(public_link(F.col("asset.url")) & (F.col("asset.size") > 0) & is_hex(F.col("asset.sha256"), 64))),
        ("unknown_policy", ~F.coalesce("image_policy", F.lit(IMAGE_POLICIES[0])).isin(*IMAGE_POLICIES)),
        ("no_attribution", ~(is_text(credit("title"), 2000) & is_text(credit("author"), 2000) & is_text(credit("license"), 2000))),
        ("bad_link", ~(public_link(credit("source_url")) & public_link(credit("license_url")))),
        ("decided_too_early", ~F.col("decision").isin(*COLLECTION_DECISIONS)), ("no_note", ~is_text(F.col("note"), 4000)),
    ])


def probe_violations(records: DataFrame) -> DataFrame:
    """id, problem of a probe's sample (SRC-20).

    records: id, file, sha256 and width, height as listed, real_sha256, real_width, real_height as read, reference_boxes array<struct<x1,
    y1, x2, y2>>, review_note. Ids and contents stand once each.
    """
    contents = records.groupBy("sha256").agg(F.count(F.lit(1)).alias("same"))
    t = uses(records, "id").join(contents, "sha256", "left")
    boxes = F.col("reference_boxes")
    return first_problem(t, [
        ("bad_id", ~F.col("id").rlike(PROBE_ID)), ("no_file", ~is_text(F.col("file"), 500)), ("content_differs", differs(F.col("sha256"), F.col("real_sha256"))),
        ("size_differs", differs(F.col("width"), F.col("real_width")) | differs(F.col("height"), F.col("real_height"))),
        ("too_many_boxes", F.size(boxes) > MOST_BOXES), ("bad_box", F.exists(boxes, lambda b: ~sound(b, F.col("width"), F.col("height")))),
        ("no_note", ~is_text(F.col("review_note"), 4000)), ("repeated_id", F.col("uses") > 1), ("repeated_content", F.col("same") > 1),
    ])


def protocol_problem(revision: Column, prompt: Column, thresholds: list[Column], max_images: Column) -> Column:
    """What is wrong with a probe's protocol, null if nothing is: pinned revision, short prompt with a period, thresholds in (0, 1), 1 to 64 images."""
    between = F.lit(True)
    for t in thresholds:
        between = between & is_finite(t) & F.coalesce((t > 0) & (t < 1), F.lit(False))
    return (
        F.when(~is_hex(revision, 40), "bad_revision").when(~(is_text(prompt, 200) & prompt.endswith(".")), "bad_prompt")
        .when(~between, "bad_threshold").when(~F.coalesce(max_images.between(1, 64), F.lit(False)), "bad_bound")
    )


def external_violations(records: DataFrame, masks: DataFrame) -> DataFrame:
    """id, problem of an external corpus: each record's mask must be black and white and have the recorded foreground (SRC-19).

    records: id, split, width, height, foreground_pixels; masks: id, width, height, foreground, other (pixels that are neither).
    """
    m = masks.select("id", F.col("width").alias("mask_width"), F.col("height").alias("mask_height"), "foreground", "other")
    t = uses(records, "id").join(m, "id", "left")
    return first_problem(t, [
        ("repeated_id", F.col("uses") > 1), ("no_mask", F.col("foreground").isNull()), ("size_differs", differs(F.col("width"), F.col("mask_width")) | differs(F.col("height"), F.col("mask_height"))),
        ("not_binary", F.col("other") > 0), ("foreground_differs", F.col("foreground") != F.col("foreground_pixels")),
    ])


def external_counts(records: DataFrame) -> DataFrame:
    """split, photos, groups, foreground_pixels of an external corpus (AG-23)."""
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("photos"), F.count_distinct("content_group").alias("groups"), F.sum("foreground_pixels").alias("foreground_pixels"))
