"""An external source of photos and semantic masks, prepared for evaluation only (SNK-04, SRC-18, SRC-19, PRJ-19, JN-15, GR-05, AG-23).

Photos and masks are turned as their bytes say, masks cut at one level with two others to show how much depends on it, photos that look alike are looked at in
full size, and a group with a pair that a person must see is withheld whole. No instance is made out of a mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions import images as im
from girder.functions import masks
from girder.functions.rules import refuse
from girder.operators import groups
from girder.plans import photos as ph
from girder.shared import staged
from girder.sources.manifests import external_counts

#: Fixed level of a mask's foreground.
LEVEL = 128
SIDES = ("image", "mask")
METRICS = {"problem": pa.string(), "orientation": pa.int32(), "mask_orientation": pa.int32(), "width": pa.int32(), "height": pa.int32(), "foreground_pixels": pa.int64(), "foreground_at_low": pa.int64(), "foreground_at_high": pa.int64(), "band_pixels": pa.int64(), "band_share": pa.float64(), "runs": pa.list_(pa.int64())}
METRICS_DDL = "problem string, orientation int, mask_orientation int, width int, height int, foreground_pixels long, foreground_at_low long, foreground_at_high long, band_pixels long, band_share double, runs array<long>"
REASONS = {"quarantine": "a pair of this group needs review", "candidate": "the smallest id stands for its group", "variant": "a similar view, no case of its own"}


def with_files(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """The inventory (id, image, mask, image_sha256, mask_sha256, ..) with head and pixels of both of its files (id, sha256, head, pixels), which must be those it pins."""
    t = inventory
    for side in SIDES:
        own = files.select(F.col("id").alias(side), F.col("sha256").alias(f"{side}_real"), F.col("head").alias(f"{side}_head"), F.col("pixels").alias(f"{side}_pixels"))
        t = t.join(own, side, "left")
    t = staged(t, "inventory")
    refuse(t.where(~F.coalesce((F.col("image_real") == F.col("image_sha256")) & (F.col("mask_real") == F.col("mask_sha256")), F.lit(False))).select("id"), "files are missing or not what the inventory pins")
    return t


def turned(head: bytes, pixels: dict | None) -> tuple[np.ndarray | None, int, str | None]:
    """A photo as EXIF turns it, its orientation and what is wrong with it."""
    h = im.photo_header(head or b"")
    problem = im.header_problem(h) or (None if pixels is not None and (pixels["width"], pixels["height"]) == (h.width, h.height) else "not_decoded")
    return (None if problem else im.oriented(ph.rgb(pixels), h.orientation)), h.orientation, problem


def normalised(table: DataFrame) -> DataFrame:
    """id and METRICS of an inventory with files, in one Arrow stage; a mask without or full of foreground is a problem."""

    def one(image_head: bytes, image: dict | None, mask_head: bytes, mask: dict | None) -> dict:
        photo, turn, wrong = turned(image_head, image)
        label, mask_turn, mask_wrong = turned(mask_head, mask)
        if wrong or mask_wrong:
            return {"problem": wrong or f"mask_{mask_wrong}"}
        if photo.shape != label.shape:
            return {"problem": "sizes_differ"}
        gray = im.gray(label)
        n = masks.binarised(gray, LEVEL)
        if n["foreground"] in (0, gray.size):
            return {"problem": "mask_empty_or_full"}
        band = n["foreground_low"] - n["foreground_high"]
        return {"orientation": turn, "mask_orientation": mask_turn, "width": photo.shape[1], "height": photo.shape[0], "foreground_pixels": n["foreground"], "foreground_at_low": n["foreground_low"], "foreground_at_high": n["foreground_high"], "band_pixels": band, "band_share": band / n["foreground"], "runs": masks.encode(gray >= LEVEL)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*[v.as_py() for v in values]) for values in zip(*batch.columns[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(c) for r in rows], t) for c, t in METRICS.items()]], ["id", *METRICS])

    return table.select("id", "image_head", "image_pixels", "mask_head", "mask_pixels").mapInArrow(run, f"id string, {METRICS_DDL}")


def measured_pairs(pairs: DataFrame, table: DataFrame, most_error: float, least_iou: float) -> DataFrame:
    """left, right, view, native_error, iou, review_required of similar pairs in full size and colour; only photos of pairs are shuffled."""
    for end in ("left", "right"):
        pairs = pairs.join(table.select(F.col("id").alias(end), F.struct("image_head", "image_pixels", "mask_head", "mask_pixels").alias(f"{end}_files")), end)

    def photo_and_mask(files: dict) -> tuple[np.ndarray, np.ndarray]:
        photo, label = turned(files["image_head"], files["image_pixels"])[0], turned(files["mask_head"], files["mask_pixels"])[0]
        return photo, im.gray(label) >= LEVEL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                left, right = (photo_and_mask(batch.column(c)[k].as_py()) for c in (3, 4))
                found.append(im.pair_measures(left[0], right[0], batch.column(2)[k].as_py(), left[1], right[1], most_error, least_iou))
            values = [pa.array([m[c] for m in found], t) for c, t in (("error", pa.float64()), ("iou", pa.float64()), ("review_required", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *values], ["left", "right", "view", "native_error", "iou", "review_required"])

    return pairs.select("left", "right", "view", "left_files", "right_files").mapInArrow(run, "left string, right string, view int, native_error double, iou double, review_required boolean")


def prepared_external(inventory: DataFrame, files: DataFrame, distance: int = 8, error: float = 20.0, most_error: float = 2.0, least_iou: float = 0.98) -> dict[str, DataFrame]:
    """records, pairs and counts of an external source.

    inventory: id, image, mask (files' names), image_sha256, mask_sha256, exif_orientation, mask_exif_orientation as inspected before; files: of ``read_photos``.
    Refused are files that changed, photos that may not be decoded, masks of another size, without or full of foreground, and orientations that are not as inspected.
    """
    table = with_files(inventory, files)
    made = staged(normalised(table), "normalised")
    refuse(made.where("problem is not null").select("id", "problem"), "samples that cannot be prepared")
    both = made.join(inventory.select("id", "exif_orientation", "mask_exif_orientation"), "id")
    refuse(both.where(~(F.col("orientation").eqNullSafe(F.col("exif_orientation")) & F.col("mask_orientation").eqNullSafe(F.col("mask_exif_orientation")))).select("id"), "orientations are not as inspected")
    hashes = ph.measured(table.select("id", F.col("image_head").alias("head"), F.col("image_pixels").alias("pixels")))
    alike = staged(ph.similar_photos(staged(hashes, "hashes"), distance, error), "alike")
    pairs = staged(measured_pairs(alike, table, most_error, least_iou), "pairs")
    links = pairs.select(F.col("left").alias("a"), F.col("right").alias("b"), "review_required")
    grouped = staged(groups.content_groups(made.select("id"), links.select("a", "b")), "groups")
    roles = groups.external_roles(grouped, links).withColumnRenamed("role", "split")
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    records = made.drop("problem").join(inventory.select("id", "image", "mask", "image_sha256", "mask_sha256"), "id").join(grouped, "id").join(roles.select("id", "split"), "id")
    records = staged(records.withColumns({"reason": F.element_at(reason, F.col("split")), "scene_group": F.lit(None).cast("string")}), "records")
    return {"records": records, "pairs": pairs.join(alike.select("left", "right", "distance", "error"), ["left", "right"]), "counts": external_counts(records)}
