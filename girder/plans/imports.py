"""A segmentation source from its files to annotation tables, masks held against polygons, and what a person must look at (SRC-05, SRC-09, SRC-18, PRJ-16, PRJ-17, ENG-08).

The import refuses a source that breaks a rule and mends nothing: every photo has its mask, document and label file, nothing else is there, both kinds of labels agree, masks
have known colours. No scene, split or class meaning is made up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import images as im
from girder.functions import masks
from girder.functions.rules import refuse
from girder.operators import reports
from girder.operators.selection import dense_ids, flag_counts
from girder.plans import photos
from girder.shared import staged
from girder.sources.labels import instance_pairs

#: The source's own names, a fixed value as it spells them: folder, difficulty, role, first letter of the difficulty, number, ending.
NAME = r"Damage Segmentaion/(Easy|Medium|Hard)/(Images|Labels/Mask|Labels/Pascal VOC|Labels/Yolo)/([EMH]) \(([1-9][0-9]*)\)(\.jpg|_mask\.png|\.json|\.txt)$"
ROLES = {"Images": ("image", ".jpg"), "Labels/Mask": ("mask", "_mask.png"), "Labels/Pascal VOC": ("document", ".json"), "Labels/Yolo": ("labels", ".txt")}
DOCUMENT = "image struct<file_name:string,width:int,height:int>, annotations array<struct<category_id:int,segmentation:array<array<double>>,bbox:array<double>,iscrowd:int>>"
ANNOTATION = pa.struct([("category_id", pa.int32()), ("source_category_id", pa.int32()), ("segmentation", pa.list_(pa.list_(pa.float64()))), ("bbox", pa.list_(pa.float64())), ("area", pa.float64()), ("runs", pa.list_(pa.int64()))])
EVIDENCE = {"problem": pa.string(), "pixel_sha256": pa.string(), "differing": pa.int64(), "beyond_border": pa.int64(), "ious": pa.list_(pa.float64()), "shared": pa.int64(), "share": pa.float64(), "annotations": pa.list_(ANNOTATION)}
ABSENT = "samples without all of their files"
EVIDENCE_DDL = (
    "problem string, pixel_sha256 string, differing long, beyond_border long, ious array<double>, shared long, share double, "
    "annotations array<struct<category_id:int,source_category_id:int,segmentation:array<array<double>>,bbox:array<double>,area:double,runs:array<long>>>"
)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """name, _at, content, sha256, id, difficulty, stem, role of a source's files; role is null for a file of no sample."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda k: F.regexp_extract("path", NAME, k)
    ending, role = F.lit(False), None
    for folder, (short, tail) in ROLES.items():
        fits = (part(2) == folder) & (part(5) == tail)
        role = F.when(fits, short) if role is None else role.when(fits, short)
        ending = ending | fits
    known = F.when(ending & (part(3) == F.substring(part(1), 1, 1)), role)
    number = F.lpad(part(4), 4, "0")
    return files.select("path", photos.one_path(F.col("path")).alias("_at"), "content", F.sha2("content", 256).alias("sha256"), F.concat(F.lower(part(1)), F.lit("_"), F.when(F.length(part(4)) > 4, part(4)).otherwise(number)).alias("id"), part(1).alias("difficulty"), F.concat(part(3), F.lit(" ("), part(4), F.lit(")")).alias("stem"), known.alias("role"))


def samples(spark: SparkSession, root: str) -> DataFrame:
    """id, difficulty, stem, digests, document, label text, head of the photo, pixels of photo and mask, one row a sample. Stored."""
    files = source_files(spark, root)
    names = files.select("path", "id", "role")
    refuse(names.where("role is null").select("path"), "files that belong to no sample")
    each = names.groupBy("id").agg(*[F.count_if(F.col("role") == r).alias(r) for r, _ in ROLES.values()])
    # Spark's file sources don't list a file without bytes, which a label file without lines is; whether it may be absent its document says.
    refuse(each.where("image <> 1 or mask <> 1 or document <> 1 or labels > 1"), ABSENT)
    pixels = photos.decoded_pixels(spark, root, recursive=True)
    of = lambda r: files.where(F.col("role") == r)
    photo = of("image").join(pixels, "_at", "left").select("id", "difficulty", "stem", F.col("path").alias("source_path"), F.col("sha256").alias("image_sha256"), F.substring("content", 1, photos.HEAD).alias("head"), "pixels")
    mask = of("mask").join(pixels, "_at", "left").select("id", F.col("sha256").alias("mask_sha256"), F.substring("content", 1, photos.HEAD).alias("mask_head"), F.col("pixels").alias("mask_pixels"))
    text = lambda r, name: of(r).select("id", F.col("sha256").alias(f"{name}_sha256"), F.decode("content", "UTF-8").alias(r))
    return staged(photo.join(mask, "id").join(text("document", "annotations"), "id").join(text("labels", "yolo"), "id", "left"), "samples")


def inspected(table: DataFrame) -> DataFrame:
    """id and EVIDENCE of samples: their polygons drawn and held against the mask, in one Arrow stage; a worker holds one sample's arrays."""

    def one(head: bytes, pixels: dict | None, mask_head: bytes, mask_pixels: dict | None, document: str) -> dict:
        for content, decoded in ((head, pixels), (mask_head, mask_pixels)):
            if problem := im.header_problem(im.photo_header(content), source=True) or (None if decoded is not None else "not_decoded"):
                return {"problem": problem}
        photo, source = photos.rgb(pixels), photos.rgb(mask_pixels)
        height, width = photo.shape[:2]
        instances = json.loads(document)["annotations"]
        drawn: list[np.ndarray | None] = [None] * len(masks.MASK_COLOURS)
        labels = np.zeros((height, width), np.int64)
        annotations = []
        for a in instances:
            shape = masks.rasterised(a["segmentation"], height, width)
            if not shape.any():
                return {"problem": "polygon_draws_nothing"}
            k = a["category_id"]
            drawn[k] = shape if drawn[k] is None else drawn[k] | shape
            labels[shape] = k + 1  # later ones lie on top
            runs = masks.encode(shape)
            annotations.append({"category_id": k + 1, "source_category_id": k, "segmentation": a["segmentation"], "bbox": [float(v) for v in masks.bounds(runs, height)], "area": float(shape.sum()), "runs": runs})
        try:
            agreed = masks.palette_agreement(source, [labels == k + 1 if drawn[k] is not None and (labels == k + 1).any() else None for k in range(len(drawn))])
        except ValueError as e:
            return {"problem": str(e)}
        classes = [np.all(source == c, axis=2) for c in np.array(masks.MASK_COLOURS, np.uint8)]
        away = sum(masks.compared(c, labels == k + 1)["beyond_border"] for k, c in enumerate(classes))
        none = np.zeros((height, width), bool)
        shared, share = masks.class_overlap([none if d is None else d for d in drawn])
        return {"pixel_sha256": hashlib.sha256(np.ascontiguousarray(photo).tobytes()).hexdigest(), "differing": agreed["differing"], "beyond_border": away, "ious": [agreed["iou"][k] for k in sorted(agreed["iou"])], "shared": shared, "share": share, "annotations": annotations}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                rows = [one(*[v.as_py() for v in values]) for values in zip(*part.columns[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r.get(c) for r in rows], t) for c, t in EVIDENCE.items()]], ["id", *EVIDENCE])

    return table.select("id", "head", "pixels", "mask_head", "mask_pixels", "document").mapInArrow(run, f"id string, {EVIDENCE_DDL}")


def imported(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """images, annotations, records, summary, classes, empty, duplicates of a source under a folder, or a refusal that names what is wrong."""
    table = samples(spark, root)
    parsed = table.select("id", "stem", "labels", F.from_json("document", DOCUMENT).alias("d"))
    side = lambda n: F.col("d.image")[n].eqNullSafe(F.lit(im.SOURCE_SIZE[n == "height"]))
    named = F.col("d.image.file_name").eqNullSafe(F.concat("stem", F.lit(".jpg"))) & side("width") & side("height") & F.col("d.annotations").isNotNull()
    refuse(parsed.where(~named).select("id"), "a document is not its photo's")
    refuse(parsed.where(F.col("labels").isNull() & (F.size("d.annotations") > 0)).select("id"), ABSENT)
    sound = F.forall("d.annotations", lambda a: a["category_id"].isin(*range(len(masks.MASK_COLOURS))) & (F.coalesce(a["iscrowd"], F.lit(0)) == 0) & (F.size(a["segmentation"]) >= 1))
    refuse(parsed.where(~F.coalesce(sound, F.lit(False))).select("id"), "an annotation has an unknown class, is a crowd or has no polygon")
    pairs = instance_pairs(parsed.select("id", "d.image.width", "d.image.height", "d.annotations"), parsed.select("id", F.coalesce("labels", F.lit("")).alias("text")))
    refuse(pairs.where("verdict <> 'agrees'"), "the two kinds of labels differ")
    seen = staged(inspected(table), "inspected")
    refuse(seen.where("problem is not null").select("id", "problem"), "samples that cannot be imported")
    about = table.select("id", "difficulty", "source_path", "image_sha256", "mask_sha256", "annotations_sha256", "yolo_sha256")
    records = about.join(seen.drop("problem"), "id").withColumn("annotation_count", F.size("annotations"))
    numbered = dense_ids(records.select("id", "difficulty", "source_path", "annotations"), ["id"], name="image_id")
    each = dense_ids(numbered.select("image_id", "id", F.posexplode("annotations").alias("n", "a")), ["image_id", "n"], name="annotation_id")
    records = staged(records.drop("annotations").withColumns({"scene_group": F.lit(None).cast("string"), "split": F.lit(None).cast("string")}), "records")
    annotations = staged(each.select("annotation_id", "image_id", "id", "a.*"), "annotations")
    width, height = im.SOURCE_SIZE
    summary = records.agg(
        F.count(F.lit(1)).alias("images"), F.sum("annotation_count").alias("annotations"), F.count_if(F.col("differing") > 0).alias("mask_disagreement_images"), F.sum("differing").alias("mask_disagreement_pixels"),
        F.count_if(F.col("annotation_count") == 0).alias("empty_annotation_images"), F.lit(False).alias("approved_for_training"),
    )
    copies = records.groupBy("pixel_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {
        "images": numbered.select("image_id", F.concat(F.lit("images/"), "id", F.lit(".jpg")).alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"), "difficulty", "source_path"),
        "annotations": annotations,
        "records": records,
        "summary": summary,
        "classes": annotations.groupBy("source_category_id").agg(F.count(F.lit(1)).alias("n")),
        "duplicates": records.join(copies, "pixel_sha256").select("pixel_sha256", "n", "id"),
    }


def reviewed(spark: SparkSession, root: str, tables: dict[str, DataFrame], distance: int = 8, error: float = 20.0) -> dict[str, DataFrame]:
    """records with their flags, counts of flags, pairs of photos that look alike, and the decisions that are still to be made, of an imported source."""
    flags = reports.review_flags(F.col("annotation_count"), F.col("ious"), F.col("beyond_border"), F.coalesce("share", F.lit(0.0)))
    records = staged(tables["records"].withColumns({"flags": flags, "review_status": F.lit("pending")}), "reviewed")
    pixels = photos.decoded_pixels(spark, root, recursive=True)
    files = source_files(spark, root).where("role = 'image'").join(pixels, "_at").select("id", F.substring("content", 1, photos.HEAD).alias("head"), "pixels")
    pairs = staged(photos.similar_photos(staged(photos.measured(files), "measured"), distance, error), "pairs")
    pending = lambda t: t.withColumns({"decision": F.lit("pending"), "reviewer": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return {
        "records": records,
        "flags": flag_counts(records, "flags"),
        "pairs": pairs,
        "sample_decisions": pending(records.where(F.size("flags") > 0).select("id")),
        "pair_decisions": pending(pairs.select("left", "right")),
    }
