"""Sinks that show a result whole or not at all (SNK-01 to 05, 08, 09)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions.geometry import to_xywh
from girder.functions.rules import Refused, refuse, set_difference
from girder.operators.selection import dense_ids


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, destination: str, partition_by: list[str] | None = None, form: str = "parquet") -> None:
    """Write to a hidden sibling and rename it; an existing destination is refused, a failed write leaves none."""
    spark = df.sparkSession
    fs, target = file_system(spark, destination)
    if fs.exists(target):
        raise Refused(f"{destination} exists")
    parent, _, name = destination.rstrip("/").rpartition("/")
    hidden = f"{parent}/_staging_{uuid.uuid4().hex}_{name}"
    _, source = file_system(spark, hidden)
    try:
        writer = df.write.format(form).mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(hidden)
        if not fs.rename(source, target):
            raise Refused(f"{destination} could not be published")
    finally:
        fs.delete(source, True)


#: A state's versions are announced by empty files of this name, a number and the version; the greatest counts.
MARKER = re.compile(r"VERSION\.(\d{12})\.(v[0-9a-f]{32})")


def versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of the versions announced in a folder, ascending."""
    fs, at = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(m[1]), m[2]) for m in map(MARKER.fullmatch, names) if m)


def new_version(df: DataFrame, folder: str) -> str:
    """Write a state table as the next version and announce it; readers see the old or the new one, also if the writer dies in between.

    Nothing is deleted or replaced. Of two writers of the same number the one that finds the other's announcement takes its own back.
    """
    spark = df.sparkSession
    version = f"v{uuid.uuid4().hex}"
    publish(df, f"{folder}/{version}")
    number = max((n for n, _ in versions(spark, folder)), default=0) + 1
    fs, marker = file_system(spark, f"{folder}/VERSION.{number:012d}.{version}")
    if not fs.createNewFile(marker):
        raise Refused("the version could not be announced")
    if any(n == number and v != version for n, v in versions(spark, folder)):
        fs.delete(marker, False)
        raise Refused("another writer announced a version at the same time")
    return version


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    found = versions(spark, folder)
    if not found:
        raise Refused(f"{folder} has no version")
    return spark.read.parquet(f"{folder}/{found[-1][1]}")


def canonical(**values: Column) -> Column:
    """Compact JSON of columns with sorted keys; nulls stay."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def coco_documents(images: DataFrame, annotations: DataFrame, categories: list[tuple[int, str]], split: str = "split") -> DataFrame:
    """split, document: a COCO text for each split, ids numbered from 1 by (split, id).

    images: (id, split, file_name, width, height); annotations: (image, category_id, box), and if there are columns of these names
    segmentation (array of polygons) and area as they come. One document holds a split,
    as the format asks; larger corpora keep the tables of ``dense_ids`` instead.
    """
    i = dense_ids(images, ["id"], [split], "image_id")
    a = annotations.join(i.select(F.col("id").alias("image"), split, "image_id"), "image")
    a = dense_ids(a, ["image_id", "category_id", "box"], [split], "annotation_id")
    xywh = to_xywh(F.col("box"))
    area = F.col("area").cast("double") if "area" in annotations.columns else xywh[2] * xywh[3]
    drawn = ["segmentation"] if "segmentation" in annotations.columns else []
    one = F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", xywh.alias("bbox"), area.alias("area"), F.lit(0).alias("iscrowd"), *drawn)
    both = i.groupBy(split).agg(F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))).alias("images"))
    both = both.join(a.groupBy(split).agg(F.array_sort(F.collect_list(one)).alias("annotations")), split, "left")
    named = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name")) for k, n in categories])
    empty = F.array().cast(both.schema["annotations"].dataType)
    return both.select(split, F.to_json(F.struct(F.coalesce("annotations", empty).alias("annotations"), named.alias("categories"), "images"), {"ignoreNullFields": "false"}).alias("document"))


def label_documents(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """id, text: a label file for every image (id, width, height), with a line of class, centre and size as shares for each annotation (image, class_id, box); no line, no annotation.

    The inverse of the label files' reading, to six decimals.
    """
    b, w, h = F.col("box"), F.col("width"), F.col("height")
    share = lambda x: F.format_string("%.6f", x.cast("double"))
    line = F.concat_ws(" ", F.col("class_id").cast("string"), share((b["x1"] + b["x2"]) / 2 / w), share((b["y1"] + b["y2"]) / 2 / h), share((b["x2"] - b["x1"]) / w), share((b["y2"] - b["y1"]) / h))
    t = annotations.join(images.select(F.col("id").alias("image"), "width", "height"), "image").select("image", line.alias("line"))
    text = t.groupBy("image").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    return images.select("id").join(text.withColumnRenamed("image", "id"), "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def verified_copy(files: DataFrame, pins: DataFrame) -> DataFrame:
    """path, content of pinned files whose bytes are what the pin says; the table is refused if any is not."""
    t = pins.join(files.select("path", "content"), "path", "left")
    bad = t.where(~F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))).select("path").limit(5).collect()
    if bad:
        raise Refused(f"bytes differ from their pins: {[r['path'] for r in bad]}")
    return t.select("path", "content")


#: Fixed limits of a dossier.
MOST_EVENTS, MOST_DOSSIER_BYTES = 1000, 16 << 20


def publish_dossier(one: DataFrame, destination: str) -> None:
    """Publish a dossier's row as JSON, after the text to be published has been read again and found equal, and within the limits (SNK-09, EV-05)."""
    refuse(one.where(F.size(F.coalesce("events", F.array())) > MOST_EVENTS).select("analysis"), "too many events")
    text = one.select("analysis", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
    refuse(text.where(F.octet_length("document") > MOST_DOSSIER_BYTES).select("analysis"), "the dossier is too large")
    back = text.select(F.from_json("document", one.schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    refuse(set_difference(one, back), "the dossier does not read back as it was")
    publish(text, destination, form="json")


def dossier(analyses: DataFrame, events: DataFrame, analysis: int) -> DataFrame:
    """One analysis with its events, in order, as one row."""
    e = events.where(F.col("analysis") == analysis).groupBy("analysis").agg(F.array_sort(F.collect_list(F.struct("revision", *[c for c in events.columns if c not in ("analysis", "revision")]))).alias("events"))
    return analyses.where(F.col("analysis") == analysis).join(e, "analysis", "left")
