"""Photos from their bytes to hashes and measures in one Arrow stage (SRC-18; PRJ-09, 10, 22, 23, 24)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions import images, rules
from girder.operators.similarity import close_pairs

#: Bytes of a file in which a JPEG's header is sought.
HEAD = 1 << 20
REGION = pa.struct([("x", pa.int32()), ("y", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("reason", pa.string())])
VIEW = pa.struct([("across", pa.int64()), ("down", pa.int64()), ("thumb", pa.binary())])
MEASURES = {"mean_luminance": pa.float64(), "dark_fraction": pa.float64(), "bright_fraction": pa.float64(), "readable_fraction": pa.float64(), "counting_scale": pa.float64(), "sharpness": pa.float64()}
FIELDS = {"problem": pa.string(), "form": pa.string(), "orientation": pa.int32(), "width": pa.int32(), "height": pa.int32(), "across": pa.int64(), "down": pa.int64(), "views": pa.list_(VIEW), **MEASURES, "lost_regions": pa.list_(REGION)}
DDL = (
    "problem string, form string, orientation int, width int, height int, across long, down long, views array<struct<across:long,down:long,thumb:binary>>, "
    + ", ".join(f"{c} double" for c in MEASURES)
    + ", lost_regions array<struct<x:int,y:int,width:int,height:int,reason:string>>"
)


def one_path(c: Column) -> Column:
    """A file's path with one slash after the scheme: sources name it with one or three."""
    return F.regexp_replace(c, "^([a-z0-9]+):/*", "$1:/")


def decoded_pixels(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """_at, pixels of the photos under a path, by Spark's own image source, which decodes on the executors; its paths are written as in an address."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(path)
    at = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    return rows.select(one_path(at).alias("_at"), F.struct(*[F.col(f"image.{c}") for c in ("height", "width", "nChannels", "data")]).alias("pixels"))


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """id (the path), size, sha256, head, pixels of the files under a path. Pixels and files meet by path; of a file only its head goes along."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, HEAD).alias("head"))
    return files.withColumn("_at", one_path(F.col("id"))).join(decoded_pixels(spark, path), "_at", "left").drop("_at")


def rgb(pixels: dict) -> np.ndarray:
    """Rows of the image source as height by width by three; it gives blue first, or one channel."""
    a = np.frombuffer(pixels["data"], np.uint8).reshape(pixels["height"], pixels["width"], pixels["nChannels"])
    return a[..., 2::-1] if pixels["nChannels"] >= 3 else np.repeat(a, 3, axis=2)


def measured(photos: DataFrame, source: bool = False, thumb: int = 32) -> DataFrame:
    """id and what a photo's bytes and pixels say, of rows (id, head, pixels).

    A photo with a problem has no measures. Sides, hashes and regions are those of the photo as EXIF turns it. Batches are bounded by Spark's own limit of bytes for Arrow, and
    a worker holds one photo's arrays besides.
    """
    kind = dict(photos.dtypes)["id"]

    def one(head: bytes | None, pixels: dict | None) -> dict:
        h = images.photo_header(head or b"")
        problem = images.header_problem(h, source) or (None if pixels is not None else "not_decoded")
        out = {"problem": problem, "form": h.form, "orientation": h.orientation if h.form else None}
        if problem:
            return out
        if (pixels["width"], pixels["height"]) != (h.width, h.height):
            return out | {"problem": "header_differs"}
        photo = images.oriented(rgb(pixels), h.orientation)
        luma = images.gray(photo)
        lost, shares = images.exposure(luma)
        views = [{"across": across, "down": down, "thumb": small} for (across, down), small in images.fingerprint(photo, thumb)]
        return out | shares | {"width": photo.shape[1], "height": photo.shape[0], "across": views[0]["across"], "down": views[0]["down"], "views": views, "sharpness": images.sharpness(luma), "lost_regions": lost}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [one(head.as_py(), pixels.as_py()) for head, pixels in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r.get(c) for r in rows], t) for c, t in FIELDS.items()]], ["id", *FIELDS])

    return photos.select("id", "head", "pixels").mapInArrow(run, f"id {kind}, {DDL}")


def photo_measures(photos: DataFrame, source: bool = False) -> DataFrame:
    """The same with verdict and reasons of every photo without a problem."""
    t = measured(photos, source)
    sound = F.col("problem").isNull()
    say = lambda c: F.when(sound, c(F.col("readable_fraction"), F.col("sharpness")))
    return t.withColumns({"verdict": say(rules.photo_verdict), "reasons": say(rules.photo_reasons)})


def similar_photos(measures: DataFrame, distance: int, error: float) -> DataFrame:
    """left, right, view, distance, error of photos that look alike: the left one's own view against all of the right one's (PRJ-10, JN-04).

    Candidates share enough of the hash across in some view; then the whole 128 bits and the thumbnails of the pair count.
    """
    t = measures.where("problem is null")
    each = t.select("id", F.posexplode("views").alias("view", "v")).select("id", "view", "v.across", "v.down", "v.thumb")
    named = each.select(F.struct("id", "view").alias("id"), F.col("across").alias("hash"))
    near = close_pairs(named, distance, bits=64).select("left", "right").where("left.id <> right.id and (left.view = 0 or right.view = 0)")
    # A pair stands once however its ids sort: the smaller id's own view against any view of the other.
    turn = F.col("left.id") < F.col("right.id")
    pairs = near.select(F.when(turn, F.col("left")).otherwise(F.col("right")).alias("a"), F.when(turn, F.col("right")).otherwise(F.col("left")).alias("b")).where("a.view = 0")
    side = lambda e: each.select(F.struct("id", "view").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("across", "down", "thumb")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.bit_count(F.col("across_a").bitwiseXOR(F.col("across_b"))) + F.bit_count(F.col("down_a").bitwiseXOR(F.col("down_b")))
    both = both.withColumn("distance", apart).where(F.col("distance") <= distance)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.stack([np.frombuffer(v.as_py(), np.uint8) for v in batch.column(k)]).astype(np.int16) if batch.num_rows else np.zeros((0, 1)) for k in (4, 5))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(np.abs(x - y).mean(axis=1))], ["left", "right", "view", "distance", "error"])

    kind = dict(measures.dtypes)["id"]
    rows = both.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), F.col("b.view").alias("view"), "distance", "thumb_a", "thumb_b").mapInArrow(far, f"left {kind}, right {kind}, view int, distance int, error double")
    best = rows.where(F.col("error") <= error).groupBy("left", "right").agg(F.min(F.struct("error", "distance", "view")).alias("m"))
    return best.select("left", "right", "m.view", "m.distance", "m.error")

