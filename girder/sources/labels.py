"""Label files (SRC-09, SRC-10a, SRC-10b): lines of a class and four numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far rounding to six decimals may reach over the edge.
SLACK = 1e-6


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    """id, line (from 1), text, fields of the lines of files (id, text) that have any; empty lines count in the numbering."""
    t = files.select("id", *keep, F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("at", "text"))
    return t.where(F.length(F.trim("text")) > 0).select("id", *keep, (F.col("at") + 1).alias("line"), F.trim("text").alias("text"), F.split(F.trim("text"), r"\s+").alias("fields"))


def numbers(fields: Column) -> Column:
    return F.transform(F.slice(fields, 2, 4), lambda x: x.try_cast("double"))


def parsed(files: DataFrame, n_classes: int) -> DataFrame:
    """The strict reading: id, line, text, class_id, v (four numbers), verdict.

    verdict is box, empty_box for a flat one, which is set aside, or the rule that the line breaks, which refuses its file.
    """
    t = lines_of(files).withColumns({"class_id": F.get("fields", F.lit(0)).try_cast("int"), "v": numbers(F.col("fields"))})
    v = [F.get("v", F.lit(i)) for i in range(4)]
    plain = F.size("fields") == 5
    read = F.col("class_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    inside = F.forall("v", lambda x: (x >= 0) & (x <= 1))
    verdict = (
        F.when(~plain, "unexpected_line")
        .when(~read, "invalid_number")
        .when((F.col("class_id") < 0) | (F.col("class_id") >= n_classes), "unknown_class")
        .when(~inside, "outside")
        .when((v[2] <= 0) | (v[3] <= 0), "empty_box")
        .when((v[0] - v[2] / 2 < -SLACK) | (v[1] - v[3] / 2 < -SLACK), "starts_outside")
        .when((v[0] + v[2] / 2 > 1 + SLACK) | (v[1] + v[3] / 2 > 1 + SLACK), "ends_outside")
        .otherwise("box")
    )
    return t.select("id", "line", "text", "class_id", "v", verdict.alias("verdict"))


def boxes(files: DataFrame, n_classes: int) -> DataFrame:
    """id, line, class_id, cx, cy, width, height of the sound lines."""
    t = parsed(files, n_classes).where("verdict = 'box'")
    return t.select("id", "line", "class_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("cx", "cy", "width", "height"))])


def rejects(files: DataFrame, n_classes: int) -> DataFrame:
    """id, line, reason, text of the lines that are not boxes."""
    return parsed(files, n_classes).where("verdict <> 'box'").select("id", "line", F.col("verdict").alias("reason"), "text")


def mapped_boxes(files: DataFrame, names: list[str], mapping: dict[str, str]) -> DataFrame:
    """The collection's reading: id, line, verdict, class, source_class_id, x1, y1, x2, y2.

    The class is digits only; a class without a mapping is skipped; corners may pass the edge by the slack and are clipped.
    """
    t = lines_of(files).withColumns({"c": F.get("fields", F.lit(0)), "v": numbers(F.col("fields"))})
    v = [F.get("v", F.lit(i)) for i in range(4)]
    t = t.withColumns({"class_id": F.col("c").try_cast("int"), "x1": v[0] - v[2] / 2, "y1": v[1] - v[3] / 2, "x2": v[0] + v[2] / 2, "y2": v[1] + v[3] / 2})
    corners = F.array("x1", "y1", "x2", "y2")
    finite = F.forall(corners, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    category = F.element_at(table, F.col("class_id").cast("string"))
    verdict = (
        F.when((F.size("fields") != 5) | ~F.col("c").rlike("^[0-9]+$"), "unexpected_line")
        .when(~F.coalesce(F.col("class_id") < len(names), F.lit(False)), "unknown_class")
        .when(~F.coalesce(finite, F.lit(False)) | (v[2] <= 0) | (v[3] <= 0), "empty_or_not_finite")
        .when((F.array_min(corners) < -SLACK) | (F.array_max(corners) > 1 + SLACK), "outside")
        .when(category.isNull(), "skipped")
        .otherwise("box")
    )
    edge = lambda n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(n))).alias(n)
    return t.select("id", "line", verdict.alias("verdict"), category.alias("class"), F.col("class_id").alias("source_class_id"), edge("x1"), edge("y1"), edge("x2"), edge("y2"))


def instance_pairs(documents: DataFrame, files: DataFrame) -> DataFrame:
    """id, n, verdict: a document's annotations held against its label file's polygons, instance by instance.

    documents: (id, width, height, annotations array<struct<category_id, segmentation array<array<double>>>>); files: (id, text) with a line
    ``class x y x y ...`` of shares each. Counts, classes and, to a pixel, the points must agree (SRC-09, JN-03).
    """
    a = documents.select("id", "width", "height", F.posexplode("annotations").alias("n", "a"))
    b = files.select("id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)).alias("n", "line"))
    b = b.select("id", "n", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double")).alias("f"))
    both = a.join(b, ["id", "n"], "full_outer")
    points = F.get("a.segmentation", F.lit(0))
    own = F.transform(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda x, i: x * F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    near = F.forall(F.zip_with(points, own, lambda x, y: F.coalesce(F.abs(x - y) <= 1, F.lit(False))), lambda ok: ok)
    verdict = F.when(F.col("a").isNull() | F.col("f").isNull(), "count_differs").when(F.col("a.category_id") != F.get("f", F.lit(0)), "class_differs").when(F.coalesce(near, F.lit(False)), "agrees").otherwise("points_differ")
    return both.select("id", "n", verdict.alias("verdict"))
