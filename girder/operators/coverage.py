"""Whether zones of the image are covered, by the areas of unions of boxes (AG-06, 07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.geometry import union_area
from girder.functions.ratios import ratio


def zone_coverage(references: DataFrame, proposals: DataFrame) -> DataFrame:
    """image, class, expected, signalled and the area of the reference's and proposal's union and of both.

    Boxes are shuffled once, no cells are made: what two unions share is the sum of their areas less that of all boxes together.
    """
    each = lambda t, name: t.groupBy("image", "class").agg(F.collect_list("box").alias(name))
    r, p = each(references, "r"), each(proposals, "p")
    none = F.array().cast(r.schema["r"].dataType)
    both = r.join(p, ["image", "class"], "full_outer").withColumns({"r": F.coalesce("r", none), "p": F.coalesce("p", none)})
    sums = both.select("image", "class", union_area(F.col("r")).alias("reference_pixels"), union_area(F.col("p")).alias("proposal_pixels"), union_area(F.concat("r", "p")).alias("all"))
    sums = sums.withColumn("shared_pixels", F.col("reference_pixels") + F.col("proposal_pixels") - F.col("all")).drop("all")
    whole = sums.withColumns({c: F.rint(c).cast("long") for c in ("reference_pixels", "proposal_pixels", "shared_pixels")})
    return whole.withColumns({"expected": F.col("reference_pixels") > 0, "signalled": F.col("proposal_pixels") > 0})


def coverage_totals(coverage: DataFrame, n_images: int) -> DataFrame:
    """Per class, recall and precision of photos and of zones; each is null where it is undefined."""
    e, s = F.col("expected"), F.col("signalled")
    t = coverage.groupBy("class").agg(
        F.count_if(e).alias("expected"), F.count_if(e & s).alias("found"), F.count_if(s).alias("signalled"), F.count_if(s & ~e).alias("without_reference"),
        F.sum("reference_pixels").alias("reference_pixels"), F.sum("proposal_pixels").alias("proposal_pixels"), F.sum("shared_pixels").alias("shared_pixels"),
    )
    return t.withColumns({
        "photos": F.lit(n_images).cast("long"),
        "photo_recall": ratio(F.col("found"), F.col("expected")), "photo_precision": ratio(F.col("found"), F.col("signalled")),
        "zone_recall": ratio(F.col("shared_pixels"), F.col("reference_pixels")), "zone_precision": ratio(F.col("shared_pixels"), F.col("proposal_pixels")),
    })
