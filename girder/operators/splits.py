"""Splits without leaks, and their audits (WN-01, WN-02, WN-08, WN-10, AG-13, AG-16, AG-21, JN-17, ST-02, ST-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.hashing import sha256
from girder.functions.rules import Refused, refuse
from girder.operators.selection import running_sums
from girder.shared import staged

SPLITS = ("train", "valid", "test")


def seeded(seed: int | str, key: Column) -> Column:
    """An order that only the seed and the key decide."""
    return sha256(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def strata(records: DataFrame) -> DataFrame:
    """content_group, n, stratum: the sorted sets of difficulties and classes of a group's members, as text."""
    classes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("classes"))))
    t = records.groupBy("content_group").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("difficulty")).alias("d"), classes.alias("c"))
    quoted = F.array_join(F.transform("d", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    text = F.concat(F.lit("(["), quoted, F.lit("], ["), F.array_join(F.transform("c", lambda x: x.cast("string")), ", "), F.lit("])"))
    return t.select("content_group", "n", text.alias("stratum"))


def grouped_split(records: DataFrame, seed: int = 20260918, share: float = 0.1) -> DataFrame:
    """id, content_group, split of records (id, content_group, difficulty, classes).

    In a stratum of n >= 3 groups max(1, n * share rounded half to even) go to valid and as many to test, in seeded order;
    the rest, and all of a smaller stratum, go to train. Groups are numbered over ranges of (stratum, seeded order), so a
    stratum may be as large as the corpus.
    """
    g = strata(records).withColumn("turn", seeded(seed, F.col("content_group")))
    g = staged(running_sums(g.select("stratum", "turn", "content_group"), ["stratum", "turn", "content_group"], {"before": F.lit(1).cast("long")}), "strata")
    sizes = g.groupBy("stratum").agg(F.min("before").alias("start"), F.count(F.lit(1)).alias("groups"))
    g = g.join(sizes, "stratum").withColumn("nth", F.col("before") - F.col("start") + 1)
    held = F.when(F.col("groups") >= 3, F.greatest(F.lit(1.0), F.rint(F.col("groups") * F.lit(share)))).otherwise(0.0)
    split = F.when(F.col("nth") <= held, "valid").when(F.col("nth") <= 2 * held, "test").otherwise("train")
    return records.join(g.select("content_group", split.alias("split")), "content_group").select("id", "content_group", "split")


def refuse_thin_splits(records: DataFrame, assigned: DataFrame) -> None:
    """Refuse unless there are exactly the three splits and every class stands in each."""
    each = records.join(assigned.select("id", "split"), "id").select("split", F.explode("classes").alias("c")).distinct()
    known = records.select(F.explode("classes").alias("c")).distinct()
    need = known.withColumn("split", F.explode(F.array(*map(F.lit, SPLITS))))
    refuse(need.join(each, ["c", "split"], "left_anti"), "not enough groups for every class in every split")


def places(table: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 in their group, by ranges over the whole table. Stored."""
    t = staged(running_sums(table, [*by, *order], {"_before": F.lit(1).cast("long")}), "places")
    first = t.groupBy(*by).agg(F.min("_before").alias("_first"))
    return t.join(first, by).withColumn(name, F.col("_before") - F.col("_first") + 1).drop("_before", "_first")


def budget_selection(records: DataFrame, maximum: int, seed: int) -> DataFrame:
    """content_group, n of the groups taken: one a stratum in turn, skipping those that no longer fit.

    The running sum depends on what was skipped before, so it is a fold in one task, over
    no more than maximum * (1 + ln maximum) groups however many there are. Strata without groups left are passed over.
    """
    g = strata(records).where(F.col("n") <= maximum).select("stratum", "content_group", F.col("n").cast("long").alias("n"), seeded(seed, F.col("content_group")).alias("seeded"))
    # Places in a stratum, and then among the groups of one size, come from ranges, so a stratum or a size may be as large as the corpus.
    g = places(staged(g, "strata"), ["stratum"], ["seeded", "content_group"], "turn")
    g = places(g, ["n"], ["turn", "stratum"], "able")
    # Groups of one size stop fitting for good, so of size n only the first maximum / n of the line can be taken.
    line = g.where(F.col("able") <= F.floor(maximum / F.col("n"))).agg(F.array_sort(F.collect_list(F.struct("turn", "stratum", "content_group", "n"))).alias("line"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<content_group:string,n:bigint>>").alias("kept"))

    def step(a, x):
        fits = a["sum"] + x["n"] <= maximum
        one = F.array(F.struct(x["content_group"].cast("string").alias("content_group"), x["n"].alias("n")))
        return F.struct(F.when(fits, a["sum"] + x["n"]).otherwise(a["sum"]).alias("sum"), F.when(fits, F.concat(a["kept"], one)).otherwise(a["kept"]).alias("kept"))

    return line.select(F.inline(F.aggregate("line", start, step)["kept"]))


def sampled(table: DataFrame, per: str, k: int, seed: int, name: str = "name") -> DataFrame:
    """k rows of each key in seeded order; the order is by digest, so it is the same on any cluster."""
    nth = F.row_number().over(Window.partitionBy(per).orderBy(seeded(seed, F.col(name)), name))
    return table.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def origin_split(patches: DataFrame, share: float, seed: int) -> DataFrame:
    """photo, use of the origin photos of patches (patch, photo): train for a share of them in seeded order, at least one and not all, else reserved (WN-08).

    Two patches of a photo show one scene, so photos are split and never patches. The order is by digest.
    """
    photos = patches.select("photo").distinct().withColumn("turn", seeded(seed, F.col("photo")))
    many = photos.count()
    if many < 2 or not 0 < share < 1:
        raise Refused("at least two origin photos and a share between 0 and 1 are needed")
    cut = max(1, min(many - 1, round(many * share)))
    ranked = running_sums(photos, ["turn", "photo"], {"before": F.lit(1).cast("long")})
    return ranked.select("photo", F.when(F.col("before") < cut, "train").otherwise("reserved").alias("use"))


def balanced_negatives(patches: DataFrame, uses: DataFrame, wanted: int, seed: int) -> DataFrame:
    """patch, photo of up to ``wanted`` patches of training photos, evenly many a photo, cut off after sorting by patch (WN-08)."""
    own = patches.join(uses.where("use = 'train'").select("photo"), "photo")
    photos = own.select("photo").distinct().count()
    if wanted < 1 or not photos:
        raise Refused("no negatives are wanted or no origin photo is for training")
    chosen = sampled(own, "photo", max(1, wanted // photos), seed, "patch")
    return chosen.orderBy("patch").limit(wanted).select("patch", "photo")


def selection_summary(images: DataFrame, annotations: DataFrame, kept: list[int], first: int = 3) -> DataFrame:
    """split, images, annotations, excluded_annotations, images_without_target and the first ids of those (AG-21, WN-10).

    images: (id, split); annotations: (image, category). An image without a kept annotation stays, and is counted.
    """
    wanted = F.col("category").isin(*kept)
    each = annotations.groupBy(F.col("image").alias("id")).agg(F.count_if(wanted).alias("n"), F.count_if(~wanted).alias("out"))
    t = images.join(each, "id", "left").na.fill(0, ["n", "out"])
    sums = t.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("annotations"), F.sum("out").alias("excluded_annotations"), F.count_if(F.col("n") == 0).alias("images_without_target"))
    ids = t.where("n = 0").withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("id"))).where(F.col("place") <= first)
    ids = ids.groupBy("split").agg(F.sort_array(F.collect_list("id")).alias("first_without_target"))
    return sums.join(ids, "split", "left")


def with_crops(photos: DataFrame, crops: DataFrame) -> DataFrame:
    """Whole photos (id, width, height, content_group, ...) and negative crops of them as rows of one table (ST-02).

    crops: (id, parent, x1, y1, x2, y2 as shares). A crop goes to train in its parent's group, without boxes; one under 32 pixels on a side is
    refused, as is one without a parent.
    """
    own = crops.join(photos.select(F.col("id").alias("parent"), F.col("width").alias("pw"), F.col("height").alias("ph"), "content_group"), "parent", "left")
    refuse(own.where("pw is null").select("id", "parent"), "a crop's photo is unknown")
    at = {c: F.rint(F.col(c) * F.col("pw" if c[0] == "x" else "ph")).cast("int") for c in ("x1", "y1", "x2", "y2")}
    own = own.withColumns(at).withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")})
    refuse(own.where(F.least("width", "height") < 32).select("id", "width", "height"), "a crop is too small")
    rows = own.select("id", "parent", "width", "height", "content_group", F.array("x1", "y1", "x2", "y2").alias("crop"), F.lit(True).alias("is_crop"), F.lit("train").alias("split"))
    return photos.withColumn("is_crop", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def lineage_problems(runs: DataFrame) -> DataFrame:
    """run, problem of training runs (run, mode, parent, pinned, checkpoint, status, classes, corpus, engine) whose origin is not sound (JN-17).

    A fine-tuned or extended run's pinned checkpoint must be its parent's, of a completed run of the same classes, corpus and engine; a resumed run
    must have been interrupted; an official one has no parent.
    """
    p = runs.select(F.col("run").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("checkpoint", "status", "classes", "corpus", "engine")], F.lit(True).alias("p_known"))
    t = runs.join(p, "parent", "left")
    child = F.col("mode").isin("fine_tune", "extend")
    same = F.lit(True)
    for c in ("classes", "corpus", "engine"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    problem = (
        F.when(~F.col("mode").isin("official", "fine_tune", "extend", "resume"), "unknown_mode")
        .when((F.col("mode") == "official") & (F.col("parent").isNotNull() | F.col("pinned").isNotNull()), "official_with_parent")
        .when(child & F.col("p_known").isNull(), "unknown_parent").when(child & (F.col("parent") == F.col("run")), "own_parent")
        .when(child & ~F.col("p_status").eqNullSafe(F.lit("completed")), "parent_not_completed").when(child & ~F.col("pinned").eqNullSafe(F.col("p_checkpoint")), "checkpoint_differs")
        .when(child & ~same, "settings_differ").when((F.col("mode") == "resume") & ~F.col("status").isin("failed", "interrupted"), "not_interrupted")
    )
    return t.select("run", problem.alias("problem")).where("problem is not null")


def split_summary(table: DataFrame, classes: list[int]) -> DataFrame:
    """split, images, groups, images_without_class and a count of images for each class, zeros included."""
    has = {f"class_{c}": F.count_if(F.array_contains("classes", c)) for c in classes}
    return table.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("content_group").alias("groups"), F.count_if(F.size("classes") == 0).alias("images_without_class"), *[c.alias(n) for n, c in has.items()])


def shared_digests(table: DataFrame) -> DataFrame:
    """Digests that stand in more than one split; there must be none."""
    return table.groupBy("digest").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count(F.lit(1)).alias("n")).where(F.size("splits") > 1)
