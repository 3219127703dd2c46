"""Average precision and recall by the public COCO protocol, on boxes or masks (AG-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.geometry import iou
from girder.operators.selection import running_sums
from girder.shared import staged

THRESHOLDS = [0.5 + 0.05 * k for k in range(10)]
RECALLS = 100


def hits(predictions: DataFrame, references: DataFrame, thresholds: list[float], most: int = 100, shape: str = "box", overlap: Callable[[Column, Column], Column] = iou) -> DataFrame:
    """image, class, score, pos, and an array that says for each threshold whether the prediction hits; of an image's predictions of a class the ``most`` best count.

    Each prediction, by falling score, takes the free reference of the largest overlap that reaches the threshold; of equal
    overlaps the later reference. Overlaps are taken once for all thresholds, pair by pair within an image and class, so ``overlap`` may be a
    kernel on masks as well as an expression on boxes.
    """
    key = ["image", "class"]
    p = predictions.select(*key, F.col("pos").cast("long").alias("pos"), "score", F.col(shape).alias("own"))
    r = references.select(*key, F.col("pos").cast("long").alias("ref"), F.col(shape).alias("other"))
    pairs = p.join(r, key, "left").withColumn("iou", F.when(F.col("ref").isNotNull(), overlap(F.col("own"), F.col("other"))))
    low = min(min(thresholds), 1 - 1e-10)
    near = F.collect_list(F.when(F.col("iou") >= low, F.struct("iou", "ref")))
    each = pairs.groupBy(*key, "pos").agg(F.first("score").alias("score"), near.alias("near"))
    line = each.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "pos", "score", "near"))), 1, most).alias("line"))

    def taken(threshold: float) -> Column:
        def step(done, x):
            free = F.filter(x["near"], lambda o: (o["iou"] >= min(threshold, 1 - 1e-10)) & ~F.array_contains(done, o["ref"]))
            return F.concat(done, F.array(F.coalesce(F.array_max(free)["ref"], -F.size(done) - 1)))

        return F.aggregate("line", F.array().cast("array<bigint>"), step)

    folded = line.select(*key, "line", *[taken(t).alias(f"t{k}") for k, t in enumerate(thresholds)])
    rows = folded.select(*key, F.posexplode("line").alias("i", "p"), *[f"t{k}" for k in range(len(thresholds))])
    found = F.array(*[F.get(f"t{k}", F.col("i")) >= 0 for k in range(len(thresholds))])
    return rows.select(*key, F.col("p.score").alias("score"), F.col("p.pos").alias("pos"), found.alias("hit"))


def average_precision(predictions: DataFrame, references: DataFrame, thresholds: list[float] | None = None, shape: str = "box", overlap: Callable[[Column, Column], Column] = iou) -> DataFrame:
    """class, threshold, ap, recall of every class that has references: precision made monotone from the right and read at 101 recalls, and the recall of all that count.

    Positions of references in an image and class are not negative. One matching serves all thresholds. Running counts go over ranges of (class, falling score),
    so a class may be as large as the corpus; a curve is reduced to its best precision at each of 101 recalls while it is counted.
    """
    thresholds = thresholds or THRESHOLDS
    found = hits(predictions, references, thresholds, shape=shape, overlap=overlap).withColumn("order", -F.col("score"))
    sums = {"n": F.lit(1).cast("long")} | {f"tp{k}": F.get("hit", F.lit(k)).cast("long") for k in range(len(thresholds))}
    order = ["class", "order", "image", "pos"]
    run = staged(running_sums(found.select(*order, "hit"), order, sums), "running")
    starts = run.groupBy("class").agg(*[F.min(c).alias(f"{c}_start") for c in sums])
    refs = references.groupBy("class").agg(F.count(F.lit(1)).alias("refs"))
    t = run.join(starts, "class").join(refs, "class")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get("hit", F.lit(k)).alias("hit"), (F.col(f"tp{k}") - F.col(f"tp{k}_start") + 1).alias("tp")) for k in range(len(thresholds))]))
    t = t.select("class", "refs", (F.col("n") - F.col("n_start") + 1).alias("n"), each.alias("e")).where("e.hit").select("class", "refs", "n", "e.k", "e.tp")
    share, guess = F.col("tp").cast("double") / F.col("refs"), F.floor(RECALLS * F.col("tp") / F.col("refs"))
    # The last of the recalls 0, 0.01 ... 1 that are reached, as the numbers compare.
    place = F.when((guess + 1).cast("double") / RECALLS <= share, guess + 1).when(guess.cast("double") / RECALLS > share, guess - 1).otherwise(guess)
    best = t.withColumn("place", place).groupBy("class", "refs", "k", "place").agg(F.max(F.col("tp").cast("double") / F.col("n")).alias("precision"), F.max("tp").alias("tp"))
    curve = best.groupBy("class", "refs", "k").agg(F.collect_list(F.struct("place", "precision")).alias("curve"), F.max("tp").alias("tp"))
    read = F.transform(F.sequence(F.lit(0), F.lit(RECALLS)), lambda i: F.coalesce(F.array_max(F.transform(F.filter("curve", lambda c: c["place"] >= i), lambda c: c["precision"])), F.lit(0.0)))
    ap = F.aggregate(read, F.lit(0.0), lambda s, x: s + x) / (RECALLS + 1)
    every = refs.withColumn("k", F.explode(F.array(*map(F.lit, range(len(thresholds))))))
    named = F.get(F.array(*[F.lit(float(x)) for x in thresholds]), F.col("k"))
    both = every.join(curve.select("class", "k", ap.alias("ap"), (F.col("tp").cast("double") / F.col("refs")).alias("recall")), ["class", "k"], "left")
    return both.select("class", named.alias("threshold"), F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
