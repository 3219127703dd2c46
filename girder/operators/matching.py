"""One-to-one matching of predictions to references, and merging of proposals (JN-01, JN-16, WN-04, WN-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.geometry import box, iou, smaller_overlap, union_box

MATCH = "struct<pred_pos:bigint,score:bigint,ref_pos:bigint,reason:string,best_iou:double,matched_iou:double>"


def match_boxes(predictions: DataFrame, references: DataFrame, overlap: float = 0.5) -> DataFrame:
    """image, class, pred_pos, score, ref_pos, reason, best_iou, matched_iou of every prediction.

    Both tables: (image, class, pos, box), predictions also a long score. In each image and class the
    predictions go by falling score, ties by pos; each takes the free reference of the largest overlap of at least
    ``overlap``, ties by pos. One that finds none is a duplicate if any reference overlaps so much, else insufficient_overlap
    if any overlaps at all, else no_overlap. A shuffle of both tables on (image, class); the boxes of one image are bounded by the corpus rules.
    """
    side = lambda t, predicted: t.select("image", "class", F.lit(predicted).alias("predicted"), F.col("pos").cast("long").alias("pos"), (F.col("score") if predicted else F.lit(None)).cast("long").alias("score"), box(*[F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")]).alias("box"))
    return match_sides(side(predictions, True).unionByName(side(references, False)), overlap)


def match_sides(boxes: DataFrame, overlap: float = 0.5) -> DataFrame:
    """What ``match_boxes`` returns, of predictions and references in one table: (image, class, predicted, pos, score, box).

    Both sides of an image come together in one aggregation, so there is no join, and none of a table that lies by image is shuffled again. An image or class
    that is null is met by no reference.
    """
    predicted, known = F.col("predicted"), F.col("image").isNotNull() & F.col("class").isNotNull()
    p = F.when(predicted, F.struct((-F.col("score")).cast("long").alias("order"), F.col("pos").cast("long").alias("pos"), "box"))
    r = F.when(~predicted & known, F.struct(F.col("pos").cast("long").alias("pos"), "box"))
    both = boxes.groupBy("image", "class").agg(F.array_sort(F.collect_list(p)).alias("p"), F.array_sort(F.collect_list(r)).alias("r"))

    def step(done, x):
        overlaps = F.transform("r", lambda y: F.struct(iou(x["box"], y["box"]).alias("iou"), (-y["pos"]).alias("back")))
        free = F.filter(overlaps, lambda o: (o["iou"] >= overlap) & ~F.exists(done, lambda d: d["ref_pos"].eqNullSafe(-o["back"])))
        best, most = F.array_max(free), F.coalesce(F.array_max(F.transform(overlaps, lambda o: o["iou"])), F.lit(0.0))
        reason = F.when(best.isNotNull(), "matched").when(most >= overlap, "duplicate").when(most > 0, "insufficient_overlap").otherwise("no_overlap")
        one = F.struct(x["pos"].alias("pred_pos"), (-x["order"]).alias("score"), (-best["back"]).alias("ref_pos"), reason.alias("reason"), most.alias("best_iou"), best["iou"].alias("matched_iou"))
        return F.concat(done, F.array(one.cast(MATCH)))

    folded = F.aggregate("p", F.array().cast(f"array<{MATCH}>"), step)
    return both.select("image", "class", F.inline(folded))


def merge_proposals(predictions: DataFrame, overlap: float = 0.3) -> DataFrame:
    """image, class, score, box, merged_from: proposals joined by falling score, ties by pos.

    A proposal joins the first kept one of its class that shares at least ``overlap`` of the smaller of the two; the
    kept box grows to hold both and keeps its score.
    """
    kind = "struct<score:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>,merged_from:bigint>"
    p = predictions.groupBy("image", "class").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("pos").cast("long").alias("pos"), F.col("score").cast("long").alias("score"), "box"))).alias("p"))

    def step(kept, x):
        at = F.array_position(F.transform(kept, lambda k: smaller_overlap(k["box"], x["box"]) >= overlap), True)
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["score"].alias("score"), union_box(k["box"], x["box"]).alias("box"), (k["merged_from"] + 1).alias("merged_from"))).otherwise(k))
        new = F.struct(x["score"].alias("score"), x["box"].alias("box"), F.lit(1).cast("long").alias("merged_from")).cast(kind)
        return F.when(at > 0, grown).otherwise(F.concat(kept, F.array(new)))

    return p.select("image", "class", F.inline(F.aggregate("p", F.array().cast(f"array<{kind}>"), step)))
