"""Pairs of boxes that meet, and their one-to-one assignment, in images of any size (JN-01, JN-09, JN-14, JN-16, PRJ-12, WN-04).

An image's boxes are dealt into a grid fine enough that a cell has few pairs to try; a cell in which boxes crowd gets a finer grid of its own. A box stands in every cell it
touches, and a pair counts only in the cell that holds the corner where the two begin to overlap, so each pair is met once without a
distinct. How fine a grid is follows from counts that are aggregated, so no image is gathered anywhere.

The greedy assignment needs no order over all predictions: a prediction may take a reference at once if that is its best one left and no prediction before it
could claim it. All such pairs are taken in a round; rounds go on while they still take much, and what is left is folded in order, an edge at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.geometry import iou, meets
from girder.shared import staged

#: Pairs that a cell may try before its boxes are dealt out finer; a grid has FINEST cells a side at most.
TRIED, FINEST = 100_000, 1024
#: Rounds of assignment, and the part of the edges that a round must take for another to follow.
ROUNDS, WORTH = 12, 0.2


def corner(name: str) -> Column:
    return F.col(f"_box.{name}")


def with_grid(boxes: DataFrame, keys: list[str], name: str, tried: int) -> DataFrame:
    """Rows (.., _side, _box) dealt into the cells of their key's grid: the grid itself (x, y, w, h, nx, ny) and the cell's place in it.

    A side's cells are no narrower than its boxes are on average, so a box stands in few of them.
    """
    box = {c: corner(c) for c in ("x1", "y1", "x2", "y2")}
    each = boxes.groupBy(*keys).agg(
        F.count_if(F.col("_side") == 0).alias("a"), F.count_if(F.col("_side") == 1).alias("b"),
        F.min(box["x1"]).alias("x"), F.min(box["y1"]).alias("y"), F.max(box["x2"]).alias("right"), F.max(box["y2"]).alias("bottom"),
        F.avg(box["x2"] - box["x1"]).alias("wide"), F.avg(box["y2"] - box["y1"]).alias("tall"),
    ).where("a > 0 and b > 0")
    # k even cells leave a * b / k ** 2 pairs in each.
    each = each.withColumn("k", F.sqrt(F.greatest(F.lit(1.0), F.col("a").cast("double") * F.col("b") / tried)))
    most = lambda low, high, mean: F.least(F.lit(float(FINEST)), F.greatest(F.lit(1.0), (F.col(high) - F.col(low)) / F.col(mean)))
    each = each.withColumns({"mx": most("x", "right", "wide"), "my": most("y", "bottom", "tall")})
    each = each.withColumn("ny", F.ceil(F.least(F.sqrt("k"), "my"))).withColumn("nx", F.ceil(F.least(F.col("k") / F.col("ny"), "mx"))).withColumn("ny", F.ceil(F.least(F.col("k") / F.col("nx"), "my")))
    grid = F.struct("x", "y", ((F.col("right") - F.col("x")) / F.col("nx")).alias("w"), ((F.col("bottom") - F.col("y")) / F.col("ny")).alias("h"), F.col("nx").cast("int").alias("nx"), F.col("ny").cast("int").alias("ny"))
    t = boxes.join(each.select(*keys, grid.alias(name)), keys)
    g = F.col(name)
    for axis, low, high in (("x", "x1", "x2"), ("y", "y1", "y2")):
        t = t.withColumn(f"{name}_{axis}", F.explode(F.sequence(place(box[low], g, axis), place(box[high], g, axis))))
    return t


def place(at: Column, grid: Column, axis: str) -> Column:
    """The cell of a coordinate along an axis of a grid."""
    side, n = ("w", "nx") if axis == "x" else ("h", "ny")
    return F.least(F.greatest(F.floor((at - grid[axis]) / grid[side]), F.lit(0)), grid[n] - 1).cast("int")


def meeting_pairs(a: DataFrame, b: DataFrame, by: list[str], tried: int = TRIED) -> DataFrame:
    """by, a, b: all pairs of rows of two tables (by, box, ..) whose boxes share an inner point, each row as a struct. Boxes without area and null ones meet none.

    Cells that crowd are found by counts and dealt out once more; boxes that all lie on each other stay together, and then nearly all of their pairs are results.
    """
    held = [F.struct(*[F.col(f"`{c}`") for c in t.columns]) for t in (a, b)]
    kinds = [t.select(h.alias("h")).schema["h"].dataType for t, h in zip((a, b), held, strict=True)]
    rows = []
    for k, t in enumerate((a, b)):
        own = [held[s] if s == k else F.lit(None).cast(kinds[s]) for s in (0, 1)]
        box = F.struct(*[F.col(f"box.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
        rows.append(t.select(*by, F.lit(k).cast("byte").alias("_side"), box.alias("_box"), *[c.alias(f"_row{s}") for s, c in enumerate(own)]))
    every = rows[0].unionByName(rows[1]).where("_box.x1 < _box.x2 and _box.y1 < _box.y2")
    dealt = staged(with_grid(every, by, "_g", tried), "cells")
    cell = [*by, "_g_x", "_g_y"]
    dealt = with_grid(dealt, cell, "_f", tried)
    fine = [*cell, "_f_x", "_f_y"]
    side = lambda k: dealt.where(F.col("_side") == k).select(*fine, "_g", "_f", F.col("_box").alias(f"_box{k}"), F.col(f"_row{k}").alias(f"_r{k}"))
    pairs = side(0).join(side(1).drop("_g", "_f"), fine)
    x, y = F.greatest("_box0.x1", "_box1.x1"), F.greatest("_box0.y1", "_box1.y1")
    here = F.lit(True)
    for g in ("_g", "_f"):
        here = here & (place(x, F.col(g), "x") == F.col(f"{g}_x")) & (place(y, F.col(g), "y") == F.col(f"{g}_y"))
    return pairs.where(meets(F.col("_box0"), F.col("_box1")) & here).select(*by, F.col("_r0").alias("a"), F.col("_r1").alias("b"))


def edges_of(predictions: DataFrame, references: DataFrame, tried: int = TRIED) -> DataFrame:
    """image, class, score, pos, ref, iou of every prediction and reference of one image and class that overlap. Stored."""
    p = predictions.select("image", "class", F.col("pos").cast("long").alias("pos"), F.col("score").cast("long").alias("score"), "box")
    r = references.select("image", "class", F.col("pos").cast("long").alias("pos"), "box")
    pairs = meeting_pairs(p, r, ["image", "class"], tried)
    return staged(pairs.select("image", "class", F.col("a.score").alias("score"), F.col("a.pos").alias("pos"), F.col("b.pos").alias("ref"), iou(F.col("a.box"), F.col("b.box")).alias("iou")), "edges")


GROUP = ["image", "class"]


def one_round(edges: DataFrame) -> DataFrame:
    """image, class, pos, ref, iou: the pairs that no prediction before could claim and that are their prediction's best."""
    # The best edge of a prediction: the largest overlap, then the smallest reference. The first prediction of a reference: the highest score, then the smallest pos.
    wish = edges.groupBy(*GROUP, "score", "pos").agg(F.max(F.struct("iou", (-F.col("ref")).alias("back"))).alias("w")).select(*GROUP, "score", "pos", (-F.col("w.back")).alias("ref"), "w.iou")
    first = edges.groupBy(*GROUP, "ref").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("f")).select(*GROUP, "ref", F.col("f.score").alias("score"), (-F.col("f.back")).alias("pos"))
    return wish.join(first, [*GROUP, "ref", "score", "pos"]).select(*GROUP, "pos", "ref", "iou")


def folded(edges: DataFrame) -> DataFrame:
    """The same of all edges in order of falling score: what is left after the rounds. A task holds the references taken in one image and class."""
    kinds = dict(edges.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, done = None, set(), None
        for batch in batches:
            out = []
            for image, class_, pos, ref, iou_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (image, class_) != group:
                    group, taken, done = (image, class_), set(), None
                if pos != done and ref not in taken:
                    taken.add(ref)
                    done = pos
                    out.append((image, class_, pos, ref, iou_))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch.schema, strict=True)], ["image", "class", "pos", "ref", "iou"])

    line = edges.repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("score"), "pos", F.desc("iou"), "ref")
    return line.select(*GROUP, "pos", "ref", "iou").mapInArrow(run, f"image {kinds['image']}, class {kinds['class']}, pos long, ref long, iou double")


def assigned(edges: DataFrame, rounds: int = ROUNDS, worth: float = WORTH) -> DataFrame:
    """image, class, pos, ref, iou: the greedy one-to-one assignment over stored edges."""
    kept: list[DataFrame] = []
    left = edges.count()
    for _ in range(rounds):
        if not left:
            break
        taken = staged(one_round(edges), "taken")
        kept.append(taken)
        edges = edges.join(taken.select(*GROUP, "pos"), [*GROUP, "pos"], "left_anti").join(taken.select(*GROUP, "ref"), [*GROUP, "ref"], "left_anti")
        edges = staged(edges.select(*GROUP, "score", "pos", "ref", "iou"), "edges")
        before, left = left, edges.count()
        if before - left < worth * before:
            break
    if left:
        kept.append(folded(edges))
    if not kept:
        return edges.select(*GROUP, "pos", "ref", "iou")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def match_boxes(predictions: DataFrame, references: DataFrame, overlap: float = 0.5, tried: int = TRIED, rounds: int = ROUNDS) -> DataFrame:
    """What ``matching.match_boxes`` returns, for images with any number of boxes: neither an image's boxes nor its pairs come together in one row.

    pos is unique in an image and class, as there.
    """
    edges = edges_of(predictions, references, tried)
    pairs = assigned(edges.where(F.col("iou") >= overlap), rounds).select(*GROUP, F.col("pos").alias("pred_pos"), F.col("ref").alias("ref_pos"), F.col("iou").alias("matched_iou"))
    best = edges.groupBy(*GROUP, F.col("pos").alias("pred_pos")).agg(F.max("iou").alias("best_iou"))
    p = predictions.select(*GROUP, F.col("pos").cast("long").alias("pred_pos"), F.col("score").cast("long").alias("score"))
    t = p.join(best, [*GROUP, "pred_pos"], "left").join(pairs, [*GROUP, "pred_pos"], "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))
    reason = F.when(F.col("ref_pos").isNotNull(), "matched").when(F.col("best_iou") >= overlap, "duplicate").when(F.col("best_iou") > 0, "insufficient_overlap").otherwise("no_overlap")
    return t.select(*GROUP, "pred_pos", "score", "ref_pos", reason.alias("reason"), "best_iou", "matched_iou")


def crop_conflicts(crops: DataFrame, boxes: DataFrame, tried: int = TRIED) -> DataFrame:
    """crop_id of crops (crop_id, image, box) whose interior meets a box of their image (JN-09)."""
    return meeting_pairs(crops.select("image", "crop_id", "box"), boxes.select("image", "box"), ["image"], tried).select("a.crop_id").distinct()


def lost_areas(detections: DataFrame, regions: DataFrame, tried: int = TRIED) -> DataFrame:
    """analysis, idx, lost: the area that disjoint lost regions (analysis, box) take from each detection (analysis, idx, box) that meets one (JN-14)."""
    pairs = meeting_pairs(detections.select("analysis", "idx", "box"), regions.select("analysis", "box"), ["analysis"], tried)
    wide = lambda low, high: F.least(F.col(f"a.box.{high}"), F.col(f"b.box.{high}")) - F.greatest(F.col(f"a.box.{low}"), F.col(f"b.box.{low}"))
    return pairs.groupBy("analysis", F.col("a.idx").alias("idx")).agg(F.sum(wide("x1", "x2") * wide("y1", "y2")).alias("lost"))
