"""Masks as tables of runs (AG-06, AG-20, PRJ-17 to 19, PRJ-21).

A mask is rows (its key, start, stop): half-open intervals of pixels numbered column by column, as in run-length masks. Unions, intersections and areas
come from one sweep over events: a run adds one to its side's depth at its start and takes one at its stop. A row may stand for ``times`` runs, each ``step`` pixels
after the one before, so a box is one row wherever rows are shuffled and sorted; its runs are made in the sweep, batch by batch, and are never rows of Spark.
Runs are cut at multiples of ``BLOCK`` pixels, so a giant image is many tasks' work, and what a cut has split is joined by a second sweep over the
runs at the cuts alone. No pixel is ever a row or a bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def box_runs(table: DataFrame, by: list[str], height: Column, box: str = "box") -> DataFrame:
    """by, start, stop, step, times: a row for every box, a run for each of its columns; corners are whole, and boxes without area have none."""
    b = F.col(box)
    sides = table.select(*by, height.cast("long").alias("_h"), b["y1"].cast("long").alias("_y1"), b["y2"].cast("long").alias("_y2"), b["x1"].cast("long").alias("_x1"), b["x2"].cast("long").alias("_x2")).where("_x1 < _x2 and _y1 < _y2")
    # A box as tall as the image is one run.
    tall = (F.col("_y1") == 0) & (F.col("_y2") == F.col("_h"))
    last = F.when(tall, F.col("_x2") - 1).otherwise(F.col("_x1"))
    return sides.select(*by, (F.col("_x1") * F.col("_h") + F.col("_y1")).alias("start"), (last * F.col("_h") + F.col("_y2")).alias("stop"), F.when(tall, 0).otherwise(F.col("_h")).cast("long").alias("step"), F.when(tall, 1).otherwise(F.col("_x2") - F.col("_x1")).cast("long").alias("times"))


def strided(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which runs begin a chain of equally long and equally distant runs of one row, how far apart those are, and how many."""
    apart = np.diff(start)
    link = (row[1:] == row[:-1]) & (np.diff(stop) == apart)
    link[1:] &= ~(link[:-1] & (apart[1:] != apart[:-1]))
    first = np.flatnonzero(np.r_[True, ~link][: len(start)])
    times = np.diff(np.r_[first, len(start)])
    return first, np.where(times > 1, np.r_[apart, 0][first], 0) if len(first) else times, times


def length_runs(masks: DataFrame, by: list[str], lengths: str = "runs", chains: bool = False) -> DataFrame:
    """by, start, stop of masks given by run lengths, the first run empty; with chains, rows of several runs each: by, start, stop, step, times."""
    kinds = dict(masks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(by)
            lists = batch.column(len(by))
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(lists.flatten().to_numpy().astype(np.int64))
            before = np.r_[0, ends][np.cumsum(many) - many]  # pixels of all masks before
            row = np.repeat(np.arange(len(many)), many)
            odd = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) % 2 == 1
            start, stop = np.r_[0, ends][:-1][odd] - before[row[odd]], ends[odd] - before[row[odd]]
            full = start < stop
            row, start, stop = row[odd][full], start[full], stop[full]
            more = []
            if chains:
                first, step, times = strided(row, start, stop)
                row, start, stop, more = row[first], start[first], stop[first], [pa.array(step), pa.array(times)]
            out = keys.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(start), pa.array(stop), *more], [*by, "start", "stop", "step", "times"][: len(by) + 2 + len(more)])

    return masks.select(*by, lengths).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", start long, stop long" + (", step long, times long" if chains else ""))


def run_lengths(runs: DataFrame, masks: DataFrame, by: list[str], pixels: str = "pixels") -> DataFrame:
    """by, runs: run lengths again of disjoint runs, for every row of masks (by, pixels); one without runs is a single empty run.

    A mask's runs come together in one row, as its document has them.
    """
    lists = runs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("r"))
    t = masks.select(*by, F.col(pixels).cast("long").alias("_all")).join(lists, by, "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<start:bigint,stop:bigint>>")))
    edges = F.concat(F.flatten(F.transform("r", lambda x: F.array(x["start"], x["stop"]))), F.array("_all"))
    lengths = F.transform(edges, lambda e, i: e - F.when(i > 0, F.get(edges, i - 1)).otherwise(F.lit(0)))
    # A mask that ends with the image has no empty run after it.
    cut = F.when((F.size(lengths) > 1) & (F.element_at(lengths, -1) == 0), F.slice(lengths, 1, F.size(lengths) - 1)).otherwise(lengths)
    return t.select(*by, F.when(F.col("_all") == 0, F.array().cast("array<bigint>")).otherwise(cut).alias("runs"))


CHAIN = ["step", "times"]


def placed(runs: DataFrame, height: Column, x: Column, y: Column, canvas_height: Column, canvas_width: Column) -> DataFrame:
    """Runs of windows (.., start, stop) of a height at an offset as runs of the canvas, cut at its edges; the other columns stay.

    Rows of several runs (step, times) stay such rows where the runs stand side by side in columns of the window.
    """
    keys, chains = [c for c in runs.columns if c not in ("start", "stop", *CHAIN)], "times" in runs.columns
    h = height.cast("long")
    t = runs.withColumns({"_h": h, "_x": x.cast("long"), "_y": y.cast("long"), "_ch": canvas_height.cast("long"), "_cw": canvas_width.cast("long"), "_n": F.lit(1).cast("long")})
    if chains:
        beside = F.expr("step = _h and start div _h = (stop - 1) div _h")
        t = t.withColumn("_n", F.when(beside, F.col("times")).otherwise(1)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - F.col("_n"))))
        t = t.withColumns({"start": F.col("start") + F.col("_i") * F.col("step"), "stop": F.col("stop") + F.col("_i") * F.col("step")})
    # A run may go through several columns of its window.
    t = t.withColumn("_c", F.explode(F.sequence(F.expr("start div _h"), F.expr("(stop - 1) div _h"))))
    top = F.greatest(F.col("start") - F.col("_c") * F.col("_h"), F.lit(0)) + F.col("_y")
    bottom = F.least(F.col("stop") - F.col("_c") * F.col("_h"), F.col("_h")) + F.col("_y")
    left = F.col("_c") + F.col("_x")
    t = t.withColumns({"_top": F.greatest(top, F.lit(0)), "_bottom": F.least(bottom, F.col("_ch")), "_at": F.greatest(left, F.lit(0)), "_end": F.least(left + F.col("_n"), F.col("_cw"))})
    t = t.where("_top < _bottom and _at < _end")
    more = [F.col("_ch").alias("step"), (F.col("_end") - F.col("_at")).alias("times")] if chains else []
    return t.select(*keys, (F.col("_at") * F.col("_ch") + F.col("_top")).alias("start"), (F.col("_at") * F.col("_ch") + F.col("_bottom")).alias("stop"), *more)


#: Runs that a task sweeps at a time, besides those of one block.
AT_ONCE = 1 << 19


def expanded(rows: np.ndarray, block: int) -> np.ndarray:
    """The runs of rows (group, block, start, stop, step, times, sides) that lie in the row's block: group, block, start, stop, 0, 1, sides."""
    group, at, start, stop, step, times, sides = rows.T
    low, high, by = at * block, (at + 1) * block, np.maximum(step, 1)
    first = np.where(times > 1, np.maximum((low - stop) // by + 1, 0), 0)
    many = np.maximum(np.where(times > 1, np.minimum((high - 1 - start) // by + 1, times), 1) - first, 0)
    i = np.repeat(np.arange(len(rows)), many)
    k = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
    out = rows[i]
    out[:, 2], out[:, 3] = np.maximum(start[i] + k * step[i], low[i]), np.minimum(stop[i] + k * step[i], high[i])
    out[:, 4], out[:, 5] = 0, 1
    return out[out[:, 2] < out[:, 3]]


def swept(rows: np.ndarray, block: int, sides: int) -> np.ndarray:
    """The pieces of runs as ``expanded`` has them, in which the same sides lie, those that touch and are alike made one."""
    n = len(rows)
    if not n:
        return rows
    place = np.concatenate([rows[:, 2], rows[:, 3]]) - np.tile(rows[:, 1], 2) * block + np.tile(rows[:, 0], 2) * (block + 1)
    order = np.argsort(place)
    place, row = place[order], order % n
    step = np.where(order < n, 1, -1)
    last = np.r_[place[1:] != place[:-1], True]
    depth = [np.cumsum(step * ((rows[row, 6] >> k) & 1))[last] > 0 for k in range(sides)]
    inside = sum(d.astype(np.int64) << k for k, d in enumerate(depth))
    # Every group begins and ends with no side, so what touches is of one group.
    fresh = np.r_[True, inside[1:] != inside[:-1]]
    place, row, inside = place[last][fresh], row[last][fresh], inside[fresh]
    begins = np.flatnonzero(inside[:-1])
    out = rows[row[begins]]
    shift = out[:, 1] * block - out[:, 0] * (block + 1)
    out[:, 2], out[:, 3], out[:, 6] = place[begins] + shift, place[begins + 1] + shift, inside[begins]
    return out


def sweep(runs: DataFrame, by: list[str], sides: dict[str, Column], sums: bool = False) -> DataFrame:
    """by, _block, start, stop, _sides (bits) of ``segments``; with sums, by and the pixels of the first side, the second and both in a block.

    One shuffle of the rows as they are. A task holds a batch, and of one block what its runs so far have united to.
    """
    if "times" not in runs.columns:
        runs = runs.withColumns({"step": F.lit(0).cast("long"), "times": F.lit(1).cast("long")})
    mark = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(sides.values())), F.lit(0))
    last = F.expr(f"(stop - 1 + (times - 1) * step) div {BLOCK}")
    t = runs.where("start < stop").select(*by, F.explode(F.sequence(F.expr(f"start div {BLOCK}"), last)).alias("_block"), *[F.col(c).cast("long").alias(c) for c in ("start", "stop", *CHAIN)], mark.cast("long").alias("_sides"))
    key, block, at_once, many = [*by, "_block"], BLOCK, AT_ONCE, len(sides)
    t = t.repartition(*key).sortWithinPartitions(*key)
    names = ["_one", "_two", "_both"] if sums else ["_block", "start", "stop", "_sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, held_names = np.zeros((0, 7), np.int64), None, None

        def results(pieces: np.ndarray, keys: pa.RecordBatch) -> pa.RecordBatch:
            if sums:
                groups, starts = np.unique(pieces[:, 0], return_index=True)
                wide = pieces[:, 3] - pieces[:, 2]
                columns = [np.add.reduceat(np.where(pieces[:, 6] & k == k, wide, 0), starts) for k in (1, 2, 3)] if len(groups) else [groups] * 3
            else:
                groups, columns = pieces[:, 0], [pieces[:, k] for k in (1, 2, 3, 6)]
            return pa.RecordBatch.from_arrays([*keys.take(pa.array(groups)).columns, *[pa.array(c) for c in columns]], [*by, *names])

        for batch in batches:
            cost = np.cumsum(batch.column(len(by) + 4).to_numpy())
            cuts = np.unique(np.r_[np.searchsorted(cost, np.arange(0, cost[-1] if len(cost) else 0, at_once)), batch.num_rows])
            for low, high in zip(np.r_[0, cuts], cuts, strict=False):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                fresh = np.zeros(part.num_rows, bool)
                for c in part.columns[: len(key)]:
                    code = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                    fresh[1:] |= code[1:] != code[:-1]
                # Group 0 is that of the rows before.
                first_key = [c[0].as_py() for c in part.columns[: len(key)]]
                group = np.cumsum(fresh) + (first_key != held_key)
                numbers = [c.to_numpy() for c in part.columns[len(by) :]]
                rows = np.concatenate([held, np.stack([group, *numbers], axis=1)])
                keys = part.select(by)
                firsts = keys.take(pa.array(np.flatnonzero(np.r_[True, fresh[1:]])))
                if held_names is not None and first_key != held_key:
                    firsts = pa.Table.from_batches([held_names, firsts]).combine_chunks().to_batches()[0]
                elif held_names is None:
                    rows[:, 0] -= 1
                    group = group - 1
                pieces = swept(expanded(rows, block), block, many)
                open_ = pieces[:, 0] == group[-1]
                if (~open_).any():
                    yield results(pieces[~open_], firsts)
                held = pieces[open_]
                held[:, 0] = 0
                held_key, held_names = [c[-1].as_py() for c in part.columns[: len(key)]], firsts.slice(int(group[-1]), 1)
        if len(held):
            yield results(held, held_names)

    kinds = dict(t.dtypes)
    return t.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + "".join(f", {c} long" for c in names))


def segments(runs: DataFrame, by: list[str], sides: dict[str, Column]) -> DataFrame:
    """by, _block, start, stop and a boolean for each side: the pieces of a block in which the same sides lie; sides say which runs are theirs."""
    t = sweep(runs, by, sides)
    return t.select(*by, "_block", "start", "stop", *[(F.col("_sides").bitwiseAND(1 << i) != 0).alias(c) for i, c in enumerate(sides)])


def joined(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, start, stop: disjoint pieces that touch made one."""
    line = Window.partitionBy(*by).orderBy("start")
    t = pieces.withColumn("_fresh", F.coalesce(F.col("start") > F.lag("stop").over(line), F.lit(True)))
    t = t.withColumn("_run", F.count_if("_fresh").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def whole_runs(pieces: DataFrame, by: list[str]) -> DataFrame:
    """by, start, stop of pieces (by, _block, start, stop) that touch no other in their block: those that end at a cut are joined with each other."""
    at_cut = ((F.col("start") > 0) & (F.col("start") % BLOCK == 0)) | (F.col("stop") % BLOCK == 0)
    own = pieces.select(*by, "start", "stop")
    return own.where(~at_cut).unionByName(joined(own.where(at_cut), by))


def united(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, start, stop: the union of all runs of a key, disjoint and not touching."""
    return whole_runs(segments(runs, by, {"_in": F.lit(True)}), by)


def intersected(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, start, stop: what the union of a's runs of a key shares with that of b's."""
    return whole_runs(segments(both_sides(a, b, by), by, {"_a": F.col("_side") == 0, "_b": F.col("_side") == 1}).where("_a and _b"), by)


def both_sides(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    chain = lambda t: [(F.col(c) if c in t.columns else F.lit(k)).cast("long").alias(c) for k, c in enumerate(CHAIN)]
    one, two = (t.select(*by, "start", "stop", *chain(t), F.lit(k).alias("_side")) for k, t in enumerate((a, b)))
    return one.unionByName(two)


def coverage(references: DataFrame, proposals: DataFrame, by: list[str]) -> DataFrame:
    """by, reference_pixels, proposal_pixels, shared_pixels, expected, signalled of two tables of runs, by one sweep (AG-06 on masks)."""
    t = sweep(both_sides(references, proposals, by), by, {"_a": F.col("_side") == 0, "_b": F.col("_side") == 1}, sums=True)
    sums = t.groupBy(*by).agg(F.sum("_one").alias("reference_pixels"), F.sum("_two").alias("proposal_pixels"), F.sum("_both").alias("shared_pixels"))
    return sums.withColumns({"expected": F.col("reference_pixels") > 0, "signalled": F.col("proposal_pixels") > 0})


def class_overlaps(runs: DataFrame, by: list[str], class_: str, one: object, two: object) -> DataFrame:
    """by, shared, share: pixels that two classes of a key have in common and their part of the smaller one, null if that is empty (PRJ-17)."""
    sums = coverage(runs.where(F.col(class_) == F.lit(one)), runs.where(F.col(class_) == F.lit(two)), by)
    least = F.least("reference_pixels", "proposal_pixels")
    return sums.select(*by, F.col("shared_pixels").alias("shared"), F.when(least > 0, F.col("shared_pixels") / least).alias("share"))


def overlaps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, iou of two tables of runs; keys with no pixel on either side have none."""
    sums = coverage(a, b, by)
    return sums.select(*by, (F.col("shared_pixels") / (F.col("reference_pixels") + F.col("proposal_pixels") - F.col("shared_pixels"))).alias("iou"))
