"""Evaluations against masks: of an external source, of photos seen through windows, and of patches without outlines (AG-06, AG-18, AG-20, ENG-04, PRJ-21, SRC-19, WN-07, WN-11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions import images as im
from girder.functions import masks
from girder.functions.geometry import shifted
from girder.functions.rules import refuse
from girder.operators import coverage, integrity, matching, runs
from girder.shared import staged


def mask_lengths(files: DataFrame) -> DataFrame:
    """id, problem, height, width, foreground, runs of prepared mask files (id, head, pixels): one channel, nothing but 0 and 255.

    One Arrow stage from decoded bytes to run lengths; a worker holds one mask's pixels.
    """
    kind = dict(files.dtypes)["id"]
    fields = {"problem": pa.string(), "height": pa.int32(), "width": pa.int32(), "foreground": pa.int64(), "runs": pa.list_(pa.int64())}

    def one(head: bytes | None, pixels: dict | None) -> dict:
        h = im.photo_header(head or b"")
        if h.form != "png" or h.channels != 1 or h.bits != 8:
            return {"problem": "unsupported_mask"}
        if pixels is None or (pixels["width"], pixels["height"]) != (h.width, h.height):
            return {"problem": "not_decoded"}
        a = np.frombuffer(pixels["data"], np.uint8).reshape(pixels["height"], pixels["width"], pixels["nChannels"])[..., 0]
        if not ((a == 0) | (a == 255)).all():
            return {"problem": "not_binary"}
        lengths = masks.encode(a == 255)
        return {"height": h.height, "width": h.width, "foreground": masks.area(lengths), "runs": lengths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(head.as_py(), pixels.as_py()) for head, pixels in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(c) for r in rows], t) for c, t in fields.items()]], ["id", *fields])

    return files.select("id", "head", "pixels").mapInArrow(run, f"id {kind}, problem string, height int, width int, foreground long, runs array<long>")


def reference_runs(files: DataFrame, records: DataFrame) -> DataFrame:
    """id, start, stop of the masks of records (id, width, height, mask_sha256, foreground_pixels), which must be what the records say.

    files: (id, sha256, head, pixels), those of the records' masks.
    """
    read = staged(mask_lengths(files).join(files.select("id", "sha256"), "id"), "masks")
    t = records.join(read.withColumnsRenamed({"height": "h", "width": "w"}), "id", "left")
    problem = (
        F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("mask_sha256"), "changed").when(F.col("problem").isNotNull(), F.col("problem"))
        .when((F.col("w") != F.col("width")) | (F.col("h") != F.col("height")), "other_size").when(F.col("foreground") != F.col("foreground_pixels"), "other_foreground")
    )
    refuse(t.select("id", problem.alias("problem")).where("problem is not null"), "reference masks are not what their records say")
    return runs.length_runs(read.join(records.select("id"), "id", "left_semi"), ["id"])


def proposal_runs(proposals: DataFrame, width: Column, height: Column, chains: bool = False, first: bool = True) -> DataFrame:
    """The runs of proposals (.., runs) whose masks must cover their image or window exactly; the other columns stay.

    The masks are all checked first, in a job of their own, or else as they are read, so that what makes them is done once: one that does not match then fails the job.
    """
    rule, rest = "a mask does not match its window", [c for c in proposals.columns if c != "runs"]
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x)
    good = F.coalesce((whole == width * height) & F.forall("runs", lambda x: x >= 0), F.lit(False))
    if first:
        refuse(proposals.where(~good).select(*rest), rule)
    else:
        proposals = proposals.withColumn("runs", F.when(good, F.col("runs")).otherwise(F.raise_error(F.concat(F.lit(f"{rule}: "), F.to_json(F.struct(*rest))))))
    return runs.length_runs(proposals, rest, chains=chains)


def external_evaluation(records: DataFrame, references: DataFrame, proposals: DataFrame, class_: str, shown: int) -> tuple[DataFrame, DataFrame]:
    """A row for every record (id, content_group, width, height) with its proposals and pixels, and the totals of the class.

    references: runs (id, start, stop); proposals: (id, class, score, runs). Only the class counts, and of it what reaches the threshold is shown: such proposals are
    united before they are measured, so two on one place are one.
    """
    own = staged(proposals.where(F.col("class") == class_).join(records.select("id", "width", "height"), "id"), "proposals")
    shown_runs = proposal_runs(own.where(F.col("score") >= shown).select("id", "width", "height", "runs"), F.col("width"), F.col("height")).select("id", "start", "stop")
    measured = runs.coverage(references, shown_runs, ["id"])
    counts = own.groupBy("id").agg(F.count(F.lit(1)).alias("proposals"), F.count_if(F.col("score") >= shown).alias("retained_proposals"))
    zero = ["proposals", "retained_proposals", "reference_pixels", "proposal_pixels", "shared_pixels"]
    details = records.select("id", "content_group").join(counts, "id", "left").join(measured, "id", "left").na.fill(0, zero)
    details = staged(details.withColumns({"expected": F.coalesce("expected", F.lit(False)), "signalled": F.coalesce("signalled", F.lit(False)), "class": F.lit(class_)}), "details")
    return details.drop("class"), coverage.coverage_totals(details, details.count())


def windowed_runs(windows: DataFrame, shown: int, first: bool = True) -> DataFrame:
    """image, class, start, stop, step, times: the runs of the windows' proposals in the whole photo.

    windows: proposals (image, image_width, image_height, x, y, width, height, class, score, runs) in the place of their window. A proposal below the threshold
    is left out before any union, as a union has no score of its own. first: see ``proposal_runs``.
    """
    kept = windows.where(F.col("score") >= shown).drop("score", "box")
    local = proposal_runs(kept, F.col("width"), F.col("height"), chains=True, first=first)
    whole = runs.placed(local, F.col("height"), F.col("x"), F.col("y"), F.col("image_height"), F.col("image_width"))
    return whole.select("image", "class", "start", "stop", *runs.CHAIN)


def windowed_zones(windows: DataFrame, shown: int) -> DataFrame:
    """image, class, start, stop: the zone that the windows' proposals cover in the whole photo."""
    return runs.united(windowed_runs(windows, shown), ["image", "class"])


def windowed_evaluation(references: DataFrame, windows: DataFrame, n_images: int, shown: int, overlap: float = 0.3) -> dict[str, DataFrame]:
    """zones, coverage of each image and class, totals, and the proposals' boxes (window boxes, where given) merged in the whole photo.

    references: runs (image, class, start, stop).
    """
    zones = staged(windowed_zones(windows, shown), "zones")
    each = staged(runs.coverage(references, zones, ["image", "class"]), "coverage")
    out = {"zones": zones, "coverage": each, "totals": coverage.coverage_totals(each, n_images)}
    if "box" in windows.columns:
        whole = windows.where(F.col("score") >= shown).select("image", "class", "score", "pos", shifted(F.col("box"), F.col("x"), F.col("y")).alias("box"))
        out["proposals"] = matching.merge_proposals(whole, overlap)
    return out


def patch_alerts(patches: DataFrame, proposals: DataFrame, class_: str, shown: int) -> tuple[DataFrame, DataFrame]:
    """Alerts of every patch (patch, grp, arm), and the rate of patches with one in each arm.

    proposals: (patch, class, score). There is no outline to measure: what counts is whether a patch has a proposal, and the cracked arm is there to say what a rate of
    none among the clear ones is worth. A proposal of a patch that is not in the sample is refused.
    """
    refuse(proposals.join(patches, "patch", "left_anti").select("patch"), "proposals of an unknown patch")
    own = proposals.where((F.col("class") == class_) & (F.col("score") >= shown)).groupBy("patch").agg(F.count(F.lit(1)).alias("alerts"))
    each = patches.select("patch").join(own, "patch", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    return each, integrity.alert_rates(patches, each)[0]
