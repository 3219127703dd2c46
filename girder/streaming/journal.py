"""An append-only journal of reviews and the state it replays to (EV-02, EV-03, AG-25).

Batch replay is windows over (analysis, finding); the streaming form keeps each finding's state in
``applyInPandasWithState`` and gives the same rows, event by event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators.requests import KINDS

NO_CORRECTION = "not_assessed"


def all_findings(findings: DataFrame, events: DataFrame) -> DataFrame:
    """(analysis, finding, class, since) of the findings there are, and of those that manual events add at their revision."""
    added = events.where("kind = 'manual'").groupBy("analysis", "finding").agg(F.min_by("class", "revision").alias("class"), F.min("revision").alias("since"))
    return findings.select("analysis", "finding", "class", F.lit(0).cast("long").alias("since")).unionByName(added)


def violations(events: DataFrame, findings: DataFrame | None = None, analyses: DataFrame | None = None) -> DataFrame:
    """analysis, revision, problem of journal rows (analysis, revision, request_id, kind, finding, decision, class, recorded_at, occurred_at).

    Revisions count from 1 without a gap, times never go back, nothing is recorded before the analysis (analyses: analysis, analysed_at), an
    observation is not later than its record, request ids are unique, a class stands only with a confirmation, and an event's finding
    (findings: analysis, finding, class) is one of the analysis or was added before.
    """
    by = Window.partitionBy("analysis").orderBy("revision", "recorded_at")
    t = events.withColumns({
        "want": F.row_number().over(by),
        "before": F.lag("recorded_at").over(by),
        "uses": F.count(F.lit(1)).over(Window.partitionBy("analysis", "request_id")),
    })
    t = t.join(analyses.select("analysis", "analysed_at"), "analysis", "left") if analyses is not None else t.withColumn("analysed_at", F.lit(None).cast("timestamp"))
    absent = F.lit(False)
    if findings is not None:
        known = all_findings(findings, events).groupBy("analysis", "finding").agg(F.min("since").alias("since"))
        t = t.join(known, ["analysis", "finding"], "left")
        absent = F.coalesce(F.col("revision") < F.col("since"), F.lit(True))
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown_kind")
        .when(F.col("revision") != F.col("want"), "broken_sequence")
        .when(F.col("recorded_at") < F.col("analysed_at"), "before_analysis")
        .when(F.col("recorded_at") < F.col("before"), "time_goes_back")
        .when(F.col("occurred_at") > F.col("recorded_at"), "observed_after_recording")
        .when(F.col("uses") > 1, "repeated_request")
        .when((F.col("kind") == "review") & F.col("class").isNotNull() & (F.col("decision") != "confirmed"), "class_without_confirmation")
        .when(absent, "unknown_finding")
    )
    return t.select("analysis", "revision", problem.alias("problem")).where("problem is not null")


def replay(findings: DataFrame, events: DataFrame) -> DataFrame:
    """analysis, finding, state, effective_class, correction, n_notes, n_reviews, refused of every finding (analysis, finding, class).

    A manual event adds a finding, and is its first note; what names a finding earlier than it was added has no effect. A review overwrites
    the last one; where its decision or the class it leaves in force differs from the
    last, an earlier correction is void. A correction counts only while the finding is confirmed, and is refused else.
    """
    by = Window.partitionBy("analysis", "finding").orderBy("revision")
    until = by.rowsBetween(Window.unboundedPreceding, -1)
    every = all_findings(findings, events)
    e = events.join(every.withColumnRenamed("class", "own_class"), ["analysis", "finding"]).where("revision >= since")
    review = F.col("kind") == "review"
    e = e.withColumn("effective", F.when(review, F.coalesce("class", "own_class")))
    e = e.withColumns({"was": F.last(F.when(review, F.col("decision")), True).over(until), "was_class": F.last("effective", True).over(until)})
    resets = review & (~F.col("decision").eqNullSafe(F.col("was")) | ~F.col("effective").eqNullSafe(F.col("was_class")))
    valid = (F.col("kind") == "correction") & F.col("was").eqNullSafe(F.lit("confirmed"))
    s = e.groupBy("analysis", "finding").agg(
        F.max_by("decision", F.when(review, F.col("revision"))).alias("state"),
        F.max_by("effective", F.when(review, F.col("revision"))).alias("effective_class"),
        F.max(F.when(resets, F.col("revision"))).alias("reset"),
        F.max(F.when(valid, F.col("revision"))).alias("corrected"),
        F.max_by("status", F.when(valid, F.col("revision"))).alias("status"),
        F.count_if(F.col("kind").isin("note", "manual")).alias("n_notes"),
        F.count_if(review).alias("n_reviews"),
        F.count_if((F.col("kind") == "correction") & ~valid).alias("refused"),
    )
    t = every.select("analysis", "finding").join(s, ["analysis", "finding"], "left")
    standing = F.col("corrected") > F.coalesce("reset", F.lit(0))
    return t.select(
        "analysis", "finding", F.coalesce("state", F.lit("proposed")).alias("state"), "effective_class",
        F.when(standing, F.col("status")).otherwise(F.lit(NO_CORRECTION)).alias("correction"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_notes", "n_reviews", "refused")],
    )


def appended(journal: DataFrame, requests: DataFrame) -> DataFrame:
    """analysis, request_id, outcome of requests (analysis, request_id, digest, expected_revision) against the journal (analysis, revision, request_id, digest).

    The same request with the same content is a no-op, with other content a conflict; a request made on
    an older revision than the journal's is stale; else it is appended. With a column ``turn``, an analysis's requests are
    taken in that order, each against what those before it have appended, by a fold over the analysis's requests of the batch.
    """
    last = journal.groupBy("analysis").agg(F.max("revision").alias("last"))
    known = journal.select("analysis", "request_id", F.col("digest").alias("known"))
    t = requests.join(known, ["analysis", "request_id"], "left").join(last, "analysis", "left").withColumn("last", F.coalesce("last", F.lit(0)).cast("long"))
    verdict = lambda known, digest, expected, last: F.when(known == digest, "no_op").when(known.isNotNull(), "conflict").when(expected != last, "stale").otherwise("append")
    if "turn" not in requests.columns:
        return t.select("analysis", "request_id", verdict(F.col("known"), F.col("digest"), F.col("expected_revision"), F.col("last")).alias("outcome"))
    one = F.struct("turn", "request_id", "digest", F.col("expected_revision").cast("long").alias("expected"), "known")
    line = t.groupBy("analysis", "last").agg(F.array_sort(F.collect_list(one)).alias("line"))
    start = F.struct(F.col("last").alias("last"), F.create_map().cast("map<string,string>").alias("taken"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        known = F.coalesce(x["known"], F.try_element_at(a["taken"], x["request_id"]))
        said = verdict(known, x["digest"], x["expected"], a["last"])
        new = said == "append"
        taken = F.when(new, F.map_concat(a["taken"], F.create_map(x["request_id"], x["digest"]))).otherwise(a["taken"])
        return F.struct((a["last"] + new.cast("long")).alias("last"), taken.alias("taken"), F.concat(a["out"], F.array(said)).alias("out"))

    done = line.withColumn("out", F.aggregate("line", start, step)["out"])
    each = done.select("analysis", F.inline(F.arrays_zip("line", "out")))
    return each.select("analysis", F.col("line.request_id").alias("request_id"), F.col("out").alias("outcome"), F.col("line.turn").alias("turn"))


STATE = "state string, effective_class string, correction string, n_notes long, n_reviews long, refused long"


def apply_event(state: tuple, kind: str, decision: str | None, effective: str | None, status: str | None) -> tuple:
    """The state of one finding after one more event."""
    verdict, in_force, correction, notes, reviews, refused = state
    if kind == "review":
        if decision != verdict or effective != in_force:
            correction = NO_CORRECTION
        return decision, effective, correction, notes, reviews + 1, refused
    if kind == "correction":
        ok = verdict == "confirmed"
        return verdict, in_force, status if ok else correction, notes, reviews, refused + (not ok)
    return verdict, in_force, correction, notes + 1, reviews, refused


def replay_stream(events: DataFrame) -> DataFrame:
    """The same states from a stream of journal rows with each finding's own_class; a row for each finding that a batch touches."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("proposed", None, NO_CORRECTION, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("revision")
        for r in rows.itertuples():
            chosen = r[rows.columns.get_loc("class") + 1]
            effective = chosen if isinstance(chosen, str) else r.own_class
            state = apply_event(tuple(state), r.kind, r.decision, effective, r.status)
        held.update(state)
        yield pd.DataFrame([(*key, *state)], columns=["analysis", "finding", *(x.split()[0] for x in STATE.split(", "))])

    return events.groupBy("analysis", "finding").applyInPandasWithState(advance, f"analysis long, finding long, {STATE}", STATE, "update", "NoTimeout")


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: events of each kind in tumbling windows of time, with a watermark for late rows."""
    t = events.withWatermark("recorded_at", late) if events.isStreaming else events
    w = t.groupBy(F.window("recorded_at", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "kind", "n")
