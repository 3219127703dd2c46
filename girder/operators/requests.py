"""Requests to a journal of findings and the findings that people add (EV-01, EV-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.categories import family, is_class, label
from girder.functions.rules import is_finite, is_hex, is_text, utc_text

#: Fixed values.
KINDS = ("manual", "review", "correction", "note")
DECISIONS = ("confirmed", "rejected", "indeterminate")
CORRECTIONS = ("planned", "in_progress", "resolved", "not_required")
MOST_PROOFS, NOTE, REQUEST_ID, SEVERITY = 4, 4000, 128, 500

#: The payload's columns and the kinds that may have them, besides the note that all have.
PAYLOAD = {"decision": ("review",), "class": ("manual", "review"), "task": ("review",), "severity": ("review",), "status": ("correction",), "evidence": ("correction",), "box": ("manual",)}


def problem(r: dict[str, Column]) -> Column:
    """The first rule that a request breaks, null if none: r has its columns by name.

    A manual report has no finding yet, all others name one. Class, task and severity stand only with a confirmation; a
    correction has up to four different proofs, and at least one if it says resolved.
    """
    is_ = lambda kind: r["kind"] == kind
    given = lambda name: r[name].isNotNull()
    known = lambda name, values: F.coalesce(r[name].isin(*values), F.lit(False))
    proofs = F.coalesce(r["evidence"], F.array().cast("array<string>"))
    corners = F.coalesce((F.size(r["box"]) == 4) & F.forall(r["box"], is_finite), F.lit(False))
    stray = F.lit(False)
    for name, kinds in PAYLOAD.items():
        stray = stray | (given(name) & ~r["kind"].isin(*kinds))
    return (
        F.when(~known("kind", KINDS), "unknown_kind")
        .when(stray, "unknown_field")
        .when(is_("manual") & given("finding"), "finding_given")
        .when(~is_("manual") & ~is_hex(r["finding"], 32), "bad_finding")
        .when(is_("manual") & ~is_class(r["class"]), "unknown_class")
        .when(is_("manual") & ~corners, "bad_box")
        .when(is_("review") & ~known("decision", DECISIONS), "unknown_decision")
        .when(is_("review") & given("class") & ~is_class(r["class"]), "unknown_class")
        .when(given("task") & ~is_text(r["task"]), "bad_task")
        .when(given("severity") & ~is_text(r["severity"], SEVERITY), "bad_severity")
        .when(is_("review") & (r["decision"] != "confirmed") & (given("class") | given("task") | given("severity")), "needs_confirmation")
        .when(is_("correction") & ~known("status", CORRECTIONS), "unknown_status")
        .when(is_("correction") & ~given("evidence"), "bad_evidence")
        .when((F.size(proofs) > MOST_PROOFS) | F.exists(proofs, lambda x: ~is_hex(x, 64)), "bad_evidence")
        .when(F.size(F.array_distinct(proofs)) < F.size(proofs), "repeated_evidence")
        .when(is_("correction") & (r["status"] == "resolved") & (F.size(proofs) == 0), "needs_evidence")
        .when(~is_text(r["note"], NOTE), "bad_note")
        .when(~is_text(r["request_id"], REQUEST_ID), "bad_request_id")
        .when(~is_text(r["actor"]), "bad_actor")
        .when(given("occurred_at") & utc_text(r["occurred_at"]).isNull(), "bad_time")
    )


def checked_requests(requests: DataFrame) -> DataFrame:
    """All columns of requests, times of observation as UTC text, and the problem of those that break a rule.

    requests: request_id, kind, finding, actor, decision, class, task, severity, status, evidence (array), box (array), note,
    occurred_at (text); columns that a kind does not have are null.
    """
    names = ("request_id", "kind", "finding", "actor", "note", "occurred_at", *PAYLOAD)
    return requests.withColumns({"problem": problem({n: F.col(f"`{n}`") for n in names}), "occurred_at": utc_text(F.col("occurred_at"))})


def identity(*parts: Column) -> Column:
    """32 hex digits that name a finding: of the digest of the parts as a JSON list."""
    return F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 32)


def manual_findings(requests: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings that sound manual requests add, and (analysis, request_id, problem) of those that lie outside their photo.

    requests: of ``checked_requests`` with analysis and recorded_at; analyses: analysis, photo_sha256, width, height. A person's finding
    has neither score nor severity, and begins as proposed.
    """
    b = [F.get("box", F.lit(i)) for i in range(4)]
    t = requests.where("kind = 'manual' and problem is null").join(analyses, "analysis")
    empty = (b[0] >= b[2]) | (b[1] >= b[3])
    outside = (F.array_min("box") < 0) | (b[2] > F.col("width")) | (b[3] > F.col("height"))
    t = t.withColumn("problem", F.when(empty, "empty_box").when(outside, "outside_photo"))
    size = [F.col("width"), F.col("height")] * 2
    found = t.where("problem is null").select(
        "analysis", identity(F.col("analysis").cast("string"), F.col("request_id"), F.lit("manual")).alias("finding"), F.lit("human").alias("origin"), F.lit("proposed").alias("state"),
        "class", family(F.col("class")).alias("family"), label(F.col("class")).alias("label"), "box", F.array(*[x / n for x, n in zip(b, size, strict=True)]).alias("box_normalized"),
        "width", "height", "photo_sha256", "actor", "recorded_at", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("severity"),
    )
    return found, t.where("problem is not null").select("analysis", "request_id", "problem")
