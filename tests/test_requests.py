"""Requests to the journal, findings added by hand, and requests taken in turn."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from girder.functions import categories
from girder.functions.rules import Refused
from girder.operators import requests
from girder.streaming import journal

SCHEMA = "request_id string, kind string, finding string, actor string, decision string, class string, task string, severity string, status string, evidence array<string>, box array<double>, note string, occurred_at string"
ID, SHA, OTHER = "ab" * 16, "0f" * 32, "1e" * 32


def request(**given):
    row = {"request_id": "r1", "actor": "someone", "note": "seen\non site"} | given
    return tuple(row.get(c.split()[0]) for c in SCHEMA.split(", "))


REVIEW = {"kind": "review", "finding": ID, "decision": "confirmed"}
FIX = {"kind": "correction", "finding": ID, "status": "resolved", "evidence": [SHA]}
MANUAL = {"kind": "manual", "class": "crack", "box": [0.0, 1.0, 5.0, 9.0]}
CASES = [
    (REVIEW, None), (REVIEW | {"class": "crack", "task": "t", "severity": "s" * 500}, None), (FIX, None), (MANUAL, None), ({"kind": "note", "finding": ID}, None),
    (FIX | {"status": "planned", "evidence": []}, None), (REVIEW | {"occurred_at": "2026-01-02T03:04:05+02:00"}, None),
    ({"kind": "remark", "finding": ID}, "unknown_kind"), ({"finding": ID}, "unknown_kind"), (REVIEW | {"status": "planned"}, "unknown_field"), ({"kind": "note", "finding": ID, "class": "crack"}, "unknown_field"),
    (MANUAL | {"finding": ID}, "finding_given"), (REVIEW | {"finding": None}, "bad_finding"), (REVIEW | {"finding": ID.upper()}, "bad_finding"), (MANUAL | {"class": "rust"}, "unknown_class"),
    (MANUAL | {"box": [0.0, 1.0, 2.0]}, "bad_box"), (MANUAL | {"box": [0.0, float("nan"), 2.0, 3.0]}, "bad_box"), (MANUAL | {"box": None}, "bad_box"),
    (REVIEW | {"decision": "uncertain"}, "unknown_decision"), (REVIEW | {"class": "rust"}, "unknown_class"), (REVIEW | {"task": " t"}, "bad_task"), (REVIEW | {"severity": "s" * 501}, "bad_severity"),
    (REVIEW | {"decision": "rejected", "severity": "high"}, "needs_confirmation"), (FIX | {"status": "to_do"}, "unknown_status"), (FIX | {"evidence": None}, "bad_evidence"),
    (FIX | {"evidence": [SHA[:-1] + "g"]}, "bad_evidence"), (FIX | {"evidence": [f"{i}" * 64 for i in range(5)]}, "bad_evidence"), (FIX | {"evidence": [SHA, OTHER, SHA]}, "repeated_evidence"),
    (FIX | {"evidence": []}, "needs_evidence"), (REVIEW | {"note": ""}, "bad_note"), (REVIEW | {"note": "n" * 4001}, "bad_note"), (REVIEW | {"request_id": "r" * 129}, "bad_request_id"),
    (REVIEW | {"actor": "a\x07"}, "bad_actor"), (REVIEW | {"occurred_at": "2026-01-02T03:04:05"}, "bad_time"),
]


def test_requests_are_sound_or_name_their_problem(spark):
    table = spark.createDataFrame([(i, *request(**given)) for i, (given, _) in enumerate(CASES)], f"i int, {SCHEMA}")
    got = {r["i"]: r for r in requests.checked_requests(table).collect()}
    assert [got[i]["problem"] for i in range(len(CASES))] == [p for _, p in CASES]
    assert got[6]["occurred_at"] == "2026-01-02T01:04:05.000000Z"


def test_findings_by_hand(spark):
    rows = [("a", "r1", [0.0, 1.0, 5.0, 9.0]), ("a", "é\"2", [0.0, 0.0, 10.0, 20.0]), ("a", "r3", [5.0, 1.0, 5.0, 9.0]), ("a", "r4", [-1.0, 1.0, 5.0, 9.0]), ("a", "r5", [0.0, 1.0, 5.0, 21.0]), ("b", "r1", [0.0, 1.0, 5.0, 9.0])]
    t = spark.createDataFrame([(a, *request(**MANUAL | {"request_id": i, "box": b})) for a, i, b in rows], f"analysis string, {SCHEMA}").withColumn("recorded_at", F.lit("now"))
    photos = spark.createDataFrame([("a", SHA, 10, 20)], "analysis string, photo_sha256 string, width int, height int")
    found, refused = requests.manual_findings(requests.checked_requests(t), photos)
    got = {r["finding"]: r for r in found.collect()}
    name = lambda i: hashlib.sha256(json.dumps(["a", i, "manual"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]
    assert got.keys() == {name("r1"), name("é\"2")}
    one = got[name("r1")]
    assert (one["origin"], one["state"], one["score"], one["severity"], one["label"], one["box_normalized"]) == ("human", "proposed", None, None, "Fissures", [0.0, 0.05, 0.5, 0.45])
    assert sorted(tuple(r)[1:] for r in refused.collect()) == [("r3", "empty_box"), ("r4", "outside_photo"), ("r5", "outside_photo")]


def test_a_finding_by_hand_is_replayed_from_its_event_on(spark):
    schema = "analysis long, revision long, request_id string, finding long, kind string, decision string, class string, status string, recorded_at timestamp, occurred_at timestamp"
    import datetime as dt

    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, 1, "a", 7, "review", "rejected", None, None), (1, 2, "b", 7, "manual", None, "crack", None), (1, 3, "c", 7, "review", "confirmed", None, None), (1, 4, "d", 7, "correction", None, None, "planned"), (1, 5, "e", 9, "note", None, None, None)]
    e = spark.createDataFrame([(*r, at(r[1]), None) for r in rows], schema)
    own = spark.createDataFrame([(1, 0, "surface_loss")], "analysis long, finding long, class string")
    got = {r["finding"]: tuple(r)[2:] for r in journal.replay(own, e).collect()}
    assert got == {0: ("proposed", None, "not_assessed", 0, 0, 0), 7: ("confirmed", "crack", "planned", 1, 1, 0)}
    analyses = spark.createDataFrame([(1, at(2))], "analysis long, analysed_at timestamp")
    problems = {r["revision"]: r["problem"] for r in journal.violations(e, own, analyses).collect()}
    assert problems == {1: "before_analysis", 5: "unknown_finding"}
    assert {r["revision"] for r in journal.violations(e, own).collect()} == {1, 5}


def test_requests_of_a_batch_are_taken_in_turn(spark):
    j = spark.createDataFrame([(1, 1, "a", "d1")], "analysis long, revision long, request_id string, digest string")
    asked = [(1, 0, "b", "d2", 1), (1, 1, "b", "d2", 1), (1, 2, "b", "dx", 2), (1, 3, "c", "d3", 1), (1, 4, "c", "d3", 2), (1, 5, "a", "d1", 0), (2, 0, "a", "d", 0), (2, 1, "b", "d", 1)]
    q = spark.createDataFrame(asked, "analysis long, turn int, request_id string, digest string, expected_revision long")
    got = [r["outcome"] for r in journal.appended(j, q).orderBy("analysis", "turn").collect()]
    assert got == ["append", "no_op", "conflict", "stale", "append", "no_op", "append", "append"]


def test_classes_have_families_and_labels(spark):
    t = spark.createDataFrame([(c,) for c in categories.FAMILIES], "class string")
    got = {r["class"]: (r["family"], r["label"]) for r in categories.with_category(t).collect()}
    assert got["peeling_paint"] == ("surface_damage", "Revêtement écaillé ou décollé") and got["surface_loss"] == ("surface_damage", "Pertes de matière")
    assert categories.legend(("crack", "surface_loss")) == "Rouge : fissure · Bleu : perte de matière"
    with pytest.raises(Refused):
        categories.with_category(t.withColumn("class", F.lit("rust")))
