"""A journal that is written, by one writer and by two, with deaths in between."""

import hashlib
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from girder.functions.rules import Refused
from girder.streaming import store

COLUMNS = "analysis long, request_id string, digest string, expected_revision long, turn int, kind string, finding long, decision string, class string, status string, evidence array<string>, recorded_at timestamp, occurred_at timestamp"
START = datetime(2024, 1, 1)


def request(analysis, name, expected, turn=0, kind="note", at=None, evidence=(), digest=None, **more):
    row = dict.fromkeys([c.split()[0] for c in COLUMNS.split(", ")])
    return row | {"analysis": analysis, "request_id": name, "digest": digest or f"d{name}", "expected_revision": expected, "turn": turn, "kind": kind, "finding": 0, "evidence": list(evidence), "recorded_at": START + timedelta(hours=at if at is not None else expected)} | more


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/journal"


def outcomes(df):
    return {(r["analysis"], r["request_id"]): r["outcome"] if r["problem"] is None else r["problem"] for r in df.collect()}


def stored(spark, folder, table):
    schema = store.event_schema(table(request(1, "x", 0)))
    return sorted((r["analysis"], r["revision"], r["request_id"]) for r in store.journal(spark, folder, schema).collect())


def test_requests_are_appended_once(spark, table, folder):
    first = table(request(1, "a", 0), request(1, "b", 1, 1), request(2, "c", 0), request(2, "d", 0, 1))
    assert outcomes(store.append(folder, first)) == {(1, "a"): "append", (1, "b"): "append", (2, "c"): "append", (2, "d"): "stale"}
    assert stored(spark, folder, table) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    again = table(request(1, "a", 0), request(1, "b", 1, 1, digest="other"), request(1, "e", 2, 2), request(3, "f", 1))
    assert outcomes(store.append(folder, again)) == {(1, "a"): "no_op", (1, "b"): "conflict", (1, "e"): "append", (3, "f"): "stale"}
    assert store.commits(spark, folder)[0] == 2
    assert outcomes(store.append(folder, again.where("request_id in ('a', 'e')"))) == {(1, "a"): "no_op", (1, "e"): "no_op"}
    assert store.commits(spark, folder)[0] == 2  # nothing new, no commit
    assert stored(spark, folder, table) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "e"), (2, 1, "c")]


def test_events_that_break_a_rule_are_refused_with_their_analysis(spark, table, folder):
    store.append(folder, table(request(1, "a", 0, at=5)))
    rows = table(request(1, "early", 1, at=2), request(1, "next", 2, 1, at=6), request(2, "fine", 0), request(3, "kind", 0, kind="remark"))
    assert outcomes(store.append(folder, rows)) == {(1, "early"): "time_goes_back", (1, "next"): "time_goes_back", (2, "fine"): "append", (3, "kind"): "unknown_kind"}
    assert stored(spark, folder, table) == [(1, 1, "a"), (2, 1, "fine")]


def test_two_writers_lose_and_double_nothing(spark, table, folder):
    lots = {w: table(*[request(a, f"{w}{a}", 0) for a in range(20)], *[request(100 + a, f"{w}own{a}", 0) for a in range(5 * (w == "x"), 5 + 5 * (w == "x"))]) for w in "xy"}
    got, gate, make = {}, threading.Barrier(2), store.create_once
    met = threading.local()

    def together(s, path, text):
        if "COMMIT" in path and not getattr(met, "done", False):
            met.done = True
            gate.wait(60)  # both have judged the same journal and want the same number
        return make(s, path, text)

    store.create_once, kept = together, store.create_once
    try:
        threads = [threading.Thread(target=lambda w=w: got.update({w: outcomes(store.append(folder, lots[w]))})) for w in lots]
        [t.start() for t in threads]
        [t.join() for t in threads]
    finally:
        store.create_once = kept
    for a in range(20):  # of two requests on one revision one is in, the other was made too late
        assert sorted(got[w][a, f"{w}{a}"] for w in "xy") == ["append", "stale"]
    assert all(v == "append" for w in "xy" for (a, _), v in got[w].items() if a >= 100)
    rows = stored(spark, folder, table)
    assert len(rows) == 30 and {r[1] for r in rows} == {1} and len({r[0] for r in rows}) == 30
    assert store.commits(spark, folder)[0] == 2


@pytest.mark.parametrize("where", ["write_batch", "create_once", "after"])
def test_a_writer_that_dies_can_send_again(spark, table, folder, monkeypatch, where):
    store.append(folder, table(request(1, "a", 0)))
    real = {"write_batch": store.write_batch, "create_once": store.create_once}

    def dies(*args):
        if where == "after":
            assert real["create_once"](*args)
        raise OSError("the writer died")

    monkeypatch.setattr(store, "create_once" if where == "after" else where, dies)
    with pytest.raises(OSError, match="died"):
        store.append(folder, table(request(1, "b", 1)))
    for name, f in real.items():
        monkeypatch.setattr(store, name, f)
    assert stored(spark, folder, table) == ([(1, 1, "a"), (1, 2, "b")] if where == "after" else [(1, 1, "a")])
    assert outcomes(store.append(folder, table(request(1, "b", 1)))) == {(1, "b"): "no_op" if where == "after" else "append"}
    assert stored(spark, folder, table) == [(1, 1, "a"), (1, 2, "b")]


def test_proofs_come_with_their_events(spark, table, folder):
    raw = [b"one", b"two", b"three"]
    sha = [hashlib.sha256(x).hexdigest() for x in raw]
    attach = lambda *pairs: spark.createDataFrame([(s, bytearray(x)) for s, x in pairs], "sha256 string, content binary")
    fix = lambda name, expected, proofs: table(request(1, name, expected, kind="correction", status="resolved", evidence=proofs))
    assert outcomes(store.append(folder, fix("a", 0, [sha[0]]))) == {(1, "a"): "missing_evidence"}
    with pytest.raises(Refused, match="digest"):
        store.append(folder, fix("a", 0, [sha[0]]), attachments=attach((sha[0], raw[1])))
    with pytest.raises(Refused, match="no event names"):
        store.append(folder, fix("a", 0, [sha[0]]), attachments=attach((sha[0], raw[0]), (sha[1], raw[1])))
    assert outcomes(store.append(folder, fix("a", 0, sha[:2]), attachments=attach(*zip(sha[:2], raw[:2], strict=True)))) == {(1, "a"): "append"}
    assert outcomes(store.append(folder, fix("b", 1, [sha[0]]))) == {(1, "b"): "append"}  # a stored proof serves again
    schema = store.event_schema(fix("a", 0, []))
    assert store.verified(spark, folder, schema).count() == 2
    assert [tuple(r) for r in store.evidence(store.journal(spark, folder, schema)).collect()] == [(1, 2, 0)]
    many = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(63)]
    assert outcomes(store.append(folder, fix("c", 2, many), attachments=attach(*[(s, str(i).encode()) for i, s in enumerate(many)]))) == {(1, "c"): "too_many_proofs"}
    assert store.compact(spark, folder, schema) and store.verified(spark, folder, schema).count() == 2
    assert len(store.commits(spark, folder)[1]) == 1 and store.proofs(spark, folder).count() == 2
    _, (batch,) = store.commits(spark, folder)
    store.proofs(spark, folder).limit(1).withColumn("content", F.lit(b"changed")).write.mode("append").parquet(f"{folder}/batches/{batch}/proofs")
    with pytest.raises(store.Changed, match="changed_proof"):
        store.verified(spark, folder, schema)


def test_a_lease_ends_or_is_given_back(spark, folder):
    clock = [1000.0]
    take = lambda who, s=60: store.lease(spark, folder, who, s, lambda: clock[0])
    n = take("first writer")
    with pytest.raises(store.Busy, match="first writer"):
        take("second")
    assert take("first writer") == n + 1  # renewed
    clock[0] += 61
    m = take("second")
    with pytest.raises(store.Busy):
        take("first writer")
    store.release(spark, folder, m)
    assert take("first writer") == m + 1


def test_links_are_refused(spark, table, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    with pytest.raises(Refused, match="link"):
        store.append(f"file://{tmp_path}/link/journal", table(request(1, "a", 0)))


def test_a_file_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/one"
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if store.create_once(spark, path, f"text {k}") else None) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and store.text_of(spark, path) == f"text {won[0]}"
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["one"]
