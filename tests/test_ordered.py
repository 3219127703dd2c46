"""Revisions in any order, cut into any batches, give the states of the batch replay."""

import random
import time
from datetime import datetime, timedelta

import pytest

from girder.streaming import journal, ordered

SCHEMA = "analysis long, revision long, finding long, kind string, decision string, class string, status string, own_class string"


@pytest.fixture(scope="module")
def rocks(spark):
    old = spark.conf.get(ordered.PROVIDER[0], None)
    spark.conf.set(*ordered.PROVIDER)
    yield spark
    spark.conf.set(ordered.PROVIDER[0], old) if old else spark.conf.unset(ordered.PROVIDER[0])


def drawn(rng, analyses=5, events=25):
    rows = []
    for a in range(analyses):
        added = 1
        for r in range(1, events + 1):
            kind = rng.choice(["review", "review", "correction", "note", "manual"])
            added += kind == "manual"
            finding = added if kind == "manual" else rng.randint(0, 4)
            decision = rng.choice(["confirmed", "confirmed", "rejected"]) if kind == "review" else None
            class_ = rng.choice(["crack", "mold", None]) if decision == "confirmed" else "rust" if kind == "manual" else None
            rows.append((a, r, finding, kind, decision, class_, rng.choice(["planned", "resolved"]) if kind == "correction" else None, "peeling" if finding < 2 else None))
    return rows


def streamed(spark, tmp_path, batches, patience=None, name="states"):
    """All rows that the stream puts out over the batches, one after the other."""
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = ordered.replay_in_order(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), patience)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = stream.writeStream.queryName(f"{name}{k}").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        running = query.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        assert running.awaitTermination(25), running.lastProgress
        assert running.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_the_journal_gives_the_batch_states(rocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = drawn(rng)
    findings = rocks.createDataFrame([(a, f, "peeling") for a in range(5) for f in (0, 1)], "analysis long, finding long, class string")
    t0 = datetime(2024, 1, 1)
    events = rocks.createDataFrame([(*r[:7], t0 + timedelta(hours=r[1])) for r in rows], "analysis long, revision long, finding long, kind string, decision string, class string, status string, recorded_at timestamp")
    touched = {(r[0], r[2]) for r in rows}
    want = {tuple(r) for r in journal.replay(findings, events).select("analysis", "finding", "state", "effective_class", "correction", "n_notes", "n_reviews", "refused").collect() if (r[0], r[1]) in touched}
    shuffled = rows + rng.sample(rows, 20)  # some come twice
    rng.shuffle(shuffled)
    cuts = sorted(rng.sample(range(1, len(shuffled)), 2))
    batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, len(shuffled)], strict=True)]
    out = streamed(rocks, tmp_path, batches, name=f"seed{seed}")
    assert {tuple(r) for r in ordered.latest(out).collect()} == want
    applied = [(r["analysis"], r["revision"]) for r in out.where("finding is not null").collect()]
    assert len(applied) == len(set(applied))


def test_a_missing_revision_is_named(rocks, tmp_path):
    """Timers want batches without data, so the query runs until the row is there and is stopped then."""
    note = lambda a, r: (a, r, 0, "note", None, None, None, "peeling")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rocks.createDataFrame([note(1, 1), note(1, 3), note(1, 4), note(2, 1)], SCHEMA).coalesce(1).write.parquet(source)
    stream = ordered.replay_in_order(rocks.readStream.schema(SCHEMA).parquet(source), 1)
    running = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).start()
    try:
        until = time.time() + 40
        named = []
        while not named and time.time() < until and running.isActive:
            time.sleep(1)
            if (tmp_path / "out").exists():
                named = [r["waits_for"] for r in rocks.read.parquet(out).where("finding is null").collect()]
    finally:
        running.stop()
    assert named and set(named) == {2}
    assert {(r["analysis"], r["n_notes"]) for r in ordered.latest(rocks.read.parquet(out)).collect()} == {(1, 1), (2, 1)}
