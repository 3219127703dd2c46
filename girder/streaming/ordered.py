"""The journal's states from a stream whose revisions come in any order (EV-02).

Each analysis keeps the revision it waits for, the findings' states, and what came too early. A revision is applied when all before it have been, once, however often it
comes; so the states are those of the batch replay however the journal is cut into batches. While an analysis waits, a
timer runs, and when it ends the missing revision is named.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from girder.streaming.journal import NO_CORRECTION, STATE, apply_event

#: States need Spark's RocksDB store; a caller sets this on the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FIELDS = ("kind", "finding", "decision", "chosen", "status", "own_class")
OUT = f"analysis long, revision long, finding long, {STATE}, waits_for long"


class InOrder(StatefulProcessor):
    """States of one analysis. patience: milliseconds after which a missing revision is named, none for never."""

    def __init__(self, patience: int | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.applied = handle.getValueState("applied", "revision long, timer long")
        self.early = handle.getMapState("early", "revision long", "event string")
        self.states = handle.getMapState("states", "finding long", f"{STATE}, own_class string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        revision, timer = self.applied.get() if self.applied.exists() else (0, 0)
        for batch in rows:
            for r in batch[["revision", *FIELDS]].astype(object).where(batch[["revision", *FIELDS]].notna(), None).itertuples(index=False):
                if int(r[0]) > revision and not self.early.containsKey((int(r[0]),)):
                    self.early.updateValue((int(r[0]),), (json.dumps([None if v is None else int(v) if k == "finding" else v for k, v in zip(FIELDS, r[1:], strict=True)]),))
        out = []
        while self.early.containsKey((revision + 1,)):
            revision += 1
            event = dict(zip(FIELDS, json.loads(self.early.getValue((revision,))[0]), strict=True))
            self.early.removeKey((revision,))
            if (state := self.advance(event)) is not None:
                out.append((key[0], revision, event["finding"], *state, None))
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if self.patience is not None and next(iter(self.early.keys()), None) is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(timer)
        self.applied.update((revision, timer))
        yield self.frame(out)

    def advance(self, event: dict) -> tuple | None:
        """The state of the event's finding after it; None if there is no such finding yet, and then it has no effect."""
        at = (event["finding"],)
        if self.states.containsKey(at):
            *state, own = self.states.getValue(at)
        elif event["own_class"] is not None or event["kind"] == "manual":
            state, own = ("proposed", None, NO_CORRECTION, 0, 0, 0), event["own_class"] or event["chosen"]
        else:
            return None
        effective = event["chosen"] or own
        state = apply_event(tuple(state), event["kind"], event["decision"], effective, event["status"])
        self.states.updateValue(at, (*state, own))
        return state

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        revision, _ = self.applied.get()
        self.applied.update((revision, 0))
        yield self.frame([(key[0], revision, None, None, None, None, None, None, None, revision + 1)])

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        columns = [x.split()[0] for x in OUT.split(", ")]
        kinds = {x.split()[0]: "Int64" for x in OUT.split(", ") if x.endswith(" long")}
        return pd.DataFrame(rows, columns=columns).astype(kinds)

    def close(self) -> None:
        pass


def replay_in_order(events: DataFrame, patience: int | None = 3_600_000) -> DataFrame:
    """analysis, revision, finding, its state after that revision; or waits_for, the revision whose absence has outlasted ``patience``.

    events: a stream of (analysis, revision, finding, kind, decision, class, status, own_class), the last the class of a finding
    that the analysis itself made, null of any other. The last row of a finding by revision is its state; ``latest`` picks it.
    """
    rows = events.withColumnRenamed("class", "chosen").select("analysis", "revision", *FIELDS)
    return rows.groupBy("analysis").transformWithStateInPandas(InOrder(patience), OUT, "update", "none" if patience is None else "processingTime")


def latest(states: DataFrame) -> DataFrame:
    """Each finding's last state of the rows that a stream has put out."""
    columns = [x.split()[0] for x in STATE.split(", ")]
    last = states.where("finding is not null").groupBy("analysis", "finding").agg(F.max_by(F.struct(*columns), "revision").alias("s"))
    return last.select("analysis", "finding", "s.*")
