"""A journal that is written: numbered commits that one writer alone can make (EV-03, EV-05, EV-06; AG-25).

A commit is a batch of events of any number of analyses, and the proofs they name, written by Spark first and announced then by one small file with the commit's number. That file is created whole
and only if there is none, so of two writers one gets the number and the other judges its requests anew against what the first has added. A batch
that nobody announced is never read: a writer that dies leaves the journal as it was, and its requests can simply be sent again, as one that is already in
the journal has no effect. A lease keeps patient writers out of each other's way; what is right does not depend on it.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.functions.rules import Refused, refuse
from girder.shared import staged
from girder.sinks.exports import file_system
from girder.streaming.journal import appended, violations

#: Fixed limit of an analysis's proofs.
MOST_PROOFS = 64
#: Columns of a request that are no part of its event.
CONTROL = ("turn", "expected_revision")
COMMIT = re.compile(r"COMMIT\.(\d{12})")
LEASE = re.compile(r"(LEASE|RELEASED)\.(\d{12})")


class Busy(RuntimeError):
    """Another writer holds the lease or keeps winning the next number."""


class Changed(ValueError):
    """What is stored is not what was stored."""


def local(spark: SparkSession, at):
    """A local file's path as Java's own file functions take it."""
    jvm = spark.sparkContext._jvm
    return jvm.java.nio.file.Path.of(at.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its content if there is none of that name; whether it was created. Nobody ever sees a part of it."""
    fs, at = file_system(spark, path)
    parent, _, name = path.rpartition("/")
    _, draft = file_system(spark, f"{parent}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(at) and bool(fs.rename(draft, at))
        # Renaming replaces a local file; a second link to the draft does not.
        try:
            spark.sparkContext._jvm.java.nio.file.Files.createLink(local(spark, at), local(spark, draft))
            return True
        except Exception:
            if fs.exists(at):
                return False
            raise
    finally:
        fs.delete(draft, False)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def text_of(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def refuse_links(spark: SparkSession, folder: str) -> None:
    """A local folder, and all above it, must be folders and not links to others."""
    fs, at = file_system(spark, folder)
    while fs.getScheme() == "file" and at is not None:
        if spark.sparkContext._jvm.java.nio.file.Files.isSymbolicLink(local(spark, at)):
            raise Refused(f"{at} is a link")
        at = at.getParent()


def lease(spark: SparkSession, folder: str, owner: str, seconds: float, now: Callable[[], float] = time.time) -> int:
    """Take the journal's lease, or renew one's own; Busy while another owner's has neither ended nor been given back."""
    file_system(spark, folder)[0].mkdirs(file_system(spark, folder)[1])
    found = sorted((int(m[2]), m[1]) for m in map(LEASE.fullmatch, names(spark, folder)) if m)
    last = max((n for n, _ in found), default=0)
    if last and (last, "RELEASED") not in found:
        held, until = text_of(spark, f"{folder}/LEASE.{last:012d}").rsplit(" ", 1)
        if held != owner and float(until) > now():
            raise Busy(f"{held} writes this journal")
    if not create_once(spark, f"{folder}/LEASE.{last + 1:012d}", f"{owner} {now() + seconds}"):
        raise Busy("another writer took the lease at the same time")
    return last + 1


def release(spark: SparkSession, folder: str, number: int) -> None:
    create_once(spark, f"{folder}/RELEASED.{number:012d}", "")


def commits(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """The number of the last commit, and the batches that make up the journal: those since the last one that holds all before it."""
    last = max((int(m[1]) for m in map(COMMIT.fullmatch, names(spark, folder)) if m), default=0)
    batches = []
    for n in range(last, 0, -1):
        kind, batch = text_of(spark, f"{folder}/COMMIT.{n:012d}").split(" ")
        batches.append(batch)
        if kind == "whole":
            break
    return last, batches[::-1]


def read_table(spark: SparkSession, folder: str, batches: list[str], part: str, schema) -> DataFrame:
    fs, _ = file_system(spark, folder)
    paths = [p for b in batches if fs.exists(file_system(spark, p := f"{folder}/batches/{b}/{part}")[1])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


PROOF = "sha256 string, content binary"


def journal(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All events of the journal's last commit; schema: of its events."""
    return read_table(spark, folder, commits(spark, folder)[1], "events", schema)


def proofs(spark: SparkSession, folder: str) -> DataFrame:
    """sha256, content of the stored proofs."""
    return read_table(spark, folder, commits(spark, folder)[1], "proofs", PROOF)


def event_schema(requests: DataFrame):
    return requests.select(F.lit(0).cast("long").alias("revision"), *[c for c in requests.columns if c not in CONTROL]).schema


def write_batch(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    batch = f"b{uuid.uuid4().hex}"
    for part, table in tables.items():
        table.write.parquet(f"{folder}/batches/{batch}/{part}")
    return batch


def append(folder: str, requests: DataFrame, findings: DataFrame | None = None, analyses: DataFrame | None = None, attachments: DataFrame | None = None, tries: int = 20) -> DataFrame:
    """analysis, request_id, outcome, problem of every request, after the accepted ones are in the journal.

    requests: analysis, request_id, digest, expected_revision, turn (their order in an analysis), kind, finding, decision, class, recorded_at, occurred_at, evidence
    (digests of proofs) and any other columns of the event. Outcomes are those of ``appended``, and ``refused`` for all new events of an analysis
    whose journal would break a rule with them, or which name a proof that is neither stored nor attached. attachments: (sha256, content), each of the digest it
    claims and named by some event.
    """
    spark = requests.sparkSession
    refuse_links(spark, folder)
    schema = event_schema(requests)
    requests = staged(requests, "requests")
    if attachments is not None:
        attachments = staged(attachments.select("sha256", "content"), "attachments")
        refuse(attachments.where(~F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))).select("sha256"), "a proof is not what its digest says")
    for _ in range(tries):
        last, batches = commits(spark, folder)
        old = read_table(spark, folder, batches, "events", schema)
        own = old.join(requests.select("analysis").distinct(), "analysis", "left_semi")  # the journals that the requests touch
        said = staged(judged(own, requests, findings, analyses, proofs_known(spark, folder, batches, attachments)), "judged")
        fresh = said.where("outcome = 'append'").select(*[f.name for f in schema])
        if attachments is not None:
            named = own.select("evidence").unionByName(requests.select("evidence")).select(F.explode("evidence").alias("sha256")).distinct()
            refuse(attachments.join(named, "sha256", "left_anti").select("sha256"), "no event names this proof")
        result = said.select("analysis", "request_id", "turn", "outcome", "problem")
        if fresh.isEmpty():
            return result
        tables = {"events": fresh}
        if attachments is not None:
            tables["proofs"] = attachments.join(read_table(spark, folder, batches, "proofs", PROOF).select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])
        batch = write_batch(spark, folder, tables)
        if create_once(spark, f"{folder}/COMMIT.{last + 1:012d}", f"more {batch}"):
            return result
    raise Busy("other writers keep taking the next number")


def proofs_known(spark: SparkSession, folder: str, batches: list[str], attachments: DataFrame | None) -> DataFrame:
    stored = read_table(spark, folder, batches, "proofs", PROOF).select("sha256")
    return (stored.unionByName(attachments.select("sha256")) if attachments is not None else stored).distinct()


def judged(old: DataFrame, requests: DataFrame, findings: DataFrame | None, analyses: DataFrame | None, known: DataFrame) -> DataFrame:
    """Requests with outcome, problem and, of those to append, their revision."""
    said = appended(old.select("analysis", "revision", "request_id", "digest"), requests)
    t = requests.join(said.select("analysis", "request_id", "turn", "outcome"), ["analysis", "request_id", "turn"])
    top = old.groupBy("analysis").agg(F.max("revision").alias("_top"))
    line = Window.partitionBy("analysis", F.col("outcome") == "append").orderBy("turn")
    t = t.join(top, "analysis", "left").withColumn("revision", F.when(F.col("outcome") == "append", F.coalesce("_top", F.lit(0)) + F.row_number().over(line)).cast("long")).drop("_top")
    new = t.where("outcome = 'append'").select(*old.columns)
    every = old.unionByName(new)
    wrong = violations(every, findings, analyses).join(new.select("analysis", "revision"), ["analysis", "revision"], "left_semi").groupBy("analysis").agg(F.min_by("problem", "revision").alias("rule"))
    named = every.select("analysis", F.explode("evidence").alias("sha256")).distinct()
    absent = named.join(known, "sha256", "left_anti").select("analysis").distinct().withColumn("missing", F.lit("missing_evidence"))
    many = named.groupBy("analysis").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PROOFS).select("analysis", F.lit("too_many_proofs").alias("many"))
    for more in (wrong, absent, many):
        t = t.join(more, "analysis", "left")
    problem = F.when(F.col("outcome") == "append", F.coalesce("rule", "missing", "many"))
    return t.withColumn("problem", problem).withColumn("outcome", F.when(F.col("problem").isNotNull(), "refused").otherwise(F.col("outcome"))).drop("rule", "missing", "many")


def compact(spark: SparkSession, folder: str, schema) -> bool:
    """One batch in place of all so far, announced as a commit of its own; whether it was, as another writer may come first."""
    last, batches = commits(spark, folder)
    tables = {"events": read_table(spark, folder, batches, "events", schema), "proofs": read_table(spark, folder, batches, "proofs", PROOF)}
    return create_once(spark, f"{folder}/COMMIT.{last + 1:012d}", f"whole {write_batch(spark, folder, tables)}")


def verified(spark: SparkSession, folder: str, schema, findings: DataFrame | None = None, analyses: DataFrame | None = None) -> DataFrame:
    """The journal's events, after all its rules and all its proofs have been checked anew (EV-05)."""
    events, kept = journal(spark, folder, schema), proofs(spark, folder)
    found = [
        violations(events, findings, analyses).select(F.concat_ws(" ", "problem", "analysis", "revision").alias("what")),
        kept.where(~F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))).select(F.concat_ws(" ", F.lit("changed_proof"), "sha256").alias("what")),
        events.select(F.explode("evidence").alias("sha256")).distinct().join(kept, "sha256", "left_anti").select(F.concat_ws(" ", F.lit("missing_proof"), "sha256").alias("what")),
    ]
    wrong = [r["what"] for t in found for r in t.limit(5).collect()]
    if wrong:
        raise Changed(f"the journal is not sound: {wrong}")
    return events


def evidence(events: DataFrame) -> DataFrame:
    """analysis, n_proofs, n_human_reports of a journal: distinct proofs that corrections name, and findings that people added (AG-25)."""
    named = events.where("kind = 'correction'").select("analysis", F.explode("evidence").alias("sha256")).distinct().groupBy("analysis").agg(F.count(F.lit(1)).alias("n_proofs"))
    people = events.groupBy("analysis").agg(F.count_if(F.col("kind") == "manual").alias("n_human_reports"))
    return people.join(named, "analysis", "left").select("analysis", F.coalesce("n_proofs", F.lit(0)).cast("long").alias("n_proofs"), "n_human_reports")
