"""Whole preparations: from an archive's members to records, and from records to a split corpus (SRC-05, SNK-04, PRJ-30)."""

from __future__ import annotations

import json
import posixpath
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.functions.rules import Refused, refuse, repeated
from girder.operators import groups, integrity, selection, splits
from girder.shared import staged
from girder.sinks.exports import file_system
from girder.streaming.store import create_once, names, text_of


def imported(members: DataFrame, pattern: str, roles: list[str]) -> DataFrame:
    """id, number, difficulty, stem and a name for each role of members whose names match ``difficulty``, ``role`` and ``stem``.

    pattern: a regular expression with three groups in that order. A stem without one member of every role and a
    member that belongs to no stem are refused. Numbers are dense, by difficulty and stem.
    """
    part = lambda k: F.regexp_extract("name", pattern, k)
    t = members.where("not is_dir").select("name", F.lower(part(1)).alias("difficulty"), part(2).alias("role"), F.concat_ws("/", F.lower(part(1)), part(3)).alias("stem"))
    whole, orphans = integrity.companions(t, roles)
    refuse(orphans, "members without their companions")
    named = selection.dense_ids(whole, ["stem"])
    difficulty = F.substring_index("stem", "/", 1)
    return named.select(F.concat_ws("_", difficulty, F.lpad(F.col("number").cast("string"), 4, "0")).alias("id"), "number", difficulty.alias("difficulty"), "stem", *roles)


def policy_violations(ids: DataFrame, excluded: DataFrame, together: DataFrame) -> DataFrame:
    """problem, id of a policy's lists: ids that are unknown or stand twice, and exclusions without a reason."""
    named = together.select(F.explode("members").alias("id"))
    parts = [
        excluded.join(ids, "id", "left_anti").select(F.lit("unknown_excluded").alias("problem"), "id"),
        named.join(ids, "id", "left_anti").select(F.lit("unknown_linked").alias("problem"), "id"),
        repeated(excluded, "id").select(F.lit("excluded_twice").alias("problem"), "id"),
        repeated(named, "id").select(F.lit("linked_twice").alias("problem"), "id"),
        excluded.where("reason is null or trim(reason) = ''").select(F.lit("no_reason").alias("problem"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prepared(records: DataFrame, links: DataFrame, excluded: DataFrame, seed: int = 20260918) -> dict[str, DataFrame]:
    """manifest, summary, withheld and linked groups of records (id, digest, difficulty, classes).

    Groups come from links (a, b) and equal digests; a group with an excluded member is withheld whole; the rest is split by
    group. Refused if a group or a digest would stand in two splits.
    """
    firsts = records.groupBy("digest").agg(F.min("id").alias("a"))
    same = records.join(firsts, "digest").where("id <> a").select("a", F.col("id").alias("b"))
    grouped = staged(groups.content_groups(records, links.unionByName(same)), "groups")
    held = staged(groups.with_quarantine(grouped, excluded), "quarantine")
    free = staged(records.join(held.where("not quarantined").select("id", "content_group"), "id"), "free")
    manifest = staged(free.join(splits.grouped_split(free, seed).select("id", "split"), "id"), "manifest")
    refuse(groups.crossing_groups(manifest), "a group crosses splits")
    refuse(splits.shared_digests(manifest), "equal pixels stand in two splits")
    return {"manifest": manifest, "summary": splits.split_summary(manifest, [0, 1]), "withheld": held.where("quarantined").select("id", "content_group", "reason"), "linked": groups.groups_of_several(grouped)}


def refuse_inside(destination: str, sources: list[str]) -> None:
    """A corpus must not be written into what it is made from."""
    bare = lambda p: re.sub(r"^file:/+", "/", posixpath.normpath(p)).rstrip("/") + "/"
    if inside := [s for s in sources if bare(destination).startswith(bare(s))]:
        raise Refused(f"{destination} lies inside its source {inside[0]}")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        (table.write.partitionBy("split") if name == "manifest" else table.write).parquet(f"{folder}/{name}")


def publish_corpus(tables: dict[str, DataFrame], folder: str, sources: list[str] | None = None) -> None:
    """All tables of a preparation under their names, the manifest by split, in a new folder: written to a hidden sibling, which one rename makes visible whole."""
    refuse_inside(folder, sources or [])
    spark = next(iter(tables.values())).sparkSession
    fs, target = file_system(spark, folder)
    if fs.exists(target):
        raise Refused(f"{folder} exists")
    parent, _, name = folder.rstrip("/").rpartition("/")
    hidden = f"{parent}/_staging_{uuid.uuid4().hex}_{name}"
    _, source = file_system(spark, hidden)
    try:
        write_tables(tables, hidden)
        if not fs.rename(source, target):
            raise Refused(f"{folder} could not be published")
    finally:
        fs.delete(source, True)


CORPUS = re.compile(r"CORPUS\.(\d{12})")


def commit_corpus(tables: dict[str, DataFrame], folder: str, sources: list[str] | None = None) -> int:
    """The tables as the next version of a corpus, and its number. One record names them all, so readers see all tables of the old version or of the new.

    The record is created once by one writer alone; another that wanted the same number is refused and may try again.
    """
    refuse_inside(folder, sources or [])
    spark = next(iter(tables.values())).sparkSession
    last = corpus_version(spark, folder)
    version = f"v{uuid.uuid4().hex}"
    write_tables(tables, f"{folder}/{version}")
    if not create_once(spark, f"{folder}/CORPUS.{last + 1:012d}", json.dumps({"version": version, "tables": sorted(tables)})):
        raise Refused("another writer committed this corpus at the same time")
    return last + 1


def corpus_version(spark: SparkSession, folder: str) -> int:
    return max((int(m[1]) for m in map(CORPUS.fullmatch, names(spark, folder)) if m), default=0)


def corpus_tables(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a corpus's last version, or of that number."""
    number = number or corpus_version(spark, folder)
    if not number:
        raise Refused(f"{folder} has no corpus")
    record = json.loads(text_of(spark, f"{folder}/CORPUS.{number:012d}"))
    return {name: spark.read.parquet(f"{folder}/{record['version']}/{name}") for name in record["tables"]}


def open_split(spark: SparkSession, folder: str, split: str, open_reserved_test: bool = False) -> DataFrame:
    """One split of a published corpus; the test split is read only if that is said in so many words."""
    if split == "test" and not open_reserved_test:
        raise PermissionError("the test split is reserved")
    return spark.read.parquet(f"{folder}/manifest").where(F.col("split") == split)
