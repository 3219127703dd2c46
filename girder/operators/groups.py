"""Content groups and what follows from them (GR-01 to GR-05, ST-03, AG-14, AG-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions.rules import refuse
from girder.operators.components import connected_components


def content_groups(vertices: DataFrame, links: DataFrame, strict: bool = False) -> DataFrame:
    """id, content_group of every vertex: the smallest id of its component, its own if it has no link.

    links: (a, b). strict refuses a link that names no vertex or the same one twice.
    """
    if strict:
        ends = links.select(F.explode(F.array("a", "b")).alias("id"))
        refuse(ends.join(vertices, "id", "left_anti"), "a link names an unknown id")
        refuse(links.where("a = b"), "a link joins an id with itself")
    parts = connected_components(links)
    return vertices.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("content_group"))


def groups_of_several(groups: DataFrame) -> DataFrame:
    """content_group, members (ascending), n of groups with more than one member."""
    return groups.groupBy("content_group").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("n")).where("n > 1")


def members_of_several(groups: DataFrame, group: str = "content_group") -> DataFrame:
    """group, n, id: a row for every member of the groups with more than one, so a group may be as large as the corpus."""
    several = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.join(several, group).select(group, "n", "id")


def with_quarantine(groups: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, content_group, quarantined, reason: one excluded member withholds its whole group.

    excluded: (id, reason); the members that did not give cause say so. A group's flag is aggregated and joined back, so
    a giant group is no task's work.
    """
    t = groups.join(excluded, "id", "left")
    flags = t.where(F.col("reason").isNotNull()).select("content_group", F.lit(True).alias("quarantined")).distinct()
    t = t.join(flags, "content_group", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))
    return t.withColumn("reason", F.when(F.col("quarantined"), F.coalesce("reason", F.lit("linked to a withheld item")))).select("id", "content_group", *[c for c in groups.columns if c not in ("id", "content_group")], "reason", "quarantined")


def external_roles(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, content_group, role: quarantine where any pair of the group needs review, else candidate for the smallest id and variant."""
    flagged = pairs.where("review_required").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bad = groups.join(flagged, "id", "left_semi").select("content_group", F.lit(True).alias("bad")).distinct()
    t = groups.join(bad, "content_group", "left")
    role = F.when(F.col("bad"), "quarantine").when(F.col("id") == F.col("content_group"), "candidate").otherwise("variant")
    return t.select("id", "content_group", role.alias("role"))


def crossing_groups(table: DataFrame, group: str = "content_group", split: str = "split") -> DataFrame:
    """Groups whose members stand in more than one split; there must be none."""
    return table.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
