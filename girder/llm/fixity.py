"""WARC writing and a Merkle fixity audit of replicas.

Records lie end to end in shards. Each record's bytes are hashed; the offsets (from the first of them), lengths and hashes of consecutive records, in order of
offset, are hashed together ``fanout`` at a time, and so are the ranges these cover, level by level, to the shard's root; the shards' roots, in
order, to the replica's. An audit compares roots and descends only below nodes that differ, so equal branches cost
nothing, until the records that are corrupt, missing or added are named.

Nulls: a null url or body is an empty one; a null id sorts first and stays. Repeated rows are
repeated records, in a stable order. An empty table has no shards and, by definition, equal roots with another empty one. Groups hashed
together have at most ``fanout`` members. Columns not named are left alone. Very long records are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.shared import staged

FANOUT = 16
RECORDS_A_SHARD = 4096
#: Levels above the records in a shard: FANOUT ** LEVELS >= RECORDS_A_SHARD.
LEVELS = 3
CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC/1.1 resource record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:girder:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))


def write_warc(pages: DataFrame, records_a_shard: int = RECORDS_A_SHARD) -> DataFrame:
    """Store pages (page_id, url, html) as WARC records: (shard, n, page_id, length, content).

    Records are ordered by id (ties by url and body hash) and numbered from the counts of range
    partitions, of which there is one row each, so no task sees more than its part; n is the record's number in its shard.
    """
    tie = [F.coalesce(F.col("url"), F.lit("")), F.xxhash64("html")]
    slim = pages.select(F.col("page_id").cast("long"), "url", "html")
    ranged = slim.repartitionByRange("page_id", *tie).sortWithinPartitions("page_id", *tie)
    content = record(F.col("page_id"), F.col("url"), F.col("html"))
    # The id counts up by one in a partition from a multiple of 2 ** 33.
    stored = ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq"), "page_id", content.alias("content"))
    stored = staged(stored, "warc")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    number = F.col("before") + F.col("seq")
    t = stored.join(F.broadcast(staged(parts.select("part", "before"), "parts")), "part").withColumn("number", number)
    return t.select(F.expr(f"number div {records_a_shard}").alias("shard"), (F.col("number") % records_a_shard).cast("int").alias("n"), "page_id", F.length("content").cast("long").alias("length"), "content")


def replicated(records: DataFrame) -> DataFrame:
    """A second stored copy of the records."""
    return staged(records, "replica")


def leaves(records: DataFrame) -> DataFrame:
    """(shard, n, page_id, at, length, sha256) of stored records; only hashes and lengths are shuffled."""
    slim = records.select("shard", "n", "page_id", F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))
    line = Window.partitionBy("shard").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slim.withColumn("at", F.sum("length").over(line) - F.col("length"))


def parents(nodes: DataFrame, by: list[str], number: str, fanout: int) -> DataFrame:
    """One level up: nodes (by, number, at, length, sha256) hashed ``fanout`` at a time in order of number; a parent covers their ranges.

    Offsets count from the first child, so what lies behind a record that is missing or has another length keeps its hashes.
    """
    one = F.struct(F.col(number).alias("i"), "at", "length", "sha256")
    grouped = nodes.groupBy(*by, F.expr(f"{number} div {fanout}").cast("int").alias("up")).agg(F.sort_array(F.collect_list(one)).alias("c"), F.min("at").alias("at"), F.sum("length").alias("length"))
    joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["i"].cast("string"), (x["at"] - F.col("at")).cast("string"), x["length"].cast("string"), x["sha256"])), ",")
    return grouped.select(*by, F.col("up").alias(number), "at", "length", F.sha2(joined, 256).alias("sha256"))


def tree(leaf: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The levels of all shards' trees from the records to the shards' roots, each (shard, n, at, length, sha256), stored."""
    out = [staged(leaf.select("shard", "n", "at", "length", "sha256"), "tree0")]
    for k in range(levels):
        out.append(staged(parents(out[-1], ["shard"], "n", fanout), f"tree{k + 1}"))
    return out


def replica_root(top: DataFrame, fanout: int = FANOUT) -> str | None:
    """The hash over all shards' roots; levels are added until one node is left."""
    nodes = top.select(F.col("shard").alias("number"), "sha256")
    while nodes.limit(2).count() > 1:
        grouped = nodes.groupBy(F.expr(f"number div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("number", "sha256"))).alias("c"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["number"].cast("string"), x["sha256"])), ",")
        nodes = staged(grouped.select(F.col("up").alias("number"), F.sha2(text, 256).alias("sha256")), "top")
    one = nodes.first()
    return one["sha256"] if one else None


def differing(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(shard, n, status) of records that differ: corrupt, missing in two, or added in two. Equal branches are never opened."""
    def apart(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = (t.select("shard", "n", F.struct("length", "sha256").alias(name)) for t, name in ((a, "a"), (b, "b")))
        return a.join(b, ["shard", "n"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))

    at = staged(apart(one[-1], two[-1]), "apart")
    for a, b in zip(one[-2::-1], two[-2::-1], strict=True):
        open_ = at.select("shard", F.col("n").alias("up"))
        below = lambda t: t.withColumn("up", F.expr(f"n div {fanout}").cast("int")).join(open_, ["shard", "up"], "left_semi").drop("up")  # noqa: E731, B023
        at = staged(apart(below(a), below(b)), "apart")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("corrupt")
    return at.select("shard", "n", status.alias("status"))


def audited(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every record of the first replica, with the verdict on the second: intact, corrupt or missing; and added ones. Also (shard, sha256), the first's roots.

    Both are tables as write_warc stores them, of which the contents are read and hashed anew.
    """
    a, b = staged(leaves(first), "leaves"), staged(leaves(second), "leaves")
    one, two = tree(a), tree(b)
    roots = one[-1].select("shard", "sha256")
    if replica_root(one[-1]) == replica_root(two[-1]):
        return a.withColumn("status", F.lit("intact")), roots
    bad = staged(differing(one, two), "bad")
    old = a.join(bad, ["shard", "n"], "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    new = b.join(bad.where("status = 'added'"), ["shard", "n"])
    return old.unionByName(new), roots


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    return audited(first, second)[0]


def drilled(records: DataFrame) -> DataFrame:
    """A second copy with known damage, for a drill: records of pages divisible by 89 are lost, and of those divisible by 97 the last byte."""
    cut = F.when(F.col("page_id") % 97 == 0, F.expr("substring(content, 1, length(content) - 1)")).otherwise(F.col("content"))
    return replicated(records.where("page_id is null or page_id % 89 <> 0").withColumn("content", cut))


def audited_pages(pages: DataFrame) -> DataFrame:
    """page_id, shard, record, at, length, sha256, status, shard_root: pages written as WARC, copied with the drill's damage, and the copy audited.

    Without damage the roots agree and nothing would be descended; the drill has each run find damage that is known.
    """
    first = write_warc(pages)
    found, roots = audited(first, drilled(first))
    t = found.join(roots.withColumnRenamed("sha256", "shard_root"), "shard", "left")
    return t.select("page_id", "shard", F.col("n").cast("long").alias("record"), "at", "length", "sha256", "status", "shard_root")
