"""Rankings and counts for reports (WN-03, 05, 09; AG-12, 19; SRC-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.shared import staged


def first_seen(table: DataFrame, digest: str, *order: str) -> DataFrame:
    """The first row of every digest by the order given, with how many it stands for.

    An aggregation, so a content that stands everywhere is one row a task before it is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    t = table.groupBy(F.col(digest).alias("_digest")).agg(F.min_by(row, F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("copies"))
    return t.select("_row.*", "copies")


def bottom_k(table: DataFrame, value: str, by: list[str], k: int, tie: str = "id") -> DataFrame:
    """The k rows of least value of each group; undefined values take no part."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))
    return table.where(F.col(value).isNotNull()).withColumn("place", nth).where(F.col("place") <= k)


def flag_counts(table: DataFrame, flags: str) -> DataFrame:
    """flag, n over an array column of flags."""
    return table.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def running_sums(table: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add to each row the sums of columns over all rows before it in a global order.

    Rows are sorted by range into partitions, stored, and the totals of the partitions before go to each row, so no task sees the
    whole table. What is broadcast is one row a partition. Rows equal in ``order`` have no defined order among each other.
    """
    placed = staged(table.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **{f"_v_{k}": c for k, c in sums.items()}}), "ranges")
    totals = placed.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(totals), "_part").withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)) for k in sums})
    return out.drop("_part", *[f"_{x}_{k}" for k in sums for x in "vb"])


def dense_ids(table: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """Rows numbered from 1 without gaps, in a group or over all."""
    if by:
        return table.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return running_sums(table, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def last_values(table: DataFrame, order: list[str], columns: list[str], by: list[str]) -> DataFrame:
    """The last defined value of each column in the order given; none if it never has one."""
    at = F.struct(*order)
    return table.groupBy(*by).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def mean_and_groups(table: DataFrame, values: list[str], group: str, by: list[str]) -> DataFrame:
    """Means of columns and the number of distinct groups."""
    return table.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in values], F.count_distinct(group).alias("groups"))


def share_text(part: Column, whole: Column) -> Column:
    return F.concat_ws(" / ", part.cast("string"), whole.cast("string"))
