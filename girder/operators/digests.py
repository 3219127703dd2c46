"""Digests of tables as multisets of rows (JN-10, PRJ-28, EV-07).

A row has 128 bits of hash; a table's digest is their sum, so parts can be digested anywhere and added, order and partitions do not matter, and a row that
stands twice counts twice. Digests by range of a key say where two tables differ.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 4


def row_limbs(table: DataFrame) -> list[Column]:
    """128 bits of a row as four whole numbers: of its columns by name as JSON with nulls, and its types are not part of it."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"})
    hashed = F.md5(text)
    return [F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(LIMBS)]


def summed(limbs: list[Column]) -> list[Column]:
    return [F.sum(x).alias(f"s{k}") for k, x in enumerate(limbs)]


def digest_text(n: Column) -> Column:
    """Rows and the four sums modulo 2 ** 32 as text."""
    return F.concat_ws(":", n.cast("string"), *[(F.col(f"s{k}") % (1 << 32)).cast("long").cast("string") for k in range(LIMBS)])


def range_digests(table: DataFrame, ranges: Column) -> DataFrame:
    """range, n, digest: a digest for every value of ``ranges``, which a row's key decides."""
    t = table.select(ranges.alias("range"), *[x.alias(f"x{k}") for k, x in enumerate(row_limbs(table))])
    sums = t.groupBy("range").agg(F.count(F.lit(1)).alias("n"), *summed([F.col(f"x{k}") for k in range(LIMBS)]))
    return sums.select("range", "n", digest_text(F.col("n")).alias("digest"))


def differing_ranges(one: DataFrame, two: DataFrame, ranges: Column) -> DataFrame:
    """range, n_one, n_two of the ranges whose rows differ. Only sums are compared; nothing of the rows is shuffled."""
    a, b = (range_digests(t, ranges).withColumnsRenamed({"n": f"n_{s}", "digest": f"d_{s}"}).withColumnRenamed("range", f"r_{s}") for s, t in (("one", one), ("two", two)))
    both = a.join(b, F.col("r_one").eqNullSafe(F.col("r_two")), "full_outer").where(~F.col("d_one").eqNullSafe(F.col("d_two")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(F.coalesce("r_one", "r_two").alias("range"), zero("n_one"), zero("n_two"))


def table_digest(table: DataFrame) -> str:
    """One digest of a whole table: of its columns' names and its rows."""
    limbs = table.select(*[x.alias(f"x{k}") for k, x in enumerate(row_limbs(table))])
    sums = limbs.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"x{k}"), F.lit(0)).alias(f"s{k}") for k in range(LIMBS)])
    return hashlib.sha256(f"{sorted(table.columns)} {sums.select(digest_text(F.col('n'))).first()[0]}".encode()).hexdigest()
