"""Digests, bit hashes and the distances between them (PRJ-07, 09, 11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def identifier(canonical_text: Column) -> Column:
    """The first 32 hex digits of a canonical text's digest."""
    return F.substring(sha256(canonical_text), 1, 32)


def rising_bits(values: Column, bits: int = 63) -> Column:
    """A long whose bit i says that value i + 1 is above value i."""
    one = lambda i: F.when(F.get(values, i + 1) > F.get(values, i), F.shiftleft(F.lit(1).cast("long"), 0) * 0 + F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(one(i)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming128(a: Column, b: Column) -> Column:
    """Distance of two structs (hi, lo) of longs."""
    return F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))


def mean_absolute_error(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))
