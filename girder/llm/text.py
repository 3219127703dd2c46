"""Column helpers on texts. Words are maximal runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """All words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame) -> Column:
    """A row as one struct, so that no column of it can clash with one added."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def numbered(docs: DataFrame) -> DataFrame:
    """(_row, _doc): packed rows under a number."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), packed(docs).alias("_doc"))


def text_key(text: Column) -> Column:
    """128 bits of a text; a null text has those of an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def unpacked(packed: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows of a packed table again, with some columns new."""
    return packed.select(*[(new[c] if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in columns])


def kept_in_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, kept for the later tasks of a Python worker; one object at a time, so memory stays that of one.

    Functions reach workers by value, with fresh globals for each task; the interpreter's own module outlives them.
    """
    held = sys.__dict__.setdefault("_girder_kept", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def text_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices whose texts have about ``most`` bytes together; one text longer than that is a slice of its own.

    What a worker makes of a slice is a multiple of its bytes, so this bounds a worker's memory by the longest text.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def buffer_of(texts: pa.Array, padding: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end with zeros after them, and where each text begins and the last ends; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    out = np.zeros(int(offsets[-1] - offsets[0]) + padding, np.uint8)
    if data is not None:
        out[:-padding] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]
