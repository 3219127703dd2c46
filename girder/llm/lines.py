"""Line dedup: a line that an earlier document has goes, and the first document that has it keeps it.

Lines are known by 128 bits of their key. They are dealt out by range of (hash, document, position), so a line that stands
everywhere fills many ranges. Each range is read through in that order, and a line goes whose document is not the first of
its hash. Where a hash goes on from one range to the next, its first document comes from the earlier one: there is at most one such hash a range, and these
are broadcast. What comes out of it are keep bitmaps, 64 lines a word, and words that keep all their lines are left out; the texts
meet them once, at the end. All of it are columns and windows.

Nulls: a null or empty text is one empty line; a null id is one document, after all others. A row's lines go by its id and
text, so repeated rows of one id keep and lose the same lines, and ids that tie are one document. An empty table gives an
empty one. Very long texts are split whole. Other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.text import LOWER, UPPER, let, packed, unpacked
from girder.shared import staged

#: Stripped at both ends of a line: U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
HASH = ["_h1", "_h2"]


@dataclass(frozen=True)
class Lines:
    """least: code points of a key that can go, at least."""

    least: int = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def content_key(text: Column) -> Column:
    """64 bits that tell the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, how: Lines) -> DataFrame:
    """_none, _id, _k, _at, _turn and the hash of every line that is long enough; _turn tells repeated rows apart."""
    keys = lines_of(F.translate(F.col("text"), UPPER, LOWER))
    rows = docs.select(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_id"), content_key(F.col("text")).alias("_k"), (F.monotonically_increasing_id() % 1024).cast("short").alias("_turn"), F.posexplode(keys).alias("_at", "_key"))
    rows = rows.withColumn("_key", F.btrim("_key", F.lit(BLANK))).where(F.length("_key") >= how.least)
    return rows.select("_none", "_id", "_k", "_turn", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def repeated_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """_id, _k, _at of the lines that go, from documents (doc_id, text)."""
    rows = staged(hashed_lines(docs, how), "lines")
    ranged = staged(rows.repartitionByRange(*HASH, "_none", "_id", "_at", "_k", "_turn").withColumn("_part", F.spark_partition_id()), "ranges")
    whole = F.struct(*HASH)
    ends = ranged.groupBy("_part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    # One row a range: the hashes with which a range begins and the one before it ends.
    going_on = ends.withColumn("before", F.lag("last").over(Window.orderBy("_part"))).where("first = before").select("first.*").distinct()
    document = F.struct("_none", "_id")
    firsts = ranged.join(F.broadcast(staged(going_on, "going_on")), HASH).groupBy(*HASH).agg(F.min(document).alias("_first"))
    line = Window.partitionBy("_part", *HASH).orderBy("_none", "_id", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("_here", F.first(document).over(line)).join(F.broadcast(staged(firsts, "firsts")), HASH, "left")
    return seen.where(document != F.coalesce("_first", "_here")).select("_id", "_k", "_at")


def keep_bitmaps(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """_id, _k, _keep: for every document that loses lines, the words (number, bits) of its lines of which one goes; a set bit keeps its line."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))
    words = repeated_lines(docs, how).groupBy("_id", "_k", F.expr("_at div 64").cast("int").alias("number")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("_id", "_k").agg(F.collect_list(F.struct("number", "bits")).alias("_keep"))


def words_of(bitmap: Column, lines: Column) -> Column:
    """All words of a bitmap in order, 64 words a block, so that a line's bit is found by its place."""
    every = F.lit(-1).cast("long")

    def block(b: Column) -> Column:
        held = F.map_from_entries(F.filter(bitmap, lambda x: F.floor(x["number"] / 64) == b))
        return let(held, lambda m: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.coalesce(F.try_element_at(m, (b * 64 + j).cast("int")), every)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 4096).cast("int")), block))


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines whose bits are set; all of them without a bitmap."""
    kept = let(words_of(bitmap, lines), lambda w: F.filter(lines, lambda _, i: F.getbit(F.get(w, F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1))
    return F.when(bitmap.isNull(), lines).otherwise(kept)


def deduplicated(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """_doc, the row of documents (doc_id, text), with _n_lines before, _n_dropped and _text, the lines that stay."""
    gone = keep_bitmaps(docs, how).withColumnsRenamed({"_id": "_of", "_k": "_of_k"})
    rows = docs.select(F.col("doc_id").alias("_id"), content_key(F.col("text")).alias("_k"), packed(docs).alias("_doc"))
    both = rows.join(gone.hint("shuffle_hash"), rows["_id"].eqNullSafe(gone["_of"]) & (rows["_k"] == gone["_of_k"]), "left")
    one = let(lines_of(F.col("_doc.text")), lambda a: let(kept_lines(a, F.col("_keep")), lambda k: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(k)).cast("long").alias("gone"), F.array_join(k, "\n").alias("text"))))
    return both.select("_doc", one.alias("_one")).select("_doc", F.col("_one.n").alias("_n_lines"), F.col("_one.gone").alias("_n_dropped"), F.col("_one.text").alias("_text"))


def without_repeated_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """The documents with the texts that stay, all other columns as they are."""
    return unpacked(deduplicated(docs, how), docs.columns, text=F.col("_text"))


def digests(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that stays."""
    return deduplicated(docs, how).select(F.col("_doc.doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_text", 256).alias("kept_sha256"))
