"""Repeated passages by a sparse suffix array.

Of a text's suffixes only those at minimisers are kept: in every ``least`` consecutive words the leftmost
smallest hash of ``gram`` words. A passage of ``least`` words thus keeps the same place wherever it stands. Kept
suffixes whose first gram occurs in another text are sorted, bucket by bucket of first gram; each is compared
with its neighbours of other texts on both sides, and the match extended left and right word by word. Where
both together reach ``least`` words, the span repeats. Longer passages are the union of such spans.

Equal texts are one text in the array, so a group of copies adds one set of suffixes, and all of it repeats.
A neighbour shares the longest right side, not always the span that reaches furthest to the left; where neighbours leave
a side open, all windows of ``least`` words around the bucket's suffixes are compared by hash, so no window
that two texts share is lost. Large buckets are compared so by aggregation over the cluster, so none is one task's work.

Nulls: a null text is an empty one and repeats nothing; null ids are one id. A text repeats across
documents only if another id has the passage: repeated rows of one id are one document. Texts under
``least`` words and an empty table give no rows. Very long texts are taken whole. Grams that tie in a window count at their leftmost place; suffixes that tie are
sorted by text and place, and which of them stand beside each other changes nothing. Only id and text are read, so other columns may have any names. Windows are known
by 128 bits (those of the gram and those of the window), words of neighbours by 32 bits each over at least ``least - gram`` words; they are not compared as texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.neardup import mixed
from girder.llm.text import buffer_of, text_batches
from girder.shared import staged


@dataclass(frozen=True)
class Passages:
    """least: words of a repeated passage, at least. gram: words that a kept suffix begins with.

    bucket: suffixes with one first gram that a task may sort, those of a text that are alike on both sides counting once; more of them are compared by aggregation.
    """

    least: int = 50
    gram: int = 16
    bucket: int = 50_000

    @property
    def reach(self) -> int:
        return self.least - self.gram


def word_hashes(text: bytes) -> np.ndarray:
    import xxhash

    found = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def minimisers(w: np.ndarray, how: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes, ascending, and the hashes of their first grams."""
    many = len(w) - how.gram + 1
    if len(w) < how.least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    factors = mixed(np.arange(1, how.gram + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    g = np.zeros(many, np.uint64)
    for i in range(how.gram):
        g += w[i : i + many] * factors[i]
    g = mixed(g)
    width = how.reach + 1
    at = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(many - width + 1)
    at = np.unique(at)
    return at, g[at]


def distinct_suffixes(w: np.ndarray, at: np.ndarray, g: np.ndarray, how: Passages) -> dict[tuple[int, bytes, bytes], list[int]]:
    """Places of the suffixes at ``at`` by gram, what follows it and what precedes it (nearest first), 4 bytes a word."""
    short = (w >> np.uint64(32)).astype(">u4")
    back = short[::-1]
    out: dict[tuple[int, bytes, bytes], list[int]] = {}
    for p, h in zip(at.tolist(), g.view(np.int64).tolist(), strict=True):
        out.setdefault((h, short[p + how.gram : p + how.least].tobytes(), back[len(w) - p : len(w) - p + how.reach].tobytes()), []).append(p)
    return out


def gram_counts(w: np.ndarray, how: Passages) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a text's kept suffixes, and how many distinct suffixes each has."""
    at, g = minimisers(w, how)
    grams, n = np.unique(g, return_counts=True)
    if (again := np.isin(g, grams[n > 1])).any():
        kinds = np.fromiter((h for h, _, _ in distinct_suffixes(w, at[again], g[again], how)), np.int64).view(np.uint64)
        several, m = np.unique(kinds, return_counts=True)
        n[np.searchsorted(grams, several)] = m
    return grams.view(np.int64), n


def with_grams(texts: DataFrame, how: Passages) -> DataFrame:
    """Rows (doc_id, rid, text) as doc_id, rid, the number of words, the distinct grams of the text's kept suffixes and how many of these each has."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_batches(batches, 2):
            words = [word_hashes(t.as_py()) for t in part.column(2)]
            grams, counts = zip(*[gram_counts(w, how) for w in words], strict=True)
            lists = [pa.array(grams, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(len, words)), pa.int32()), *lists], ["doc_id", "rid", "words", "grams", "counts"])

    return texts.select("doc_id", "rid", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, rid binary, words int, grams array<long>, counts array<long>")


SUFFIX = "gram long, after binary, before binary, rid binary, at array<int>"


def suffixes(texts: DataFrame, how: Passages) -> DataFrame:
    """Kept suffixes of texts (rid, text, grams) whose gram is listed: what follows the gram, what precedes it, and all places in the text where it is so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            out: list[tuple] = []
            for i, (rid, text, wanted) in enumerate(zip(*batch.columns, strict=True)):
                w = word_hashes(text.as_py())
                at, g = minimisers(w, how)
                keep = np.isin(g.view(np.int64), wanted.values.to_numpy())
                out += [(*k, rid.as_py(), places) for k, places in distinct_suffixes(w, at[keep], g[keep], how).items()]
                if len(out) >= 8192 or i + 1 == batch.num_rows:
                    for k in range(0, len(out), 8192):
                        columns = list(zip(*out[k : k + 8192], strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["gram", "after", "before", "rid", "at"])
                    out = []

    return texts.select("rid", F.col("text").cast("binary").alias("text"), "grams").mapInArrow(run, SUFFIX)


class Suffixes:
    """Suffixes of whole buckets as arrays: gram, code (a number for each text), their places (``starts`` says where each one's begin), and the words beside the gram."""

    def __init__(self, table: pa.Table, how: Passages):
        t = table.combine_chunks()
        self.gram = t.column("gram").to_numpy()
        places = t.column("at").combine_chunks() if isinstance(t.column("at"), pa.ChunkedArray) else t.column("at")
        self.places = places.flatten().to_numpy().astype(np.int64)
        self.starts = np.r_[0, np.cumsum(pc.list_value_length(places).to_numpy())]
        texts = pc.dictionary_encode(t.column("rid")).combine_chunks()
        self.texts, self.code = texts.dictionary, texts.indices.to_numpy()
        self.after, self.n_after = padded(t.column("after"), how.reach)
        self.before, self.n_before = padded(t.column("before"), how.reach)


    def spans(self, found: np.ndarray) -> np.ndarray:
        """(code, start, end) at all places of rows (row, start, end from the gram on)."""
        row = found[:, 0]
        many = self.starts[row + 1] - self.starts[row]
        which = np.repeat(np.arange(len(found)), many)
        at = self.places[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.starts[row][which]]
        return np.stack([self.code[row][which], at + found[which, 1], at + found[which, 2]], axis=1)


def padded(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, 4 bytes each, as rows of a matrix, and how many each row has."""
    flat, starts = buffer_of(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, 4 * width)
    n = np.diff(starts) // 4
    words = flat[: len(flat) // 4 * 4].view(np.uint32)
    at = np.minimum(starts[:-1, None] // 4 + np.arange(width), len(words) - 1)
    return np.where(np.arange(width) < n[:, None], words[at], np.uint32(0)), n


def agreeing(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Leading words that rows i and j share."""
    same = (m[i] == m[j]) & (np.arange(m.shape[1]) < np.minimum(n[i], n[j])[:, None])
    return np.where(same.all(axis=1), m.shape[1], (~same).argmax(axis=1))


def matches(rows: Suffixes, how: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Spans (row, start, end from the gram on) where sorted suffixes match the nearest suffix of another text before or after them.

    Also which suffixes a match covers as far as a passage of ``least`` words around them can go.
    """
    n, gram, code = len(rows.gram), rows.gram, rows.code
    fresh = np.r_[True, code[1:] != code[:-1]]
    starts = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    previous = np.where(run > 0, starts[run] - 1, -1)
    following = np.where(run + 1 < len(starts), np.append(starts, n)[run + 1], -1)
    found, whole = [], np.zeros(n, bool)
    for other in (previous, following):
        i = np.flatnonzero((other >= 0) & (gram == gram[other]))
        j = other[i]
        right, left = agreeing(rows.after, rows.n_after, i, j), agreeing(rows.before, rows.n_before, i, j)
        hit = left + how.gram + right >= how.least
        i, left, right = i[hit], left[hit], right[hit]
        whole[i] |= (left == rows.n_before[i]) & (right == rows.n_after[i])
        found.append(np.stack([i, -left, how.gram + right], axis=1))
    return np.concatenate(found), whole


def window_keys(rows: Suffixes, how: Passages, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(some rows, reach + 1): a hash of the ``least`` words that begin k before the suffix, and whether the text has them."""
    prime = np.uint64(0x9E3779B97F4A7C15)
    sides = []
    for m in (rows.before[some], rows.after[some]):
        h = np.zeros((len(some), how.reach + 1), np.uint64)
        for k in range(how.reach):
            h[:, k + 1] = mixed(h[:, k] * prime + m[:, k] + np.uint64(1))
        sides.append(h)
    k = np.arange(how.reach + 1)
    gram = rows.gram[some].view(np.uint64)[:, None]
    keys = mixed(mixed(mixed(gram + k.astype(np.uint64)) * prime + sides[0]) * prime + sides[1][:, how.reach - k])
    return keys, (k <= rows.n_before[some][:, None]) & (how.reach - k <= rows.n_after[some][:, None])


def finished(rows: Suffixes, how: Passages, some: np.ndarray) -> np.ndarray:
    """All spans (row, start, end from the gram on) of ``least`` words that whole buckets of suffixes share between texts, by their hashes."""
    keys, has = window_keys(rows, how, some)
    code, hit = rows.code[some], np.zeros_like(has)
    for k in range(how.reach + 1):
        i = np.flatnonzero(has[:, k])
        if len(i) > 1:
            i = i[np.argsort(keys[i, k], kind="stable")]
            starts = np.flatnonzero(np.r_[True, keys[i[1:], k] != keys[i[:-1], k]])
            several = np.minimum.reduceat(code[i], starts) != np.maximum.reduceat(code[i], starts)
            hit[i, k] = np.repeat(several, np.diff(np.r_[starts, len(i)]))
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return np.stack([some[i], 1 - last, how.least - first], axis=1)


def compared(ordered: DataFrame, how: Passages) -> DataFrame:
    """(rid, start, stop) of a table of whole buckets (suffixes of one gram), sorted within its partitions.

    Neighbours first; buckets in which a suffix is left that its neighbours do not cover on both
    sides are then finished. A task holds a batch and one bucket, of at most ``bucket`` rows.
    """
    names = [x.split()[0] for x in SUFFIX.split(", ")]

    def spans(table: pa.Table) -> pa.RecordBatch:
        rows = Suffixes(table, how)
        found, whole = matches(rows, how)
        again = np.flatnonzero(np.isin(rows.gram, rows.gram[~whole]))
        if len(again):
            found = np.concatenate([found, finished(rows, how, again)])
        found = np.unique(rows.spans(np.unique(found, axis=0)), axis=0)
        return pa.RecordBatch.from_arrays([rows.texts.take(pa.array(found[:, 0])), pa.array(found[:, 1], pa.int32()), pa.array(found[:, 2], pa.int32())], ["rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                gram = part.column(0).to_numpy()
                if held and held[0].column(0)[0].as_py() == gram[-1]:
                    held.append(part)
                    continue
                cut = int(np.searchsorted(gram, gram[-1])) if held or gram[0] != gram[-1] else 0
                if held or cut:
                    yield spans(pa.Table.from_batches([*held, part.slice(0, cut)]))
                held = [part.slice(cut)]
        if held:
            yield spans(pa.Table.from_batches(held))

    return ordered.select(*names).mapInArrow(run, "rid binary, start int, stop int")


def compared_apart(kept: DataFrame, how: Passages) -> DataFrame:
    """The same of a stored table of large buckets: every window is a row, and equal ones are found by aggregation.

    The windows that several texts share are stored, so that the join back to the rows can be split where one window is very common.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(how.reach)))
    rows = kept.withColumn("k", k).where((F.length("before") >= 4 * F.col("k")) & (F.length("after") >= 4 * (how.reach - F.col("k"))))
    window = F.xxhash64("k", F.expr("substring(before, 1, 4 * k)"), F.expr(f"substring(after, 1, 4 * ({how.reach} - k))"))
    rows = rows.select("gram", window.alias("window"), "rid", "at", "k")
    shared = rows.groupBy("gram", "window").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).where("x < y").select("gram", "window")
    # Rows times windows would pass for as small as their stored table and be broadcast.
    hits = rows.hint("merge").join(staged(shared, "windows"), ["gram", "window"]).select("rid", F.explode(F.transform("at", lambda p: (p - F.col("k")).cast("int"))).alias("start"))
    return hits.select("rid", "start", (F.col("start") + how.least).cast("int").alias("stop"))


def joined_spans(spans: DataFrame) -> DataFrame:
    """(rid, start, stop): overlapping or touching spans of a text made one."""
    before = Window.partitionBy("rid").orderBy("start", "stop")
    t = spans.withColumn("reached", F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("part", F.count_if(F.col("reached").isNull() | (F.col("start") > F.col("reached"))).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.groupBy("rid", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("rid", "start", "stop")


def repeated_passages(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) of every span of documents (doc_id, text) that another document has too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("rid"), text.alias("text"))
    long_enough = F.length("text") >= 2 * how.least - 1
    ids = staged(with_grams(rows.where(long_enough), how).where(F.col("words") >= how.least), "grams")
    # One row of each text: that of its smallest id. A text of several ids repeats as a whole.
    several = (F.min("doc_id") < F.max("doc_id")) | ((F.count("doc_id") > 0) & (F.count_if(F.col("doc_id").isNull()) > 0))
    texts = ids.groupBy("rid").agg(F.min("doc_id").alias("_id"), F.coalesce(several, F.lit(False)).alias("copied"), F.first("words").alias("words"), F.first("grams").alias("grams"), F.first("counts").alias("counts"))
    texts = staged(texts, "texts", ids.agg(F.sum(F.size("grams") + 8)).first()[0] // 8 if not ids.isEmpty() else 0)
    grams = texts.select(F.explode(F.arrays_zip("grams", "counts")).alias("g"), "rid", "_id").select("g.grams", "g.counts", "rid", "_id").withColumnRenamed("grams", "gram")
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("counts").alias("suffixes")).where("n > 1")
    shared = staged(shared.select("gram", (F.col("suffixes") > how.bucket).alias("large")), "shared")
    if not ids.groupBy("rid", "doc_id").count().where("count > 1").isEmpty():  # rows that repeat both id and text: one of them is enough, and only one a task is shuffled
        rows = rows.where(long_enough).groupBy("doc_id", "rid").agg(F.first("text").alias("text"))

    def kept(large: bool) -> DataFrame:
        wanted = grams.hint("merge").join(shared.where(F.col("large") == large), "gram").groupBy("rid", "_id").agg(F.collect_list("gram").alias("grams"))
        wanted = wanted.withColumnRenamed("rid", "_rid")
        return suffixes(rows.join(wanted, (rows["rid"] == wanted["_rid"]) & rows["doc_id"].eqNullSafe(wanted["_id"])), how)

    spans = compared(kept(False).repartition("gram").sortWithinPartitions("gram", "after", "before", "rid", "at"), how)
    if not shared.where("large").isEmpty():
        spans = spans.unionByName(compared_apart(staged(kept(True), "large"), how))
    whole = texts.where("copied").select("rid", F.lit(0).alias("start"), F.col("words").alias("stop"))
    merged = joined_spans(spans.unionByName(whole))
    out = ids.select("doc_id", "rid").distinct().join(merged, "rid")
    return out.select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"))
