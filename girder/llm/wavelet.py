"""Token-id output as wavelet matrices, one per shard.

A shard's file holds the ids of consecutive documents as bit-planes. Plane k has bit k (highest first) of every
id in the order in which the earlier planes left them: zeros first, then ones, each stably. With counts of
ones per block, rank and select on the planes give the token at a place, the number of
times a token stands before a place, and the place of its n-th occurrence, without unpacking the ids.
Planes are compressed one by one, so a reader opens only what it needs.

Documents go to shards in ascending id order (nulls first, ties by hash of the text) by range
partitioning; hash of the text lets repeated ids be split. The files are rows of a table in the shared folder,
written by Spark's committer, so a lost executor leaves none half-written. A null text is an empty one; an empty table
gives no files. Repeated rows are documents each, one after the other; very long texts are encoded whole, and one longer than a shard makes its shard longer. Only id and text
are read, so other columns may have any names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.bytepairs import ByteEncoder
from girder.llm.text import kept_in_worker, text_batches
from girder.shared import staged

MAGIC = b"GWM1"
BLOCK = 512


def levels_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, levels: int, doc_ids: list, lengths: list[int]) -> bytes:
    """A shard's file: header, document table, then for each plane its size and compressed bits."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    table = press.compress(known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes())
    out = [MAGIC, struct.pack("<QQII", len(ids), len(doc_ids), levels, len(table)), table]
    for level in range(levels - 1, -1, -1):
        bits = ((ids >> level) & 1).astype(bool)
        plane = press.compress(np.packbits(bits, bitorder="little").tobytes())
        out += [struct.pack("<QI", len(ids) - int(np.count_nonzero(bits)), len(plane)), plane]
        # Places and not masks: bits without a pattern make masks slow.
        ids = np.concatenate([ids.take(np.flatnonzero(~bits)), ids.take(np.flatnonzero(bits))])
    return b"".join(out)


class WaveletMatrix:
    """A shard's file, opened; planes are unpacked when first used."""

    def __init__(self, content: bytes):
        import zstandard

        if content[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._open = zstandard.ZstdDecompressor().decompress
        self.n, n_docs, self.levels, size = struct.unpack_from("<QQII", content, 4)
        at = 4 + struct.calcsize("<QQII")
        table = self._open(content[at : at + size])
        known = np.frombuffer(table, np.uint8, n_docs)
        raw = np.frombuffer(table, "<i8", n_docs, n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(raw, known, strict=True)]
        self.lengths = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
        at += size
        self._packed, self.zeros, self._planes = [], [], {}
        for _ in range(self.levels):
            zeros, size = struct.unpack_from("<QI", content, at)
            at += struct.calcsize("<QI")
            self._packed.append(content[at : at + size])
            self.zeros.append(zeros)
            at += size

    def bits(self, level: int) -> np.ndarray:
        packed = np.frombuffer(self._open(self._packed[level]), np.uint8)
        return np.unpackbits(packed, count=self.n, bitorder="little").view(bool)

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bytes and the ones before each block."""
        if level not in self._planes:
            packed = np.frombuffer(self._open(self._packed[level]), np.uint8)
            ones = np.bitwise_count(packed).astype(np.int64)
            starts = np.arange(0, max(len(packed), 1), BLOCK // 8)
            sums = np.add.reduceat(ones, starts) if len(packed) else np.zeros(1, np.int64)
            self._planes[level] = packed, np.concatenate([[0], np.cumsum(sums)])
        return self._planes[level]

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        packed, before = self.plane(level)
        block = i // BLOCK
        part = packed[block * (BLOCK // 8) : i // 8]
        tail = int(packed[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(before[block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def bit_select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self.ones(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            before = self.ones(level, i)
            bit = self.ones(level, i + 1) - before
            token = token << 1 | bit
            i = self.zeros[level] + before if bit else i - before
        return token

    def count(self, token: int, end: int | None = None) -> int:
        """How often a token stands before place ``end``."""
        if token >> self.levels:
            return 0
        low, high = 0, self.n if end is None else end
        for level in range(self.levels):
            a, b = self.ones(level, low), self.ones(level, high)
            one = token >> (self.levels - 1 - level) & 1
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if one else (low - a, high - b)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0, of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        low = 0
        for level in range(self.levels):
            a = self.ones(level, low)
            low = self.zeros[level] + a if token >> (self.levels - 1 - level) & 1 else low - a
        at = low + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self.bit_select(level, one, at - self.zeros[level] if one else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last to the first."""
        found = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            bits, before = self.bits(level), np.empty_like(found)
            before[np.flatnonzero(~bits)] = found[: self.zeros[level]]
            before[np.flatnonzero(bits)] = found[self.zeros[level] :] | found.dtype.type(1 << (self.levels - 1 - level))
            found = before
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and store the shards' files: (part, seq, first, n_docs, n_tokens, content).

    part, seq: the shard's place in the order; first: ids before it in its part. A shard is closed with the document that
    brings it to ``shard_tokens``, so a task holds one shard at a time.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = kept_in_worker(("bytes", tokenizer), lambda: ByteEncoder(tokenizer)), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind)
        seq, first, ids, names, lengths, held = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            content = pack(np.concatenate(ids), encoder.levels, names, lengths)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": pa.array([first], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in text_batches(batches, 1):
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids += [found, end]
                names.append(doc_id)
                lengths.append(len(found) + 1)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield closed()
                    seq, first, ids, names, lengths, held = seq + 1, first + held, [], [], [], 0
        if names:
            yield closed()

    return staged(ranged.mapInArrow(run, "part int, seq int, first long, n_docs long, n_tokens long, content binary"), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards' files.

    The ids before a part are summed over the parts, of which there are as many as partitions when writing.
    """
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part] = at
        at += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, content in zip(*batch.columns, strict=True):
                shard = WaveletMatrix(content.as_py())
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + first.as_py() + starts[part.as_py()], pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "first", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
