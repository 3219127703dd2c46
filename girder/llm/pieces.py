"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model whose pieces hold the white-space marker only at their front, no merge can cross
from a word into the marker of the next. A text is then a row of chunks, each a run of spaces with what
follows up to the next, and its ids are the chunks' ids in order. Each distinct chunk is
segmented once by the library and its ids joined back by position. The table is kept by a worker for all its tasks
and emptied when full, so its memory is bounded and nothing is shuffled; one table for the whole
corpus would shuffle every word of it twice, several times the size of the input.

Nulls: a null text is an empty one; an empty text has the end id alone. Repeated rows
give repeated rows. Very long texts are encoded whole; only their distinct chunks take table space. Texts that hold the marker itself or a
NUL, and all texts of a model that has a piece with an inner marker or splits otherwise, go whole to the library. Rows have no order
that could tie; an empty table gives an empty one. Other columns stay as they are or are left alone, and those named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.chunks import ColumnEncoder, holding
from girder.llm.text import kept_in_worker, text_batches

MARKER = "▁"


def separable(processor) -> bool:
    """Whether no piece has a marker after another character and a space becomes one marker, with one put before the text."""
    inner = any(MARKER in processor.id_to_piece(i).lstrip(MARKER) for i in range(processor.get_piece_size()))
    probe = [processor.encode(x, out_type=str) for x in ("a  b", " a", "a ")]
    return not inner and ["".join(x) for x in probe] == [f"{MARKER}a{MARKER}{MARKER}b", f"{MARKER}{MARKER}a", f"{MARKER}a{MARKER}"]


class Encoder(ColumnEncoder):
    """Encodes columns of texts with one model, the end id last."""

    def __init__(self, model: str, slots: int = 1 << 20):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        super().__init__(slots, np.dtype("<i4"))
        self.by_chunk = separable(self.processor)
        self.lone = np.array([self.processor.piece_to_id(MARKER)], self.kind)
        self.end = np.array([self.processor.eos_id()], self.kind)
        digits = [f"{i} ".encode() for i in range(self.processor.get_piece_size())]
        self.digits_of = np.array(list(map(len, digits)))
        wide = int(self.digits_of.max())
        self.digits = np.frombuffer(b"".join(d.ljust(wide) for d in digits), np.uint8).reshape(-1, wide)
        self.digit_there = np.arange(wide) < self.digits_of[:, None]

    def library(self, texts: list[str]) -> list[np.ndarray]:
        # A text as cut has one space more before it, which the library puts there itself.
        return [np.array(ids, self.kind) for ids in self.processor.encode([t[1:] for t in texts], num_threads=1)]

    def ids_of(self, chunks: list[bytes]) -> list[np.ndarray]:
        # For a lone marker the library would see an empty text.
        return [ids if len(c) > 1 else self.lone for c, ids in zip(chunks, self.library([c.decode() for c in chunks]), strict=True)]

    def cuts(self, w: np.ndarray, n: int, heads: np.ndarray) -> np.ndarray:
        space = w[:n] == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[heads] = True
        return np.flatnonzero(first)

    def safe(self, before: np.ndarray, here: np.ndarray) -> np.ndarray:
        return (here == 0x20) & (before != 0x20)

    def whole(self, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.by_chunk:
            return np.ones(len(bounds) - 1, bool)
        return holding(buffer, bounds, np.flatnonzero(buffer[: bounds[-1]] == 0), [MARKER.encode()])

    def encode_ended(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, end ids included, and where each text's begin and the last's end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        found = self.encode(spaced)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = [self.end if e else np.append(ids, self.end) for ids, e in zip(found, empty.tolist(), strict=True)]
        offsets = np.concatenate([[0], np.cumsum(list(map(len, parts)))]).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, self.kind), offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        flat, at = ids.tolist(), offsets.tolist()
        return self.processor.decode([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], num_threads=1) if len(at) > 1 else []

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each text's ids as decimal numbers with single spaces between."""
        text = self.digits[ids][self.digit_there[ids]].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.digits_of[ids])])[offsets].tolist()
        return [text[a : b - 1] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encoder_of(model: str) -> Encoder:
    return kept_in_worker(("pieces", model), lambda: Encoder(model))


def encoded(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add a column of token ids (array of int, end id last) to any table with a text column, and with ``decoded`` one of the text that the library decodes from them; ones of those names are replaced."""
    docs = docs.drop(ids, *([decoded] if decoded else []))
    schema = docs.withColumns({ids: F.array().cast("array<int>"), **({decoded: F.lit("")} if decoded else {})}).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for part in text_batches(batches, at):
            flat, offsets = encoder.encode_ended(part.column(at))
            new = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
            if decoded:
                new.append(pa.array(encoder.decode(flat, offsets), pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, ids, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the library's decoding of a column of ids, in place of any column of that name; null ids decode to null."""
    docs = docs.drop(text)
    schema = docs.withColumn(text, F.lit("")).schema
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = encoder_of(model).processor
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                out = [None if x.as_py() is None else processor.decode(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, text])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, ids never leaving the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for part in text_batches(batches, 1):
            ids, offsets = encoder.encode_ended(part.column(1))
            coded = [hashlib.sha256(x).hexdigest() for x in encoder.decimal(ids, offsets)]
            plain = [hashlib.sha256(x.encode()).hexdigest() for x in encoder.decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
