"""Byte-level encoding of columns against the tokenizers library itself."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from girder.llm import bytepairs, chunks
from girder.llm.text import buffer_of, text_batches

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = [" ", " ", " ", "\n", "\t", "\r", "'", "'s", "'re", "'ll", "'ve", "'t", "S", "s", "d", "m", "re", "v", "l", "é", "ß", "Ā", "\x85", "\xa0", "1", "²", "½", "99", "!", "?!", "_", "\x1c", "\x7f", "word", "longwordlongwordlong", " longwordlongwordlongword", "ª", "ȿ"]
ODD = ["ɀ", "ɏ", "ɐ", "😀", "<|endoftext|>", "<|", "|>", "\x00", "▁", "ʼ", "　", "́"]


@pytest.mark.parametrize("window", [7, 50, 1 << 21])
def test_ids_are_the_library_s(window, monkeypatch):
    from tokenizers import Tokenizer

    cut = chunks.windows
    monkeypatch.setattr(chunks, "windows", lambda buffer, bounds, safe: cut(buffer, bounds, safe, window))
    library, encoder, rng = Tokenizer.from_file(PATH), bytepairs.ByteEncoder(PATH, slots=1 << 11), random.Random(window)
    assert encoder.by_pre_token
    for _ in range(25):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(PLAIN + ODD if rng.random() < 0.2 else PLAIN, k=rng.randint(0, 60))) for _ in range(150)]
        for t, ids in zip(texts, encoder.encode(pa.array(texts, pa.string())), strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert encoder.encode(pa.array([], pa.string())) == [] and [len(x) for x in encoder.encode(pa.array([None, ""]))] == [0, 0]


def test_a_long_text_without_white_space(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    text = ",".join(str(rng.randrange(10**5)) for _ in range(4000)) + "'s" * 300 + "z" * 3000
    cut = chunks.windows
    monkeypatch.setattr(chunks, "windows", lambda buffer, bounds, safe: cut(buffer, bounds, safe, 100))
    got = bytepairs.ByteEncoder(PATH, slots=1 << 10).encode(pa.array([text]))[0]
    assert got.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_another_kind_of_tokenizer_is_left_to_the_library(tmp_path):
    from tokenizers import Tokenizer

    with open(PATH, encoding="utf-8") as f:
        made = json.load(f)
    made["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    encoder, texts = bytepairs.ByteEncoder(str(path)), ["word it's", " two", ""]
    assert not encoder.by_pre_token
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_are_bounded_by_bytes_and_hold_every_row():
    texts = ["x" * n for n in (0, 10, 500, 3, 0, 100, 100)] + [None]
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(8)), "text": pa.array(texts)})
    parts = list(text_batches([batch, batch.slice(0, 0)], 1, 200))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(8))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 200 for p in parts)
    buffer, bounds = buffer_of(batch.column(1).slice(2, 5))
    assert bounds.tolist() == [0, 500, 503, 503, 603, 703] and buffer[:703].tobytes() == b"x" * 703 and not np.any(buffer[703:])


def test_empty_tables_and_columns_give_none(spark):
    from girder.llm import pieces, wavelet

    none = spark.createDataFrame([], "doc_id long, text string, ids string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.digests(none, model).count() == 0
    both = pieces.encoded(none, model, decoded="back")
    assert both.columns == ["doc_id", "text", "ids", "back"] and both.count() == 0
    assert wavelet.read_shards(wavelet.write_shards(none, PATH)).count() == 0
    ids, offsets = pieces.Encoder(model).encode_ended(pa.array([], pa.string()))
    assert len(ids) == 0 and offsets.tolist() == [0]


def test_repeated_rows_and_very_long_texts_are_encoded_whole(spark):
    import sentencepiece

    from girder.llm import pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    long = "word " * 300_000 + "x" * 200_000
    rows = [(1, "two  words"), (1, "two  words"), (2, long), (3, None)]
    got = pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == 4
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "", add_eos=True)
