"""Operators on documents and vectors where a bound once cut the job."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import classifier, neighbours, registry, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_nearest_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(3)
    x = [(i, [float(v) for v in np.float32(rng.standard_normal(4))]) for i in range(300)]
    schema = "vec_id long, embedding array<float>"
    got = lambda rows: [tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, schema).repartition(3), F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    once = got(x)
    assert len(once) == 30
    assert got(x + x) == once
    near = once[0][2]
    assert got(x + [x[near]] * 40) == once
    # Twelve ids share a vector, and the smallest of them stands thirty times.
    same = [(1000 + i, x[0][1]) for i in range(12)]
    assert [r[2] for r in got(x + same + same[:1] * 30) if r[0] == 0] == list(range(1000, 1010))


def test_nearest_takes_an_id_with_many_vectors_once(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(1, 60)] + [(i, [1.0, float(i)]) for i in range(2, 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in neighbours.nearest(table, F.col("id") == 0, how=neighbours.Forest(rows_block=8)).orderBy("rank").collect()]
    assert [i for i, _ in got] == list(range(1, 11)) and got[0][1] == pytest.approx(0.001)


def test_token_ids_are_those_of_the_untouched_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    marker = "<|endoftext|>"
    texts = [f"end {marker} next", marker, f"{marker}{marker} x{marker}", f"ж {marker} 😀", "<|endoftext |> <|END|>", "plain  text's end", None]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, at = [], 0
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert expected[0][2] == 5
    assert sorted(tuple(r) for r in registry.op3_token_ids(spark, str(tmp_path)).collect()) == expected


def test_owners_count_where_a_candidate_stands_in_a_base_span(spark):
    copied, live = "ghp_Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2", "ghp_Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8"
    rows = [(i, f"token = {copied}", f"s{i}") for i in range(3)] + [(3, f"see {copied}", "s3"), (4, f"see {live}", "s4"), (5, f"token = {live}", "s4")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_documents(table).collect()}
    assert got == {0: "assign:0:36", 1: "assign:0:36", 2: "assign:0:36", 3: "", 4: "prefixed:4:32,mixed:4:32", 5: "assign:0:36"}
    texts = {r["doc_id"]: r["text"] for r in secrets.redacted_documents(table).collect()}
    assert texts[0] == "[SECRET]" and texts[3] == f"see {copied}" and texts[4] == "see [SECRET]"


def test_the_last_stage_decodes_what_it_encodes(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1, "Größe  ▁ 😀 one\ttwo", "s"), (2, "", "s"), (3, None, "s")]
    got = corpus_pipeline.encoding(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert len(got) == 3
    for r in got:
        ids = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)


def test_the_prior_is_that_of_all_permitted_labels(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    permitted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    priors, fit = [], classifier.fit_pu
    monkeypatch.setattr(classifier, "fit_pu", lambda p, u, prior, how: priors.append(prior) or fit(p, u, prior, how))
    classifier.train(docs, labels, classifier.Learning(labelled=20, steps=5))
    assert priors == [pytest.approx(sum(i % 3 == 0 for i in permitted) / len(permitted))]
