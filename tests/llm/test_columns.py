"""Extra columns whose names clash with those that operators use inside, ties, and very long texts."""

import random

import pytest
from pyspark.sql import functions as F

from girder.llm import classifier, lines, neardup, neighbours, passages, pieces, quality, secrets, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHES = ["rid", "ids", "grams", "gram", "at", "spans", "base", "m", "up", "down", "key", "_id", "_k", "_doc", "_row", "_key", "words", "shard", "start", "n_tokens", "score", "kept", "component_id", "h", "v", "leaf", "rank", "id"]


def sorted_rows(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 90))), "s") for i in range(30)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + i, f"{i} {passage} own{i}", "s") for i in range(4)] + [(3, rows[3][1], "s"), (None, None, None), (200, "word " * 60_000, "t"), (201, f"token = abcdefgh1 ghp_Ab3dE6gH9jK2mN5pQ8sT1vW4\nline of many letters", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("name", ["pieces", "wavelet", "quality", "near", "secrets", "passages", "lines", "classifier"])
def test_other_columns_change_nothing(docs, name):
    run = {
        "pieces": lambda d: pieces.digests(d, public_tokenizers.path("piece_bpe_32k.model")),
        "wavelet": lambda d: wavelet.read_shards(wavelet.write_shards(d, public_tokenizers.path("byte_bpe_50k.json"))),
        "quality": quality.judge_documents,
        "near": neardup.near_duplicates,
        "secrets": secrets.scan_documents,
        "passages": passages.repeated_passages,
        "lines": lines.digests,
        "classifier": lambda d: classifier.measured(d, d.select("doc_id", F.lit(1).alias("quality")).where("doc_id < 9")),
    }[name]
    plain = run(docs.select("doc_id", "text", "source"))
    clashing = run(docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}))
    assert clashing.columns == plain.columns and sorted_rows(clashing) == sorted_rows(plain) and not plain.isEmpty()


def test_neighbours_with_other_columns_and_ties(spark):
    rows = [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(table.withColumns({c: F.lit(1) for c in ("v", "leaf", "rank", "score", "query_id")}), F.col("id") == 0).orderBy("query_id", "rank").collect()]
    assert got == [tuple(r) for r in neighbours.nearest(table, F.col("id") == 0).orderBy("query_id", "rank").collect()]
    # Nine others have the query's vector; of those at the next distance, 1, the smallest id comes last.
    assert [r[2] for r in got] == [6, 12, 18, 24, 30, 36, 42, 48, 54, min(i for i in range(60) if (i % 3, i % 2) in ((0, 1), (1, 0)))]


def test_passages_that_tie(spark):
    """Several texts hold one passage at several places beside equal words, so sorted suffixes tie."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{passage} {passage} end") for i in range(5)] + [(9, f"{passage} other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {(i, 0, 101) for i in range(5)} | {(9, 0, 50)}
    for how in (passages.Passages(), passages.Passages(bucket=1)):
        assert {tuple(r) for r in passages.repeated_passages(docs.repartition(4), how).collect()} == expected
