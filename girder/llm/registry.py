"""The queries op1 to op13 and the pipeline, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import centroids, classifier, fixity, lines, mixing, neardup, neighbours, passages, pieces, quality, secrets, trie, wavelet
from girder.llm.oracle import STATEMENTS
from girder.llm.text import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(documents(spark, sf_dir))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audited_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classifier.measured(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.scored(rows, classifier.fit(rows))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_mixing, op2_sentencepiece, op3_token_ids, op4_quality_rules, op5_nearest, op6_near_duplicates, op7_secret_scans, op8_warc_fixity, op9_quality_classifier, op10_repeated_passages, op11_prefix_trie, op12_line_dedup, op13_centroids, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(STATEMENTS)
