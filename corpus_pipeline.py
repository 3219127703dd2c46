"""The document pipeline: quality rules, near-dedup, secret scans, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and the whole of what its predecessor kept; all but the last return the
columns of documents. Between stages the rows are written to the shared folder and read again.

In every stage: a null text is an empty one, null ids and sources are values like others, repeated rows are rows each unless a stage removes
copies, ties never depend on the order or the partitions of the table, an empty table gives an empty one, texts are taken whole
however long, and columns beyond (doc_id, text, source) stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from girder.llm import mixing, neardup, pieces, quality, secrets
from girder.llm.text import documents
from girder.shared import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null or empty text fails the base rule; repeated rows stay or go together."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of a group the row of the smallest id stays, of several such the first by digest of its text; texts without words are linked with nothing and all stay.
    """
    return neardup.without_near_duplicates(docs, neardup.PIPELINE)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark, and n_chars as they are then; rows without any stay as they are, null texts too."""
    return secrets.redacted_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, n_chars as they are then; a document taken more than once stands more than once, one without words not at all."""
    return mixing.mixed_texts(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with ``ids``, its token ids, and ``decoded``, the text that they decode to; columns of those names are replaced."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encoded(docs, model, decoded="decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing", mixing_sources),
    ("encoding", encoding),
]
#: SQL can express neither the hashed signatures, the seeded choice of blocks nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
