"""The training-data pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes the documents that the one before kept, and its decisions
take effect; all but the last return the columns of documents.

Null, empty and blank texts have no quality weight and go in the first stage.  Null doc_ids and sources
are kept like others.  Very long texts go through whole.  Of ties the first stage keeps all, and repeated
rows share their fate there; of equal or near texts one row stays.  Extra columns of any name travel
along, up to packing, which returns its own.  An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkpanel.llm import exact_dedup, importance, mixing, near_dedup, packing, shared, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; those that it rejects go."""
    return importance.drawn(docs, shared.table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return shared.keep_rows(docs, exact_dedup.deduplicate(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return shared.keep_rows(docs, near_dedup.near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids with their places in sequences."""
    return packing.pack(docs, tokens.vocabulary(), end_id=1)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashed models, registers and byte-pair ids are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again."""
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
