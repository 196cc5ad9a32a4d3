"""From raw documents to packed training sequences: quality, near-duplicates, secrets, packing.

Cases, by stage: texts that are null or empty are scored like any other, are never near-duplicates, hold no secrets, and are packed
as the end token alone. Rows that repeat an id and a text become one; texts that differ stay, also under one id, as do
rows without an id; ties go to the smaller id. Very long texts pass whole. Other columns, whatever their names, pass
through the first three stages; an empty table stays empty, and without labels nothing is rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstrata.functions.tables import materialize
from docstrata.llm.bpe import read_vocabulary
from docstrata.llm.minhash import deduplicated
from docstrata.llm.packing import pack_documents
from docstrata.llm.quality import keep_good
from docstrata.llm.secrets import redact_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject; it learns from the labels of those at hand, held-out ones excepted."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted anew."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(docs, read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("secret scans", secrets), ("best-fit packing", packing)]

#: SQL can't train the classifier or tokenize: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
