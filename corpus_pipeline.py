"""The corpus pipeline: documents that the quality classifier accepts, one of each group of equal and
of nearly equal ones, without personal data, packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each stage's table to the
shared folder and reads it again as the next one's documents. All but the last return the columns of
documents, whatever further ones there are and whatever their names.

Defined cases, the same in every stage: a null text counts as empty and stays null where the document
stays; a null doc_id sorts after every other; rows that repeat a doc_id are documents of their own, of
which the dedup stages keep one where their texts are equal (the one read first); ties on a text go to
the smallest doc_id; long texts are read whole; an empty table gives an empty result. Each stage reads
its documents once, or stores what it needs of them, so none depends on the order of a second read.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from specloom.llm import exact_dedup, packing, pii, quality_classifier, simhash
from specloom.llm.common import cut


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps: all of them where there are no labels of both classes."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the one with the smallest doc_id; null and empty texts are equal."""
    return exact_dedup.exact_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints, the document with the smallest doc_id; texts without words have fingerprint 0 and are linked like any other."""
    return simhash.near_dedup(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; a text without any stays as it is, n_chars follows the text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and where each lies in its sequence; a document without text is its end id alone. Workers still hold memory of earlier stages, so fewer units are kept."""
    return packing.pack(packing.pieces(docs, tokenizers.path("byte_bpe_50k.json"), units_kept=150_000))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", dedup_exact),
    ("simhash near-dedup", dedup_near),
    ("pii", redact),
    ("best-fit packing", pack),
]

#: SQL cannot express co-training, SimHash components or tokenization; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{i}")
    return docs
