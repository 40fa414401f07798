"""The corpus pipeline: documents in, packed training sequences out.

Stages: a quality classifier rejects bad documents, exact and near duplicates
go, personal data is replaced by its kind, and what is left is tokenised and
packed into sequences. Each stage takes all that its predecessor kept, as it was
written; all but the last return the columns of ``documents``.

Null texts count as empty, rows that share an id or have none are documents of
their own (copies and near copies go as any other's), repeated rows are copies,
and empty tables give empty results: the operators' modules say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equigroup.llm.common import materialize, read_table
from equigroup.llm.exact_dedup import exact_dedup
from equigroup.llm.packing import best_fit_pack
from equigroup.llm.pii import redact
from equigroup.llm.quality import fit_quality, keep_good
from equigroup.llm.simhash import near_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7 under a model of ``labels.quality``."""
    return keep_good(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts (white space aside)."""
    return exact_dedup(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 2 bits."""
    return near_dedup(docs, words=3, bits=2)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in angle brackets."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return best_fit_pack(docs, keep_ids=False, added_tokens=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier's fit is no SQL; tests/llm holds the pipeline against a plain
#: Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the
    checkpoint folder and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
