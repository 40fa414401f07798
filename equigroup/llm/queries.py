"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equigroup.llm.common import read_table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.bpe import bpe_round_trip
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), keep_ids=False)


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.packing import best_fit_pack
    return best_fit_pack(read_table(spark, sf_dir, "documents"), keep_ids=False, added_tokens=True)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of all documents' lengths by the 50k byte-level vocabulary."""
    from equigroup.llm.lengths import token_counts
    return token_counts(read_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) that says the template's own strings."""
    from equigroup.llm.chat import chat_report, format_chat
    own = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role",
                                    r"r'\### Assistant: </turn> ok' AS text")
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_report(format_chat(said.unionByName(own)))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.fingerprints import edited_fingerprints
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.quality import fit_quality, score_quality
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.html_extract import extract_main, fit_labeller
    pages = read_table(spark, sf_dir, "pages")
    return extract_main(pages, fit_labeller(pages))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.exact_dedup import dedup_groups
    return dedup_groups(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.pii import pii_report
    return pii_report(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.simhash import near_groups
    return near_groups(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id divisible by 7 move to the next of ten labels; those with
    an id divisible by 100 are the anchors."""
    from equigroup.llm.hard_negatives import mine_hard_negatives
    moved = "IF(vec_id % 7 = 0, (CAST(label AS LONG) + 1) % 10, label)"
    rows = read_table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", f"{moved} AS label")
    return mine_hard_negatives(rows, F.col("id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.toxicity import fit_toxicity, score_toxicity
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equigroup.llm.whitening import whiten
    return whiten(read_table(spark, sf_dir, "embeddings"))


def all_queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def all_oracles() -> dict[str, str]:
    from equigroup.llm import chat, exact_dedup, hard_negatives
    return {"op4_chat_format": chat.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
