"""Exact token counts for every context limit.

Documents are aggregated by encoded length; running sums over that histogram
answer, for a context limit of L tokens, how many documents fit, how many
tokens they hold, how many tokens are left when each document is cut at L, and
which length a quantile has. The histogram has one row per distinct length; its
running sums are taken in blocks of lengths, so no task sees all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equigroup.llm.bpe import bpe_lengths
from equigroup.llm.common import materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Lengths in one block of the running sums.
BLOCK = 4096
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def length_histogram(docs: DataFrame, rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of all rows; partial counts are added in the scan's
    own stage, so a hot length costs one row a task. Null text has 0 tokens."""
    lengths = bpe_lengths(docs, rank_path, pattern, id_col, text_col)
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def running(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """``hist`` plus docs_le, tokens_le (documents of at most n_tokens and
    their tokens) and docs_ge, tokens_ge (suffix sums, own length included)."""
    h = hist.withColumn("_tok", F.col("n_tokens") * F.col("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / block))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_tok").alias("_bt"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per ``block`` lengths: a few even for texts of millions of tokens
    blocks = blocks.select("_block", F.coalesce(F.sum("_bd").over(after), F.lit(0)).alias("_ad"),
                           F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_at"),
                           F.sum("_bd").over(Window.partitionBy()).alias("all_docs"),
                           F.sum("_bt").over(Window.partitionBy()).alias("all_tokens"))
    own = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.select("*", F.sum("n_docs").over(own).alias("_sd"), F.sum("_tok").over(own).alias("_st")).join(blocks, "_block")
    ge_d, ge_t = F.col("_ad") + F.col("_sd"), F.col("_at") + F.col("_st")
    return out.select("n_tokens", "n_docs", ge_d.alias("docs_ge"), ge_t.alias("tokens_ge"),
                      (F.col("all_docs") - ge_d + F.col("n_docs")).alias("docs_le"),
                      (F.col("all_tokens") - ge_t + F.col("_tok")).alias("tokens_le"), "all_docs", "all_tokens")


def token_counts(docs: DataFrame, quantiles: tuple[float, ...] = QUANTILES, **source) -> DataFrame:
    """One row per context limit that is some document's length: context_limit,
    n_docs (of just that length), docs_within, tokens_within, docs_over,
    truncated_tokens (tokens left when every document is cut at the limit),
    dropped_tokens, total_docs, total_tokens and ``quantiles``: those of the
    given fractions whose value (least length with at least that share of the
    documents at or below it) is this limit. Limits between two rows follow
    exactly: truncated_tokens grows by docs_over a token (``at_limit``).

    Defined cases: null and empty texts have 0 tokens and are counted; repeated
    rows count each; an empty table gives an empty result."""
    r = running(materialize(length_histogram(docs, **source)))  # else texts are encoded for each use of it
    share = [F.ceil(F.lit(q) * F.col("all_docs")) for q in quantiles]
    hits: list[Column] = [F.when((F.col("docs_le") >= F.greatest(s, F.lit(1)))
                                 & (F.col("docs_le") - F.col("n_docs") < F.greatest(s, F.lit(1))), F.lit(float(q)))
                          for s, q in zip(share, quantiles)]
    over = F.col("docs_ge") - F.col("n_docs")
    cut = F.col("tokens_le") + over * F.col("n_tokens")
    return r.select(F.col("n_tokens").alias("context_limit"), "n_docs", F.col("docs_le").alias("docs_within"),
                    F.col("tokens_le").alias("tokens_within"), over.alias("docs_over"),
                    cut.alias("truncated_tokens"), (F.col("all_tokens") - cut).alias("dropped_tokens"),
                    F.col("all_docs").alias("total_docs"), F.col("all_tokens").alias("total_tokens"),
                    F.concat_ws(",", *[h.cast("string") for h in hits]).alias("quantiles"))


def at_limit(counts: DataFrame, limit: int) -> DataFrame:
    """docs_within, docs_over, truncated_tokens and dropped_tokens of any
    context limit, from ``token_counts``'s rows; one row (zeros if it is empty)."""
    below = F.col("context_limit") <= limit
    return counts.agg(
        F.coalesce(F.sum(F.when(below, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.sum(F.when(~below, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("context_limit"), F.lit(limit))), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(~below, F.col("n_docs") * (F.col("context_limit") - limit))), F.lit(0)).alias("dropped_tokens"))
