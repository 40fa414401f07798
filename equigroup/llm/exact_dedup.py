"""Exact deduplication by two passes over a Bloom filter, DataFrame functions only.

Pass 1 hashes every normalised text (SHA-256), sets three bits of one filter
word for it, and keeps the bits that at least two rows set: the filter of
possibly repeated hashes. It has ``filter_words`` words at most, whatever the
input, so it may be broadcast. Pass 2 probes it: rows whose bits are not all
kept are unique and pass straight through; only the others shuffle, by their
hash, and are compared by it. A filter that is too small for its input sends
more rows to the shuffle and changes no result: about 2 % of the unique rows at
seven rows a word.

Defined cases: null text is empty; texts are equal when they are identical
after deleting every white-space character (so all blank texts are equal); the
row with the most code points in its original text stays, then the smallest id
(a null id loses); of rows equal in both ``dedup_groups`` keeps the first and
``exact_dedup`` the one whose text has the greatest hash; any id will do; extra columns are carried
whole under their own names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import SPACE, col, id_text, materialize, pack_rows, unpack_rows

#: Words of 64 bits: 16 MB; about 15 million rows at 2 % needless shuffling.
FILTER_WORDS = 1 << 21


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE + "+", ""), 256)


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(0)), F.lit(words))


def _bits(digest: Column) -> list[Column]:
    """Three bit numbers of 0..63, from one hash."""
    h = F.xxhash64(digest, F.lit(1))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]


def repeated_filter(digests: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Pass 1: (word, bits) with the bits that two or more rows set; at most
    ``words`` rows. A hash's three bits are counted once a row, so partial
    counts shrink a hot hash to a row a task."""
    d = F.col("text_sha256")
    # an array_distinct keeps a row from counting one of its own bits twice
    set_bits = digests.select(_word(d, words).alias("word"), F.explode(F.array_distinct(F.array(*_bits(d)))).alias("bit"))
    twice = set_bits.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def flag_repeated(rows: DataFrame, bloom: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Pass 2: ``rows`` plus _repeated, false only where the hash is unique."""
    d = F.col("text_sha256")
    mask = F.lit(0).cast("long")
    for b in _bits(d):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
    probe = rows.withColumn("word", _word(d, words)).withColumn("_mask", mask)
    return (probe.join(F.broadcast(bloom), "word", "left")
            .withColumn("_repeated", F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
            .drop("word", "bits", "_mask"))


def _falling(number: Column) -> Column:
    """A long that falls as ``number`` rises, for every long (a negative would overflow)."""
    return F.bitwise_not(number)


def _order(text: Column, doc_id: Column) -> Column:
    """Larger is better: most code points, then the smallest id (null last),
    then the greatest hash of the text as it is."""
    return F.struct(F.length(text).alias("n"), _falling(doc_id).alias("i"), F.xxhash64(text).alias("h"))


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    The digests (no text) are written to the checkpoint folder once."""
    src = id_text(docs, id_col, text_col)
    digests = materialize(src.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), text_digest(F.col("text")).alias("text_sha256"))
        .withColumn("_row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    flagged = flag_repeated(digests, repeated_filter(digests, filter_words), filter_words)
    single = flagged.where(~F.col("_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.where("_repeated")
    # written out, so that Spark may split the rows of a hot text when it joins them
    groups = materialize(maybe.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("n_chars"), _falling(F.col("doc_id")).alias("i"), _falling(F.col("_row")).alias("r"))).alias("_best")))
    shared = maybe.join(groups, "text_sha256").select(
        "doc_id", _falling(F.col("_best.i")).alias("keep_id"), "group_size",
        (F.col("_row") == _falling(F.col("_best.r"))).alias("kept"), "text_sha256")
    return single.unionByName(shared)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows that stay, with their columns as they were. Unique rows pass
    through without a shuffle; of possibly repeated ones each task first keeps
    its best row of a hash, so a hot text costs one row a task."""
    d = text_digest(col(text_col)).alias("text_sha256")
    bloom = materialize(repeated_filter(docs.select(d), filter_words))
    order = _order(F.coalesce(col(text_col).cast("string"), F.lit("")), col(id_col).cast("long"))
    flagged = flag_repeated(docs.select(pack_rows(docs), d, order.alias("_order")), bloom, filter_words)
    single = flagged.where(~F.col("_repeated")).select("row")
    best = flagged.where("_repeated").groupBy("text_sha256").agg(F.max_by("row", "_order").alias("row")).select("row")
    return unpack_rows(single.unionByName(best), docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
