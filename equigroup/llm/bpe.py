"""Byte-level BPE encoding and decoding with the tiktoken library.

``bpe_round_trip`` encodes whole texts by a local rank file (its path is a
parameter; the file's bytes are broadcast, about 1 MB whatever the input) and
decodes the ids back to raw bytes. Rows are independent: one scan, no shuffle.

Defined cases: null text counts as empty and has no ids; rows with a null id,
repeated rows and extra columns are allowed (extra columns are not read); very
long texts are cut at safe places (see ``tokens``), never shortened; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from equigroup.llm.common import id_text, shared_bytes
from equigroup.llm.tokens import id_list, rank_encoding, tiktoken_pieces

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN,
                   id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (decimal ids joined
    by commas), decoded_sha256 (of the decoded bytes), and with ``keep_ids``
    the ids (array<int>) and the decoded bytes (binary)."""
    ranks = shared_bytes(docs.sparkSession, rank_path)
    schema = DIGESTS + (", ids array<int>, decoded binary" if keep_ids else "")

    def run(batches):
        encoding = rank_encoding(ranks.value, pattern)
        pieces = tiktoken_pieces(encoding)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                ids = id_list(pieces.ids(text.as_py()))
                raw = encoding.decode_bytes(ids)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(raw).hexdigest()) + ((ids, raw) if keep_ids else ()))
            cols = list(zip(*rows)) if rows else [()] * (5 if keep_ids else 3)
            arrays = [batch.column("doc_id"), pa.array(cols[0], pa.int64()),
                      pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN,
               id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of stored ids; a null list decodes to empty
    bytes, an id outside the vocabulary is an error."""
    from pyspark.sql import functions as F
    ranks = shared_bytes(rows.sparkSession, rank_path)

    def run(batches):
        encoding = rank_encoding(ranks.value, pattern)
        for batch in batches:
            raw = [encoding.decode_bytes(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())],
                                             ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def bpe_lengths(docs: DataFrame, rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row's whole text."""
    ranks = shared_bytes(docs.sparkSession, rank_path)

    def run(batches):
        pieces = tiktoken_pieces(rank_encoding(ranks.value, pattern))
        for batch in batches:
            n = [len(pieces.ids(text.as_py())) // 4 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
