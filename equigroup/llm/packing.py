"""Best-fit packing of token sequences into rows of a fixed length.

Lengths are whole numbers up to the sequence length, so best-fit decreasing
needs only the number of pieces of each length: ``plan`` runs it over those
counts (at most ``capacity`` of them, whatever the input) and keeps equal open
bins together as one run. A segment tree over the remaining capacities finds
the tightest open bin in logarithmic time. Its placements are ranges of ranks
within a length; Spark numbers the pieces of each length and every task looks
its pieces up. The result is that of best-fit decreasing over all pieces at
once, and no task holds more than a bucket of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equigroup.llm.common import id_text, materialize
from equigroup.llm.tokens import tokenizers_pieces

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
CAPACITY = 1024
#: Pieces that one bucket of the numbering holds at about.
BUCKET_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN,
                 end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """The ids of every whole text plus ``end_id``, cut into pieces of at most
    ``capacity``: all full but the first, which holds the rest. One row per
    piece: doc_id, piece, start, length, ids_crc32 (of the little-endian
    unsigned 32-bit ids) and with ``keep_ids`` the ids. A null text is empty:
    one piece that holds ``end_id`` alone. ``added_tokens``: see
    ``tokenizers_pieces``; the library's plain call has them."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    with open(tokenizer_path, "rb") as f:  # a vocabulary of about 2 MB
        shared = docs.sparkSession.sparkContext.broadcast({"file": f.read()})
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        held = shared.value  # one a Python worker, so its later tasks find the tokenizer and the pieces it knows
        if "tokens" not in held:
            held["tokens"] = tokenizers_pieces(held["file"], pattern, added_tokens)
        tokens = held["tokens"]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packed = tokens.ids(text.as_py()) + end
                n, start, k = len(packed) // 4, 0, 0
                length = n % capacity or min(n, capacity)
                while start < n:
                    ids = packed[4 * start:4 * (start + length)]
                    out.append((doc, k, start, length, zlib.crc32(ids))
                               + ((np.frombuffer(ids, "<u4").astype(np.int32),) if keep_ids else ()))
                    start, length, k = start + length, capacity, k + 1
            cols = list(zip(*out)) if out else [()] * (6 if keep_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names[:len(cols)])

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while
    open bins with that much room left exist."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.any = np.zeros(2 * self.size, bool)

    def put(self, room: int, there: bool) -> None:
        i = self.size + room
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room that is at least ``need`` and has an open bin."""
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (pieces of each length), first bin
    number 0. Rows (length, first rank, pieces a bin, first bin, offset): the
    pieces of that length from that rank on go to bins from ``first bin`` on,
    so many in each, the first at ``offset``."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first bin, bins)]
    tree, out, bins = OpenBins(capacity), [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit in {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # open as many new bins as the rest fills
                each = capacity // length
                first, n, room = bins, -(-left // each), capacity
                bins += n
            else:
                each = room // length
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.put(room, False)
            full, some = min(n, left // each), left % each
            placed = full * each
            out.append((length, rank, each, first, capacity - room))
            keep(room - each * length, first, full)
            if full < n and placed < left:  # one bin takes the last few
                placed += some
                keep(room - some * length, first + full, 1)
                full += 1
            keep(room, first + full, n - full)
            rank, left = rank + placed, left - placed
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them, 1..capacity) with
    sequence_id and offset of best-fit decreasing over all of them. Repeated
    rows are pieces of their own; ties go by ``order`` within a bucket of the
    numbering, so equal tables get equally many sequences. Writes ``pieces`` to
    the checkpoint folder once. An empty table gives an empty result."""
    spark = pieces.sparkSession
    base = materialize(pieces)
    columns = base.columns
    per_length = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
                  base.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placements = plan(per_length, capacity)
    buckets = max(1, -(-sum(per_length.values()) // BUCKET_ROWS))

    numbered = base.select(F.struct(*columns).alias("row"), F.col("length").alias("_len"),
                           F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("_bucket"))
    sizes = numbered.groupBy("_len", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_len").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_len", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_len", "_bucket").orderBy(*[F.col(f"row.{c}") for c in order])
    ranked = (numbered.withColumn("_k", F.row_number().over(within) - 1)
              .join(firsts, ["_len", "_bucket"])
              .select("row.*", (F.col("_first") + F.col("_k")).alias("_rank")))

    table = np.array(placements or [(0, 0, 1, 0, 0)], np.int64)
    at = np.lexsort((table[:, 1], table[:, 0]))
    lengths, ranks, each, first, offset = (np.ascontiguousarray(c) for c in table[at].T)
    starts = np.searchsorted(lengths, np.arange(capacity + 2))
    plan_rows = spark.sparkContext.broadcast((starts, ranks, each, first, offset))

    def place(batches):
        starts, ranks, each, first, offset = plan_rows.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            lo, hi = starts[length], starts[length + 1]
            while True:  # the last placement of the length that starts at or before the rank
                mid = (lo + hi) // 2
                open_ = hi - lo > 1
                if not open_.any():
                    break
                up = open_ & (ranks[np.minimum(mid, len(ranks) - 1)] <= rank)
                lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
            bin_, slot = np.divmod(rank - ranks[lo], each[lo])
            keep = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(first[lo] + bin_), pa.array(offset[lo] + slot * length)],
                [*columns, "sequence_id", "offset"])

    schema = base.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def best_fit_pack(docs: DataFrame, keep_ids: bool = True, capacity: int = CAPACITY, **names) -> DataFrame:
    """Tokenise ``docs`` and pack all pieces: see ``token_pieces`` and ``pack``.

    Defined cases: null or empty text is one piece with the end id alone; a
    null id is an id like any other; repeated rows are packed once for each;
    extra columns are not read; no document is dropped or shortened."""
    return pack(token_pieces(docs, keep_ids=keep_ids, capacity=capacity, **names), capacity)
