"""Hard negatives for contrastive training by slot-decomposed selection.

An anchor's positives are its best rows of the same label; each positive opens
a window of scores, from ``low`` to ``high`` percent of its own score, in which
the best rows of other labels are wanted. The windows of one anchor overlap, so
they are not searched one by one: the upper limits of its positives cut the
scores into disjoint slots, every row falls into one slot, tasks (and the merge
of their results) keep the best ``negatives`` rows of a slot, and a window is
answered by going through the slots at and below its upper limit in descending
order until it has enough. The best rows below an upper limit contain the
window's best, so nothing is lost.

Anchors are taken in blocks of at most ``block`` rows, the only data that is
broadcast (block x dimensions numbers). Each block is two scans of the rows:
one for the positives, one for the slots. A task multiplies whole slices of
rows with the block and holds at most ``CELLS`` scores at a time; what it
returns is bounded by anchors x slots x negatives. A hot label or a group of
copies is spread as its rows are: nothing is grouped by label or vector.

Defined cases: rows with a null id, label or vector, with a null or non-finite
component, or with components so large that a score times 100 could leave a
long (sum of squares of 2^56) take no part; vectors of another length than the
anchor's are not compared with it; of several rows with an anchor's id the
least (label, vector) is the anchor, and rows with the anchor's id are neither
its positives nor its negatives; other repeated rows are rows of their own and
may fill several ranks; equal scores go by smaller id; an anchor without
positives, or a window without rows (always so below a negative positive score
where ``low`` < ``high``), gives no row; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equigroup.llm.common import col, materialize
from equigroup.session import checkpoint_dir

SCALE = 256
#: Anchors of one block, and scores a task holds at a time.
BLOCK, CELLS = 2_048, 2_000_000
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
          "negative_score long")


def usable_rows(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, x) of the rows that take part; x still as doubles."""
    v = col(vector_col).cast("array<double>")
    limit = F.lit(float(1 << 28)) / F.sqrt(F.size(v)) - 1
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c) * scale < limit, F.lit(False)))
    return (df.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), v.alias("x"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
            .where(fine & (F.size("x") > 0)))


def slices(batch: pa.RecordBatch, rows: int, scale: int) -> Iterator[tuple]:
    """(ids, labels, integer vectors) of at most ``rows`` rows of one vector length."""
    ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
    lists = batch.column("x")
    offsets = lists.offsets.to_numpy()
    flat, sizes = np.floor(scale * lists.values.to_numpy()), np.diff(offsets)
    for d in np.unique(sizes):
        of = np.flatnonzero(sizes == d)
        for at in range(0, len(of), rows):
            part = of[at:at + rows]
            yield ids[part], labels[part], flat[offsets[part][:, None] + np.arange(d)]


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of integer vectors kept as doubles."""
    top = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1]
    if top < 2 ** 53:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The best ``k`` (score, id) of each key seen so far, ties by smaller id."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, np.iinfo(np.int64).min)
        self.key = self.score = self.id = np.empty(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        able = score >= self.floor[key]
        if not able.any():
            return
        key, score, ids = (np.concatenate([old, new[able]]) for old, new in
                           ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key = key[order]
        at = np.arange(len(key))
        rank = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
        order = order[rank < self.k]
        self.key, self.score, self.id = key[rank < self.k], score[order], ids[order]
        full = rank == self.k - 1
        self.floor[key[full]] = self.score[rank[rank < self.k] == self.k - 1]


class Block:
    """Anchors of one block: ids, labels and vectors, by vector length."""

    def __init__(self, rows: list, scale: int):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        sizes = np.array([len(r["x"]) for r in rows])
        self.of = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        self.x = {d: np.floor(scale * np.array([rows[i]["x"] for i in of])) for d, of in self.of.items()}


def _partial_best(batches, block: Block, k: int, keys: int, choose, scale: int):
    """Best rows of each key over a whole partition; ``choose`` turns scores
    into the (anchor, row, key) that may count."""
    best = Best(keys, k)
    step = max(1, CELLS // max(1, len(block.ids)))
    for batch in batches:
        for ids, labels, x in slices(batch, step, scale):
            of = block.of.get(x.shape[1])
            if of is None:
                continue
            s = scores(block.x[x.shape[1]], x)
            same = block.labels[of][:, None] == labels[None, :]
            other = block.ids[of][:, None] != ids[None, :]
            a, r, key = choose(of, s, same, other)
            best.add(key, s[a, r], ids[r])
    yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.score), pa.array(best.id)], ["key", "score", "id"])


def _top(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each key over all tasks' best."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def find_positives(rows: DataFrame, block: Block, positives: int, scale: int = SCALE) -> DataFrame:
    """(key, score, id, rank): the best rows of the same label for each anchor
    of the block; key is the anchor's number in the block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def part(batches):
        def choose(of, s, same, other):
            a, r = np.nonzero(same & other)
            return a, r, of[a]

        return _partial_best(batches, shared.value, positives, len(shared.value.ids), choose, scale)

    return _top(rows.mapInArrow(part, "key long, score long, id long"), positives)


def slot_limits(scores_by_anchor: list[list[int]], low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor its slots' upper limits, ascending, padded with the last
    to ``width``, and the least score that any of its windows can hold (the
    greatest long where it has none)."""
    never = np.iinfo(np.int64).max
    upper, least = np.full((len(scores_by_anchor), width), np.iinfo(np.int64).min), np.full(len(scores_by_anchor), never)
    for i, ps in enumerate(scores_by_anchor):
        ends = sorted({high * p // 100 for p in ps})
        if ends:
            upper[i] = ends + ends[-1:] * (width - len(ends))
            least[i] = min(-(-low * p // 100) for p in ps)
    return upper, least


def find_slots(rows: DataFrame, block: Block, upper: np.ndarray, least: np.ndarray, negatives: int,
               scale: int = SCALE) -> DataFrame:
    """(key, score, id, rank): the best rows of other labels in each slot of
    each anchor; key is anchor number x slots + slot."""
    width = upper.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((block, upper, least))

    def part(batches):
        block, upper, least = shared.value

        def choose(of, s, same, other):
            near = (s >= least[of][:, None]) & (s <= upper[of][:, -1:]) & ~same & other
            a, r = np.nonzero(near)
            slot = (s[a, r][:, None] > upper[of[a]]).sum(axis=1)
            return a, r, of[a] * width + slot

        return _partial_best(batches, block, negatives, len(block.ids) * width, choose, scale)

    return _top(rows.mapInArrow(part, "key long, score long, id long"), negatives)


def _mine_block(rows: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int,
                scale: int) -> DataFrame:
    spark = rows.sparkSession
    found: list[list] = [[] for _ in block.ids]
    for r in find_positives(rows, block, positives, scale).orderBy("key", "rank").collect():  # block x positives rows
        found[r["key"]].append((r["score"], r["id"]))
    upper, least = slot_limits([[s for s, _ in f] for f in found], low, high, positives)
    windows = [(i, int(block.ids[i]), p, s, high * s // 100, -(-low * s // 100)) for i, f in enumerate(found) for s, p in f]
    wanted = spark.createDataFrame(windows, "anchor long, anchor_id long, positive_id long, positive_score long, "
                                            "top long, bottom long")
    merged = (find_slots(rows, block, upper, least, negatives, scale)
              .select(F.floor(F.col("key") / positives).alias("anchor"), "score", "id")
              .groupBy("anchor")  # slots x negatives rows each; one sorted list is all slots in descending order
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("slots")))
    answer = F.filter(F.slice(F.filter("slots", lambda c: -c["down"] <= F.col("top")), 1, negatives),
                      lambda c: -c["down"] >= F.col("bottom"))
    return (merged.join(F.broadcast(wanted), "anchor")
            .select("anchor_id", "positive_id", "positive_score", F.posexplode(answer).alias("pos", "c"))
            .select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("c.id").alias("negative_id"), "positive_score", (-F.col("c.down")).alias("negative_score")))


def mine_hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80,
                        high: int = 100, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The ``RESULT`` columns: for each anchor (rows where ``anchors`` holds, a
    condition on ``id``) and each of its ``positives`` best rows of the same
    label, the best ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` percent of the positive's. Scores are inner products of
    floor(scale * component). The blocks' results are written to the checkpoint
    folder one after the other and read back."""
    spark = df.sparkSession
    rows = usable_rows(df, id_col, label_col, vector_col, scale)
    chosen = materialize(rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "x")).alias("least"))
                         .select("id", "least.label", "least.x"))
    buckets = -(-chosen.count() // block)
    path = f"{checkpoint_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    for b in range(buckets):
        # about ``block`` rows at a time come to the driver; a block itself never has more
        part = chosen.where(F.pmod(F.xxhash64("id"), F.lit(buckets)) == b).orderBy("id").collect()
        for at in range(0, len(part), block):
            found = _mine_block(rows, Block(part[at:at + block], scale), positives, negatives, low, high, scale)
            found.write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path) if buckets else spark.createDataFrame([], RESULT)


#: DuckDB SQL of the registered query.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
