"""SimHash near-duplicates by deletion-variant signatures.

Each whole text gets a 64-bit fingerprint: the majority of the bits of its
shingles' hashes. To link fingerprints at two or fewer differing bits, each is
cut into two segments, so that one segment of a linked pair differs by at most
one bit: it is indexed under every segment with one bit left out (64 variants),
variants are matched by equality and the candidates' distance is verified.

Work is on distinct fingerprints, so copies cost nothing. A variant that just
two fingerprints share is a pair to verify. Where more share one (near copies
of one text), no pairs are formed: every fingerprint found in such a crowd is
put under itself and its 64 neighbours at one bit. Two fingerprints differ in at
most two bits exactly if they meet under such a value, and at most 65 can meet
there, so linking each to the least one is complete, needs no verification and
has no hot key. Components are joined by alternating star contraction; edges
are written to the checkpoint folder between rounds.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; texts with fewer words than a shingle use all their words; repeated
rows and ids share a component; a null id is never the smallest (a component of
null ids alone has a null id); ``near_dedup`` keeps one row of each component,
whatever its ids; extra columns are not read, or carried whole by it; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equigroup.llm.common import col, id_text, materialize, pack_rows, unpack_rows
from equigroup.session import num_partitions

SEED = 42
#: Shingles hashed at a time.
CHUNK = 1 << 18
#: Crowded variants (8 bytes each) that are broadcast at most.
CROWDED = 1 << 20


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text; A-Z are lower-cased and words
    are parted by ASCII white space."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = w[at:min(at + CHUNK, n) + words - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(words)])) if n > 1 or len(w) >= words else [b" ".join(w)]
        h = np.array([digest(s, seed) for s in shingles], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = SEED, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; one scan, no shuffle."""
    return with_fingerprint(id_text(docs, id_col, text_col), words, seed)


def with_fingerprint(src: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """The columns of ``src`` with fp in place of its last one, text."""
    names = src.columns[:-1]

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return src.mapInArrow(run, src.drop("text").schema.add("fp", "long"))


def variants(prints: DataFrame) -> DataFrame:
    """(fp, variant): both 32-bit halves with each one bit left out; the
    half's and the bit's number are part of the variant."""
    return prints.selectExpr(
        "fp", "explode(flatten(array("
        "transform(sequence(0, 31), b -> (shiftrightunsigned(fp, 32) & ~shiftleft(1L, b)) | shiftleft(CAST(b AS bigint), 32)),"
        "transform(sequence(0, 31), b -> (fp & 4294967295L & ~shiftleft(1L, b)) | shiftleft(CAST(b + 32 AS bigint), 32))"
        "))) AS variant")


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b), a < b, that connect all distinct fingerprints of
    ``prints`` (fp) at ``bits`` or fewer differing bits."""
    if bits not in (1, 2):
        raise ValueError("two segments and one left-out bit find pairs at 1 or 2 bits")
    # 64 rows come of each, so the few small partitions of the input are spread first
    v = variants(prints.repartition(num_partitions(prints.sparkSession), "fp"))
    shared = materialize(v.groupBy("variant").agg(
        F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    pairs = shared.where("n = 2").select("a", "b").distinct()
    verified = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    crowded = shared.where("n > 2").select("variant")
    if crowded.count() <= CROWDED:
        crowded = F.broadcast(crowded)  # else the variants are shuffled once more, some 0.4 times the input
    crowd = v.join(crowded, "variant", "left_semi").select("fp").distinct()
    near = "transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b))"
    if bits == 2:
        meet = crowd.selectExpr("fp", f"explode(array_append({near}, fp)) AS at")
        balls = meet.groupBy("at").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where("size(all) > 1")
        dense = balls.select("a", F.explode("all").alias("b")).where("a < b")
    else:
        dense = (crowd.selectExpr("fp AS a", f"explode({near}) AS b").where("a < b")
                 .join(crowd.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    return verified.unionByName(dense).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches.

    Alternates large-star (each node's larger neighbours go to its least one)
    and small-star (its smaller neighbours go to it) until nothing changes; the
    number of rounds grows with the logarithm of a component's size. A hub's
    neighbours are never gathered: the least one comes from a partial minimum,
    is written out and joined back, so that Spark may split the hub's rows."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        down = large.join(least, "u")
        new = materialize(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        # stars: no node is both a root and a member, and each member has one root
        open_ = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        many = new.groupBy("u").count().where("count > 1").limit(1).count()
        edges = new
        if not open_ and not many:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id
    (the smallest id reachable through links)."""
    rows = materialize(fingerprints(docs, words, id_col=id_col, text_col=text_col))
    # written out: straight from an aggregate, their spreading in ``links`` would be dropped as done already
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    linked = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()).join(nodes, "fp")
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    # written out, as above: a third of all rows may share a fingerprint or a component
    of = materialize(nodes.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left")
                     .select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of each component stays, with its columns as they were: the one
    with the smallest id (a null id loses), of rows that share it the first.
    Rows are told apart by a number that the checkpoint fixes, not by their id,
    so rows that share an id or have none are documents of their own."""
    base = materialize(docs.select(pack_rows(docs), F.monotonically_increasing_id().alias("_row")))
    field = F.col("row").getField
    rows = materialize(with_fingerprint(base.select(
        "_row", field(id_col).cast("long").alias("id"), F.coalesce(field(text_col).cast("string"), F.lit("")).alias("text")), words))
    # smallest id first, a null id last, then the row number
    nodes = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("first")))
    roots = components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    stay = (nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row")))
    return unpack_rows(base.join(stay, "_row", "left_semi").select("row"), docs.columns)
