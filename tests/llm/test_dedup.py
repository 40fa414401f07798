import hashlib
import re

import duckdb

from equigroup.llm import exact_dedup as ex
from equigroup.llm import queries

from .helpers import AWKWARD, CLASHES, awkward, clashing, empty


def digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()


def best(group):
    """The row that stays: most code points, then the smallest id."""
    return min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))


def check(df, source, words):
    got = ex.dedup_groups(df, filter_words=words).collect()
    groups = {}
    for r in source:
        groups.setdefault(digest(r[1]), []).append(r)
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in source)
    for d, group in groups.items():
        mine = [r for r in got if r["text_sha256"] == d]
        assert len(mine) == len(group) and sum(r["kept"] for r in mine) == 1
        assert all(r["group_size"] == len(group) and r["keep_id"] == best(group)[0] for r in mine)
        assert [r["doc_id"] for r in mine if r["kept"]] == [best(group)[0]]
    kept = ex.exact_dedup(df, filter_words=words).collect()
    assert sorted((r["doc_id"], r["text"]) if r["doc_id"] is not None else (-1, r["text"]) for r in kept) == sorted(
        (best(g)[0] if best(g)[0] is not None else -1, best(g)[1]) for g in groups.values())
    return kept


def test_awkward_rows_at_any_filter_size(spark):
    for words in (1, 3, ex.FILTER_WORDS):  # too small a filter sends more rows on and changes nothing
        check(awkward(spark), AWKWARD, words)


def test_columns_stay_as_they_were(spark):
    df = clashing(awkward(spark))
    kept = check(df, AWKWARD, ex.FILTER_WORDS)
    assert list(kept[0].asDict()) == df.columns and all(r[c] == f"own {c}" for r in kept for c in CLASHES)


def test_hot_group(spark):
    source = [(i, "same text" + " " * (i % 3)) for i in range(900)] + [(1000 + i, f"own {i}") for i in range(300)]
    check(spark.createDataFrame(source, "doc_id long, text string"), source, 64)


def test_unique_rows_pass_the_filter(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id % 1990) AS text")
    d = df.select("doc_id", ex.text_digest(df["text"]).alias("text_sha256"))
    flagged = ex.flag_repeated(d, ex.repeated_filter(d)).where("_repeated")
    assert flagged.where("doc_id < 10 OR doc_id >= 1990").count() == 20 and flagged.count() < 60


def test_empty(spark):
    assert ex.dedup_groups(empty(spark)).count() == 0 and ex.exact_dedup(empty(spark)).count() == 0


def test_query_matches_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    got = queries.op8_exact_dedup(spark, sf_small)
    res = con.execute(ex.ORACLE)
    assert got.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, got.collect())) == sorted(res.fetchall())


def test_native(spark):
    from pyspark.sql import functions as F
    plan = ex.exact_dedup(awkward(spark))._jdf.queryExecution().toString() + ex.dedup_groups(
        awkward(spark).withColumn("x", F.lit(1)))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_any_id_and_reproducible_ties(spark):
    """The least long as an id; rows equal in length and id but not in white space."""
    low = -2 ** 63
    rows = [(5, "a b"), (low, "a\tb"), (low, "x"), (2 ** 63 - 1, "y"), (None, "a\nb"), (7, "q r"), (7, "q\tr"), (7, "q\nr")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {(r["doc_id"], r["keep_id"]) for r in ex.dedup_groups(df).collect()}
        assert got == {(5, low), (low, low), (None, low), (2 ** 63 - 1, 2 ** 63 - 1), (7, 7)}
        kept = sorted((r["doc_id"], r["text"]) for r in ex.exact_dedup(df).collect())
        assert [k[0] for k in kept] == [low, low, 7, 2 ** 63 - 1]
        first = kept if parts == 1 else first
        assert kept == first
