import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["fi", "fj", "dissimilarity"]
    assert df.count() == 10


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_a_few_queries_match_oracle(spark, sf_small):
    import duckdb
    from equigroup.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    for name in ["i3_dissimilarity", "f11_fairness_record", "r2_performance_report", "m6_stratified_kfold"]:
        got = sorted(tuple(str(v) for v in r) for r in E.queries()[name](spark, sf_small).collect())
        res = con.execute(E.oracle_sql()[name])
        cols = [d[0] for d in res.description]
        want = sorted(tuple(str(v) for v in r) for r in res.fetchall())
        assert len(got) == len(want), name
        assert sorted(cols) == sorted(E.queries()[name](spark, sf_small).columns), name
