import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_all_plain_queries_run(spark, sf_dir):
    from trajspark import plans

    for name, f in plans.QUERIES.items():
        df = f(spark, sf_dir)
        assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns), name
