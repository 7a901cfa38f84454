import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "event_id" in df.columns and "silo_id" in df.columns


def test_catalog_consistency():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    core = {q for q in qs if not q.startswith("op") and q != "pipeline"}
    assert len(core) == 156 and all(callable(f) for f in qs.values())


def test_feature_rows_are_not_one_huge_generated_method(spark):
    import __spark_entry__
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    __spark_entry__.queries()["silo_stats"](spark, __spark_entry__.SMOKE_DIR)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
