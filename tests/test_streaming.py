from catchwork.streaming import process_new_files


def test_new_files_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([(1,), (2,)], [(3,)], []):
        if rows:
            spark.createDataFrame(rows, "k long").coalesce(1).write.mode("append").parquet(source)
        process_new_files(spark, source, "k long", lambda df: df.selectExpr("k * 10 k"), sink, state)
    assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == [10, 20, 30]
