from crosstide.streaming.bars import bars


def test_bars_of_stream_and_table_agree(spark, tmp_path):
    rows = [(f"2024-01-0{d} {h:02}:00:00", t, 10.0 * d + h, 2.0) for d in (1, 2, 3, 6) for h in (9, 12, 15) for t in ("a", "b")]
    table = spark.createDataFrame(rows, "ts string, ticker string, price double, size double").selectExpr("cast(ts as timestamp) ts", "ticker", "price", "size")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    query.processAllAvailable()
    query.stop()
    a, b = (sorted(map(tuple, x.collect())) for x in (spark.table("bars"), bars(table)))
    assert a == b and len(a) == 8 and a[0][2:] == (19.0, 25.0, 19.0, 25.0, 6.0)
