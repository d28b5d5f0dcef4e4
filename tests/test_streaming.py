from questmill.streaming.ledger import push_stream


def test_only_changed_rows_are_pushed(spark, tmp_path):
    pushed = []
    write = lambda df, n: pushed.append(sorted((r.id, r.text) for r in df.collect()))

    def batch(rows):
        spark.createDataFrame(rows, "id long, rev int, text string").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long, rev int, text string").parquet(str(tmp_path / "in"))
        push_stream(source, "id", "rev", ["id", "text"], str(tmp_path / "ledger"), str(tmp_path / "check"), write).awaitTermination()

    batch([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    batch([(1, 3, "b"), (2, 2, "d"), (3, 1, None)])
    batch([(3, 2, None)])
    assert pushed == [[(1, "b"), (2, "c")], [(2, "d"), (3, None)], []]
