from cairn.operators.profiles import item_shares
from cairn.streaming.profiles import genre_mass


def test_stream_equals_batch(spark, tmp_path):
    """Two micro-batches sum to what one batch gives; repeated rows count repeatedly."""
    schema = "user int, item int, ts timestamp"
    shares = item_shares(spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "item int, genre string"))
    for rows in ([(7, 1, "2024-01-01 00:00:00"), (7, 2, "2024-01-01 00:00:01")], [(7, 1, "2024-01-01 00:00:00"), (8, 2, "2024-01-01 00:00:02")]):
        df = spark.createDataFrame(rows, "user int, item int, t string").selectExpr("user", "item", "cast(t as timestamp) as ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = genre_mass(source, shares).writeStream.outputMode("complete").format("memory").queryName("mass").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("mass").collect())) == [(7, "a", 1.0), (7, "b", 2.0), (8, "b", 1.0)]
