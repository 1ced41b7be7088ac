from tiegraph.streaming.windows import windowed_ties


def test_stream_equals_batch(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("sender"), F.col("event_type").alias("receiver"), "ts", "value")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = windowed_ties(stream, "1 day", late="60 days").writeStream.format("memory").queryName("ties").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    got = {(r["t_start"], r["ego"], r["alter"]): r["events"] for r in spark.table("ties").collect()}
    want = {(r["t_start"], r["ego"], r["alter"]): r["events"] for r in windowed_ties(e, "1 day").collect()}
    assert got == want
