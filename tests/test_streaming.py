from pyspark.sql import functions as F

from tablesmith.streaming.checks import flag, windowed_counts

def test_flags(spark):
    rules = {"positive": F.col("value") > 0, "known": F.col("event_type").isin("click", "view")}
    rows = spark.createDataFrame([(1.0, "click"), (-1.0, "x"), (None, "view")], "value double, event_type string")
    assert [r.violations for r in flag(rows, rules).orderBy("event_type").collect()] == [[], [], ["known", "positive"]]


def test_a_stream_counts_as_a_table_does(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rules = {"small": F.col("value") < 50, "known": F.col("event_type").isin("click", "view")}
    want = {(r.start, r["rule"]): r.n for r in windowed_counts(events, rules, "ts").collect()}
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), rules, "ts")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert {(r.start, r["rule"]): r.n for r in spark.table("counted").collect()} == want and want
