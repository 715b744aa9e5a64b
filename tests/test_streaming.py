from pyspark.sql import functions as F

from barloom.queries import daily, lines
from barloom.sources.bars import ticks_of_lineitem
from barloom.streaming.bars import daily_bars_stream

SF = "/root/testdata/sf0.001"


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    ticks = ticks_of_lineitem(lines(spark, SF)).withColumn("ts", F.col("dt").cast("timestamp")).drop("dt")
    last = ticks.agg(F.max("ts")).first()[0]
    closing = ticks.limit(1).withColumn("ts", F.lit(last) + F.expr("interval 10 days"))  # lets the last day's watermark pass
    ticks.write.parquet(f"{tmp_path}/in/a")
    closing.write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(ticks.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).parquet(f"{tmp_path}/in")
    query = daily_bars_stream(stream).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("streamed").where(F.col("dt") <= F.lit(last).cast("date"))
    want = daily(spark, SF)
    assert got.count() == want.count() > 1000
    assert got.select(want.columns).exceptAll(want).count() == 0
