from pyspark.sql import functions as F

from pixelweft.sources.rasters import raster
from pixelweft.streaming import images as S

SF = "/root/testdata/sf0.001"


def drain(spark, df, mode, name, where):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def test_running_histogram_equals_the_batch(spark, tmp_path):
    pixels = raster(spark, SF, "rgb")
    pixels.repartition(5).write.parquet(str(tmp_path / "in"))
    got = drain(spark, S.running_histogram(S.read_pixels(spark, str(tmp_path / "in"), 2)), "complete", "hist", tmp_path / "c")
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.running_histogram(pixels).collect()))


def test_rows_come_in_order(spark, tmp_path):
    for k, rows in enumerate(([2, 0], [3, 5], [1, 4])):
        spark.createDataFrame([(7, r, float(r)) for r in rows], "image_id int, row int, data double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    strips = spark.readStream.schema("image_id int, row int, data double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = drain(spark, S.in_order(strips), "append", "strips", tmp_path / "c")
    assert [r.row for r in got] == list(range(6))


def test_windows_count_every_event(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drain(spark, S.windowed(stream), "complete", "windows", tmp_path / "c")
    assert sum(r.n for r in got) == events.count()
