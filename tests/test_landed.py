"""Parts that the streams of the registered queries read: of several files each, one a micro-batch."""

from pyspark.sql import functions as F
from tidemark.plans import activity
from tidemark.sources.paths import work_dir


def test_a_landed_part_has_many_files_and_is_one_batch(spark, monkeypatch):
    monkeypatch.setattr(activity, "FILE_ROWS", 100)
    stream, path = activity._landed(spark.range(4000).repartition(3), "parts")
    names, out = spark.read.parquet(path).select(F.input_file_name()).distinct().count(), work_dir(spark, "landed")
    query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(out).groupBy("batch").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(i, 1000 * i, 1000 * i + 999, 1000) for i in range(4)] and names == 40


def test_parts_of_which_one_is_empty_are_landed_whole(spark, monkeypatch):
    monkeypatch.setattr(activity, "FILE_ROWS", 100)
    df = spark.range(4000).where("id < 1000 or id >= 2000")
    stream, path = activity._landed(df, "parts")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i in range(4000) if not 1000 <= i < 2000]
