"""Streams give what batches give, however the input is cut into files."""

from pyspark.sql import functions as F

from tessella.streaming import events as stream

FOLDER = "/root/testdata/sf0.001"


def split_events(spark, tmp_path):
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    e.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    return e, str(tmp_path)


def test_daily_totals(spark, tmp_path):
    e, folder = split_events(spark, tmp_path)
    live = stream.run_to_table(stream.daily_totals(stream.read_events(spark, folder, e.schema, 2)), "daily", "complete")
    batch = stream.daily_totals(e.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    e, folder = split_events(spark, tmp_path)
    live = stream.run_to_table(stream.session_counts(stream.read_events(spark, folder, e.schema), "12 hours", "30 days"), "sessions", "append")
    whole = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).count()
    assert live.count() <= whole.count()
    assert live.select("user_id", "w", "n").exceptAll(whole).isEmpty()


def test_sink_replaces_a_batch_that_runs_again(spark, tmp_path):
    write = stream.once_per_batch(str(tmp_path / "sink"))
    for _ in range(2):
        write(spark.range(3), 7)
    write(spark.range(2), 8)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 5
