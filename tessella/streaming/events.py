"""Streams over events: daily sums, sessions, lock-outs, and sinks that a repeated batch doesn't double."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_path


def read_events(spark: SparkSession, sf_dir: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """The events table as a stream; its times get a zone, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parq*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(events: DataFrame, late: str = "3650 days") -> DataFrame:
    """Calls and value per kind and day. The sum is a decimal, so that it doesn't depend on the order of arrival.

    In append and update mode a day leaves the state once the watermark, so much behind, has passed it; a result in
    complete mode is all days, and keeps them.
    """
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(10,6)")).alias("spent"))


def session_counts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions per user that close once the watermark has passed their gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def lockouts(events: DataFrame, most: int, minutes: int, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, locked) for each failure; the state holds a user's failures of the last minutes only.

    A user's state goes once the watermark, so much behind the latest event, has passed the last failure by the minutes.

    Failures of a user are taken in time order within a batch; one that comes later than a younger one of an earlier
    batch counts those that the state still holds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"].tolist(), rows["event_id"].tolist()):
            recent = [x for x in recent if x >= at - minutes * 60_000_000] + [at]
            out.append((key[0], event, len(recent) >= most))
        state.update((recent,))
        state.setTimeoutTimestamp(max(max(recent) // 1000 + minutes * 60_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "locked"])

    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    failed = stamped.where("event_type = 'error'").select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
    return failed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, locked boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs over all that is there and gives the result as a table in the shared folder.

    Each batch writes a folder of its own number, so a batch that is run again after a failure replaces itself. In
    complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    out, marks = shared_path(spark, name), shared_path(spark, f"{name}-offsets")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", marks).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for append-only tables: batch n owns the folder of that number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


