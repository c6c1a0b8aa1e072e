"""Admission of priced calls as a stream: the state of a scope is two numbers, and a timer ends it with its day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import RESULT, Limits, decide

#: transformWithState keeps its state in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400_000


class Admission(StatefulProcessor):
    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("admitted", "calls long, spent long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.held.exists()
        calls, spent = (0, 0) if new else self.held.get()
        came = pd.concat(list(rows)).sort_values(["at", "call_id"])
        out = []
        for call, tokens, worst, cost in zip(*(came[c].astype(object).where(came[c].notna(), None).tolist() for c in ("call_id", "tokens", "worst", "cost"))):
            refused = decide(self.limits, calls, spent, tokens, worst)
            if refused is None and worst is not None:
                calls, spent = calls + 1, spent + int(cost or 0)
            out.append((key[0], call, refused, calls, spent))
        self.held.update((calls, spent))
        if new:
            last = int(came["at"].max()) // 1000
            self.handle.registerTimer(max(last - last % DAY + DAY, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["scope", "call_id", "refused", "calls", "spent"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def admissions(calls: DataFrame, limits: Limits, late: str = "1 hour") -> DataFrame:
    """calls(scope, ts, call_id, tokens, worst, cost), a stream, with what operators.admission.admissions adds.

    A batch's calls of one scope are taken by time, then id, behind those of earlier batches; it gives what the table
    gives if no call comes in a later batch than a younger one of its scope. Scopes carry a UTC day: once the watermark,
    so much behind the latest call, has passed its end, the scope's state goes. Calls later than the watermark are
    dropped by Spark. The session needs STORE. A batch's calls of a scope meet in one task.
    """
    held = calls.where("scope is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    held = held.select(F.col("scope").cast("string").alias("scope"), "ts", F.unix_micros("ts").alias("at"), F.col("call_id").cast("long").alias("call_id"), F.col("tokens").cast("long").alias("tokens"), F.col("worst").cast("long").alias("worst"), F.col("cost").cast("long").alias("cost"))
    return held.groupBy("scope").transformWithStateInPandas(statefulProcessor=Admission(limits), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
