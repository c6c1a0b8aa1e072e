"""Admission of priced calls in the order they come: what was admitted before decides, what was refused doesn't count."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Of one call, and of a scope: a run, or an endpoint and provider on one UTC day. Money is in millionths."""

    input_tokens: int
    calls: int
    budget: int


def decide(limits: Limits, calls: int, spent: int, tokens: int | None, worst: int | None) -> str | None:
    """Why a call is refused; null if it is admitted. A call without a price is always admitted."""
    if worst is None:
        return None
    if (tokens or 0) > limits.input_tokens:
        return "input_too_large"
    if calls >= limits.calls:
        return "max_calls"
    return "budget" if spent + worst > limits.budget else None


RESULT = "scope string, call_id long, refused string, calls long, spent long"
SCHEMA = pa.schema([("scope", pa.string()), ("call_id", pa.int64()), ("refused", pa.string()), ("calls", pa.int64()), ("spent", pa.int64())])


def admitted_in_order(limits: Limits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, calls, spent = None, 0, 0
        for whole in batches:
            for batch in (whole.slice(i, 10_000) for i in range(0, whole.num_rows, 10_000)):
                out: list[tuple] = []
                for scope, call, tokens, worst, cost in zip(*(batch.column(c).to_pylist() for c in ("scope", "call_id", "tokens", "worst", "cost"))):
                    if scope != own:
                        own, calls, spent = scope, 0, 0
                    refused = decide(limits, calls, spent, tokens, worst)
                    if refused is None and worst is not None:
                        calls, spent = calls + 1, spent + (cost or 0)
                    out.append((scope, call, refused, calls, spent))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), SCHEMA.types)], schema=SCHEMA)

    return run


def admissions(calls: DataFrame, limits: Limits) -> DataFrame:
    """calls(scope, at, call_id, tokens, worst, cost) with refused (a reason or null) and, after each call, the scope's admitted calls and what they spent.

    Calls are taken by at, then call_id. worst is what a call may cost at most, null without a price; cost is what it did
    cost, and counts only if it was admitted; a null cost is 0. Calls of one scope are read one after the other, as each
    decision needs the one before: a task streams them with two numbers as its state, so a scope may have any number of
    calls, and a hot one takes time but no memory. Scopes should carry the day, which ends them.
    """
    asked = calls.select(F.col("scope").cast("string").alias("scope"), "at", F.col("call_id").cast("long").alias("call_id"), F.col("tokens").cast("long").alias("tokens"), F.col("worst").cast("long").alias("worst"), F.col("cost").cast("long").alias("cost")).where("scope is not null")
    dealt = asked.repartition("scope").sortWithinPartitions("scope", "at", "call_id")
    return dealt.mapInArrow(admitted_in_order(limits), RESULT)


def spent_by_scope(decided: DataFrame) -> DataFrame:
    """Per scope: how many calls came, were admitted and were refused for each reason, and what was spent."""
    reasons = [F.count_if(F.col("refused") == r).alias(r) for r in ("input_too_large", "max_calls", "budget")]
    return decided.groupBy("scope").agg(F.count("*").alias("asked"), F.max("calls").alias("admitted"), *reasons, F.max("spent").alias("spent"))
