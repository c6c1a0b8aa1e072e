"""Event-shaped tables: trailing windows, sessions, budgets, retention, and states from an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_count(events: DataFrame, key: str, at: str, minutes: int, name: str = "recent") -> DataFrame:
    """How many events of the key lie in the minutes up to each one, itself included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-minutes * 60_000_000, 0)
    return events.withColumn(name, F.count("*").over(w))


def sessions(events: DataFrame, key: str, at: str, gap_minutes: int) -> DataFrame:
    """Runs of a key's events with no larger gap: key, began, ended, n."""
    return (
        events.groupBy(key, F.session_window(F.col(at).cast("timestamp"), f"{gap_minutes} minutes").alias("w"))
        .agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count("*").alias("n"))
        .drop("w")
    )


def session_end(expires: Column, revoked: Column, last_seen: Column, idle_hours: int) -> Column:
    return F.least(expires, revoked, last_seen + F.expr(f"interval {idle_hours} hours"))


def budget_decision(spent: Column, calls: Column, input_tokens: Column, worst: Column, most_input: int, most_calls: int, budget: float) -> Column:
    """Why a priced call is refused; null if it may go ahead."""
    return F.when(input_tokens > most_input, "input_too_large").when(calls >= most_calls, "max_calls").when(spent + worst > budget, "budget")


def last_state(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The state after each key's last event. Events of one key meet as a maximum, never as a list."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("version"))


def illegal_steps(log: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Events that follow an event they may not follow."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    pair = F.concat_ws(">", F.col("_before"), F.col(state))
    return log.withColumn("_before", before).where(F.col("_before").isNotNull() & ~pair.isin(*(f"{a}>{b}" for a, b in allowed)))
