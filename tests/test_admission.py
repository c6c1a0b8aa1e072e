"""Admission against a plain loop, as a table and as a stream in several batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.operators import admission
from tessella.streaming import admission as live
from tessella.streaming import events as stream

LIMITS = admission.Limits(input_tokens=100, calls=5, budget=1000)


def calls(days=3):
    rng = random.Random(2)
    rows, at = [], datetime(2024, 1, 1)
    for i in range(400):
        at += timedelta(minutes=rng.choice([0, 5, 20]))
        scope = rng.choice(["hot", "hot", "cold", None])
        worst = rng.choice([None, 50, 300, 900])
        rows.append((f"{scope}/{at:%Y-%m-%d}" if scope else None, at, i, rng.choice([None, 10, 99, 101]), worst, None if worst is None else rng.choice([worst // 2, worst, None])))
    return rows


def plain(rows):
    held, out = {}, {}
    for scope, at, call, tokens, worst, cost in sorted(rows, key=lambda r: (r[1], r[2])):
        if scope is None:
            continue
        n, spent = held.get(scope, (0, 0))
        why = None
        if worst is not None:
            why = "input_too_large" if (tokens or 0) > 100 else "max_calls" if n >= 5 else "budget" if spent + worst > 1000 else None
            if why is None:
                n, spent = n + 1, spent + (cost or 0)
        held[scope] = n, spent
        out[call] = (scope, why, n, spent)
    return out


KIND = "scope string, ts timestamp, call_id long, tokens long, worst long, cost long"


def test_a_refused_call_does_not_count(spark):
    rows = calls()
    made = admission.admissions(spark.createDataFrame(rows, KIND).repartition(5).withColumnRenamed("ts", "at"), LIMITS)
    got = {r.call_id: (r.scope, r.refused, r.calls, r.spent) for r in made.collect()}
    assert got == plain(rows) and {x[1] for x in got.values()} == {None, "input_too_large", "max_calls", "budget"}
    sums = {r.scope: r for r in admission.spent_by_scope(made).collect()}
    assert all(s.admitted <= 5 and s.spent <= 1000 for s in sums.values())
    assert admission.admissions(spark.createDataFrame([], KIND).withColumnRenamed("ts", "at"), LIMITS).count() == 0


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in live.STORE}
    for k, v in live.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stream_agrees_over_several_batches(spark, tmp_path, store):
    rows = calls()
    for k in range(4):  # files are read in the order of their times
        part = rows[k * 100 : k * 100 + 100]
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    made = stream.run_to_table(live.admissions(source, LIMITS), "admission-test", "append")
    got = {r.call_id: (r.scope, r.refused, r.calls, r.spent) for r in made.collect()}
    assert got == plain(rows)
    assert spark.read.parquet(str(tmp_path / "calls")).count() == 400
    assert made.where(F.col("refused").isNotNull()).count() > 20
