"""Retention deletes expired days and leaves the files of the others as they are."""

from datetime import datetime
from pathlib import Path

from tessella.operators import retention as R

SCHEMA = "id long, at timestamp_ntz"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def made(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = [(i, datetime(2024, 1, 1 + i // 4, 6 * (i % 4))) for i in range(40)] + [(99, None)]
    R.write_days(spark.createDataFrame(rows, SCHEMA).repartition(3), "at", path)
    return path, rows


def test_only_expired_days_are_touched(spark, tmp_path):
    path, rows = made(spark, tmp_path)
    before = files(path)
    deleted, kept = R.delete_expired(spark, path, SCHEMA, "at", "2024-01-04 12:00:00")
    left = sorted(r.id for r in R.read_days(spark, path, SCHEMA).collect())
    assert left == [i for i, at in rows if at is None or at >= datetime(2024, 1, 4, 12)] and (deleted, kept) == (14, 2)
    after = files(path)
    same = {f for f in before if f[4:14] > "2024-01-04" or "none" in f}
    assert same and all(after[f] == before[f] for f in same)
    assert R.days_of(spark, path) == [f"2024-01-{d:02d}" for d in range(4, 11)] + ["none"]
    assert R.delete_expired(spark, path, SCHEMA, "at", "2024-01-04 12:00:00") == (0, 2) and files(path) == after


def test_rows_that_are_kept_longer_stay_in_their_days(spark, tmp_path):
    path, rows = made(spark, tmp_path)
    deleted, kept = R.delete_expired(spark, path, SCHEMA, "at", "2024-01-03 00:00:00", "id in (1, 2)")
    assert (deleted, kept) == (6, 6)
    assert {r.id for r in R.read_days(spark, path, SCHEMA).collect()} == {1, 2, *range(8, 40), 99}


def test_all_days_may_go(spark, tmp_path):
    path, _ = made(spark, tmp_path)
    assert R.delete_expired(spark, path, SCHEMA, "at", "2025-01-01 00:00:00") == (40, 0)
    assert [r.id for r in R.read_days(spark, path, SCHEMA).collect()] == [99]
