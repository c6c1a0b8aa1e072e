"""Retention that deletes: tables in day partitions lose the days that have expired, and nothing else is rewritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a folder of a row without a time.
DAY = "day"


def write_days(rows: DataFrame, age: str, path: str) -> None:
    """Adds rows to a table in day partitions of a time column; a row without a time is kept in a partition of its own."""
    day = F.coalesce(F.date_format(age, "yyyy-MM-dd"), F.lit("none"))
    rows.withColumn(DAY, day).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table without its partition column; empty if all days are gone."""
    return spark.read.schema(f"{schema}, {DAY} string").parquet(path).drop(DAY)


def days_of(spark: SparkSession, path: str) -> list[str]:
    """The days that a table has, from the names of its folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = (f.getPath().getName() for f in found if f.isDirectory())
    return sorted(n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}="))


def delete_expired(spark: SparkSession, path: str, schema: str, age: str, cutoff: str, keep: str | None = None) -> tuple[int, int]:
    """Deletes rows whose time lies before cutoff (yyyy-MM-dd HH:mm:ss, UTC) and that don't meet keep; returns (deleted, kept in the days touched).

    Days wholly before the cutoff go as folders; the day of the cutoff, and with keep each day that holds rows to be
    kept, is written anew in its place by a dynamic overwrite of its partition alone. Days behind the cutoff are neither
    read nor written. Rows without a time are never deleted. A run that died may be run again.
    """
    columns = f"{schema}, {DAY} string"
    until = cutoff[:10]
    old = [d for d in days_of(spark, path) if d <= until and d != "none"]
    if not old:
        return 0, 0
    held = spark.read.schema(columns).parquet(path).where(F.col(DAY).isin(old))
    stays = (F.col(age) >= F.lit(cutoff).cast("timestamp_ntz")) | F.coalesce(F.expr(keep), F.lit(False)) if keep else F.col(age) >= F.lit(cutoff).cast("timestamp_ntz")
    counted = held.groupBy(DAY).agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("gone")).collect()  # a row for each old day
    part = [r[DAY] for r in counted if r["kept"] and r["gone"]]
    if part:
        # Spark reads and replaces the same partitions: what stays is written beside them first.
        draft = f"{path.rstrip('/')}.keeping"
        held.where(F.col(DAY).isin(part)).where(stays).write.mode("overwrite").parquet(draft)
        again = spark.read.schema(columns).parquet(draft)
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
        remove(spark, [draft])
    remove(spark, [f"{path.rstrip('/')}/{DAY}={r[DAY]}" for r in counted if not r["kept"]])
    return sum(r["gone"] for r in counted), sum(r["kept"] for r in counted)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
