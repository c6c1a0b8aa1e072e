"""Places of rows in a sorted order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, materialize, renamed


def numbered(frame: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with `at` (long), the place of each among the rows of its group from 0, and `size` (long), their number; nulls come first.

    Rows are sorted by ranges of (groups, order), so a group that holds most rows is many ranges. What is summed then is
    one count for each range and group. The frame is read twice (once for the bounds of the ranges): give a written one.
    Equal rows may change places; rows that differ in a column that isn't in order must not tie in it.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    row, part, first, before = (f"{OWN}{x}" for x in ("row", "part", "first", "before"))
    held = materialize(frame.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id()), name)
    told = held.withColumn(part, F.shiftright(row, 33))
    counts = told.groupBy(part, *groups).agg(F.count("*").alias("n"), F.min(row).alias(first))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, first, *(F.col(g).alias(f"{OWN}{g}") for g in groups), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before), F.sum("n").over(Window.partitionBy(*groups)).alias("size"))
    same = [told[g].eqNullSafe(counts[f"{OWN}{g}"]) for g in groups]
    placed = told.join(counts, [told[part] == counts[part], *same])
    return renamed(held, placed.select(*(told[c] for c in frame.columns), (F.col(row) - F.col(first) + F.col(before)).alias("at"), "size"))
