"""Snapshots instead of updates in place: each operator gives the table's next state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_of_each


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column], version: str | None = None) -> DataFrame:
    """The stored rows with the incoming ones over them; of several incoming rows of a key the first in order counts.

    With a version column, a row whose stored version is the same stays as it is.
    """
    fresh = first_of_each(incoming, keys, order)
    if version is not None:
        held = stored.select(*keys, F.col(version).alias("_held"))
        fresh = fresh.join(held, list(keys), "left").where(~F.col(version).eqNullSafe(F.col("_held"))).drop("_held")
    return stored.join(fresh, list(keys), "left_anti").unionByName(fresh.select(*stored.columns))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(incoming.join(stored, list(keys), "left_anti").select(*stored.columns))


def replace_children(stored: DataFrame, parents: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Children of parents that are gone go; those of parents with fresh children are replaced as a whole."""
    kept = stored.join(parents.select(key), key, "left_semi").join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def change_counts(before: DataFrame, after: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row: inserted, updated, unchanged and deleted."""
    b, a = before.select(*keys, F.col(version).alias("_b"), F.lit(1).alias("_in_b")), after.select(*keys, F.col(version).alias("_a"), F.lit(1).alias("_in_a"))
    both = b.join(a, list(keys), "full")
    old, new = F.col("_in_b").isNotNull(), F.col("_in_a").isNotNull()
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return both.agg(F.count_if(new & ~old).alias("inserted"), F.count_if(new & old & ~same).alias("updated"), F.count_if(new & old & same).alias("unchanged"), F.count_if(old & ~new).alias("deleted"))
