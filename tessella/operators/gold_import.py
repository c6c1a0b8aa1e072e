"""Importing reviewed questions: field by field against what is stored, idempotent, with a history that only grows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, version, changes): what an import does to each item that it names.

    stored(key, version, status, fields), incoming(key, fields), fields of any types that JSON has. change is new,
    changed or unchanged; changes lists (field, old, new) as VARIANT in the order of fields, for a new item its fields
    that aren't null. Nulls are equal. Of incoming rows that repeat a key the first by their fields counts.
    """
    variant = lambda c: F.when(c.isNotNull(), F.to_variant_object(F.struct(c.alias("v"))))
    once = incoming.groupBy(key).agg(F.min(F.struct(*fields)).alias("new"))
    j = once.join(stored.select(key, "version", F.struct(*fields).alias("old")), key, "left")
    parts = [F.when(~F.col("new")[f].eqNullSafe(F.col("old")[f]), F.struct(F.lit(f).alias("field"), variant(F.col("old")[f]).alias("old"), variant(F.col("new")[f]).alias("new"))) for f in fields]
    changes = F.array_compact(F.array(*parts))
    change = F.when(F.col("version").isNull(), "new").when(F.size(changes) > 0, "changed").otherwise("unchanged")
    version = F.coalesce("version", F.lit(0)) + F.when(change == "unchanged", 0).otherwise(1)
    return j.select(key, change.alias("change"), version.cast("int").alias("version"), changes.alias("changes"), "new")


def import_items(stored: DataFrame, history: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, history, differences) after an import.

    A new item is a draft of version 1; a changed one gets the next version and is a draft again, whatever its status
    was; an unchanged one and one that isn't named stay as they are. history(key, version, at, field, old, new), texts in
    JSON, gets a row for each field that changed, so an import that is run again adds nothing.
    """
    told = differences(stored, incoming, key, fields)
    fresh = told.where("change <> 'unchanged'").select(key, "version", F.lit("draft").alias("status"), *(F.col("new")[f].alias(f) for f in fields))
    state = stored.join(fresh, key, "left_anti").unionByName(fresh.select(*stored.columns))
    text = lambda c: F.get_json_object(F.to_json(F.col(f"x.{c}")), "$.v")
    grown = told.where("change <> 'unchanged'").select(key, "version", F.lit(at).alias("at"), F.explode("changes").alias("x")).select(key, "version", "at", "x.field", text("old").alias("old"), text("new").alias("new"))
    return state, history.unionByName(grown), told.drop("new")
