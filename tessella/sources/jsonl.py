"""Lines of JSON with a closed schema: good records, and bad lines with their number and every problem they have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = {"mode": "PERMISSIVE", "maxStringLen": str(2**31 - 1)}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; lines count from 1 in each file, however it is split.

    Lines of one split follow each other in their task; what stands before a split is summed from one count for each.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(counts, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_closed(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """(file, line, problems, record, value): record has the schema and is null for a bad line; value is the line, null for a good one.

    Problems: not_json, not_an_object, unknown:<field> (the schema is closed), missing:<field> (a required one, absent or
    null), wrong_type:<field>. Blank lines are no records. A record's problems are all named, the fields in order.
    """
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"[\t\r]", " ")) != "")
    whole = F.try_parse_json("value")
    fields = F.when(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.array_sort(F.json_object_keys("value")))
    typed = F.from_json("value", schema, LONG)
    held = lines.withColumn("whole", whole).withColumn("fields", fields).withColumn("typed", typed)
    names = F.array(*(F.lit(f.name) for f in schema))
    told = lambda prefix, of: F.transform(of, lambda x: F.concat(F.lit(prefix), x))
    given = lambda name: F.try_variant_get("whole", f"$['{name}']", "string")
    missing = F.array_compact(F.array(*(F.when(given(n).isNull(), F.lit(n)) for n in required)).cast("array<string>"))
    wrong = F.array_compact(F.array(*(F.when(given(f.name).isNotNull() & F.col("typed")[f.name].isNull(), F.lit(f.name)) for f in schema)).cast("array<string>"))
    problems = (
        F.when(F.col("whole").isNull(), F.array(F.lit("not_json")))
        .when(F.col("fields").isNull(), F.array(F.lit("not_an_object")))
        .otherwise(F.concat(told("unknown:", F.array_except("fields", names)), told("missing:", missing), told("wrong_type:", wrong)))
    )
    made = held.withColumn("problems", problems)
    good = F.size("problems") == 0
    return made.select("file", "line", "problems", F.when(good, F.col("typed")).alias("record"), F.when(~good, F.col("value")).alias("value"))
