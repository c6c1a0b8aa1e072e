"""Sheets that people fill in: CSV files with a header, quoted so that any text comes back as it was."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the sheet for the query writer and of that for the recorder.
QUERY_COLUMNS = ("id", "category", "question", "filters", "keyword_query")
SHEET_COLUMNS = (
    "id", "category", "question", "keyword_query", "filters_to_apply", "filters", "look_for", "verbatim_rank", "verbatim_url", "verbatim_result_count",
    "keywords_rank", "keywords_url", "keywords_result_count", "searched_on", "notes",
)
CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_sheet(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """A sheet with exactly these columns, in order; those that rows lack are empty, to be filled in, and nulls are empty too."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    rows.select(text).write.options(**CSV, quoteAll="true").csv(path)


def read_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A filled sheet, every value as trimmed text and never null; other columns than these are an error, whatever their order."""
    rows = spark.read.options(**CSV).csv(path)
    if problems := sorted(set(columns) ^ set(rows.columns)):
        raise ValueError(f"the sheet's columns differ: {', '.join(problems)}")
    return rows.select(*(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) for c in columns))


def look_for(cases: DataFrame, key: str) -> DataFrame:
    """(key, look_for) from cases(key, citation, uri): what a recorder should look for, by address, each once."""
    told = F.array_sort(F.collect_set(F.struct("uri", "citation")))
    return cases.groupBy(key).agg(F.array_join(F.transform(told, lambda c: F.concat(c["citation"], F.lit(" ("), c["uri"], F.lit(")"))), " | ").alias("look_for"))
