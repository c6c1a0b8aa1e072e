"""Importing an export: what becomes of each row, decided in one pass over aggregates joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

GRAM, OVERLAP, LEAST_WINDOW = 20, 0.8, 10_000


def fingerprint(values: dict[str, Column]) -> Column:
    """A hash of a row's cleaned values by column name. How a missing value is marked makes no difference."""
    return V.stable_hash(*(T.clean_value(T.without_copy_label(values[name])) for name in sorted(values)))


def import_outcomes(rows: DataFrame, least_chars: int = 1) -> DataFrame:
    """rows(row_number, uri, text, print) with outcome, reason and shared_text.

    A URI with more than one content quarantines all its rows; of equal rows the first is accepted and the others are
    skipped; a row without a URI or text is quarantined; text that several URIs share is a warning.
    """
    by_uri = rows.groupBy("uri").agg(F.countDistinct("print").alias("contents"), F.min("row_number").alias("first_row"))
    by_text = rows.where(F.length("text") >= least_chars).groupBy(F.md5("text").alias("text_hash")).agg(F.countDistinct("uri").alias("uris"))
    held = rows.withColumn("text_hash", F.md5("text")).join(by_uri, "uri", "left").join(by_text, "text_hash", "left")
    reason = (
        F.when(F.col("uri").isNull(), "invalid_uri")
        .when(F.col("contents") > 1, "duplicate_uri_conflict")
        .when(F.col("row_number") > F.col("first_row"), "duplicate_row")
        .when(F.coalesce(F.length("text"), F.lit(0)) < least_chars, "no_text")
    )
    outcome = F.when(reason.isNull(), "accepted").when(reason == "duplicate_row", "skipped").otherwise("quarantined")
    return held.select("row_number", "uri", outcome.alias("outcome"), reason.alias("reason"), (F.coalesce("uris", F.lit(0)) > 1).alias("shared_text"))


def file_verdict(record: Column, file: Column, citation: Column, title: Column, shared: Column) -> Column:
    """Whether a file holds a record's text: by its words, then its citation, then its title if no other record has the file."""
    wanted = T.squash(record)

    def held(both: Column) -> Column:
        window = F.left(both["file"], F.greatest(4 * F.length(both["record"]), F.lit(LEAST_WINDOW)))
        return T.containment(T.ascii_grams(both["record"], GRAM), T.ascii_grams(window, GRAM)) >= OVERLAP

    # Squashed once; an optimizer would repeat them in each use.
    same = F.element_at(F.transform(F.array(F.struct(wanted.alias("record"), T.squash(file).alias("file"))), held), 1)
    named = T.containment(T.tokens(title), T.tokens(file)) >= OVERLAP
    number = T.neutral_citation(citation)
    spaced = lambda t: F.regexp_replace(F.upper(t), r"\s+|[\[\]()]", " ")
    key = F.concat_ws(r"\s+", number["year"].cast("string"), F.upper(number["court"]), number["number"].cast("string"))
    cited = F.coalesce(F.regexp_like(spaced(file), F.concat(F.lit(r"(^|\D)"), key, F.lit(r"(\D|$)"))), F.lit(False)) & number.isNotNull()
    return (
        F.when(file.isNull(), "missing")
        .when(F.length(T.squash(file)) == 0, "unverified")
        .when((F.length(wanted) >= GRAM) & same, "verified_text")
        .when(cited, "verified_citation")
        .when(~shared & named & (F.size(T.tokens(title)) > 0), "verified_title")
        .otherwise("mismatch")
    )


def extraction_candidates(records: DataFrame, files: DataFrame, pages: DataFrame, version: str) -> DataFrame:
    """Files of eligible records that are pending and have no pages, or whose pages another version made."""
    ready = files.join(records.where("eligibility = 'eligible'").select("doc_id"), "doc_id", "left_semi").where("status <> 'mismatch'")
    never = ready.where("status = 'pending'").join(pages, "file_id", "left_anti").select("file_id", F.lit("new").alias("why"))
    stale = ready.join(pages.where(~F.col("version").eqNullSafe(F.lit(version))), "file_id", "left_semi").select("file_id", F.lit("stale").alias("why"))
    return never.unionByName(stale)


def reassessed(pages: DataFrame, least_confidence: float) -> DataFrame:
    """Pages whose flags change when they are judged again from the stored text; nothing is read anew."""
    flags = F.array_sort(F.array_compact(F.concat(T.quality_flags(F.col("text")), F.array(F.when(F.col("confidence") < least_confidence, F.lit("low_confidence"))))))
    return pages.withColumn("now", flags).where(F.array_sort("flags") != F.col("now"))


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str]) -> DataFrame:
    """Row numbers from 1 within keys, in a given order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
