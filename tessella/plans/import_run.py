"""One run of an import: every row decided once, counted as it passes, and three sinks: what is stored, issues and the report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import records
from ..session import shared_path
from .importing import file_verdict

QUARANTINE = ("invalid_uri", "duplicate_uri_conflict", "prepare_failed", "no_text_and_no_file")
WARNINGS = ("duplicate_uri_identical", "file_mismatch", "file_missing", "unparsed_date", "shared_text")
VERDICTS = ("verified", "mismatch", "missing", "unverified")
STORED = "uri string, status string, record_hash string"


@dataclass
class Report:
    dry_run: bool
    rows_read: int = 0
    accepted: int = 0
    quarantined: int = 0
    skipped_duplicate: int = 0
    failed: int = 0
    inserted: int = 0
    updated: int = 0
    skipped_unchanged: int = 0
    text_available: int = 0
    ocr_pending: int = 0
    conversion_pending: int = 0
    reasons: dict = field(default_factory=dict)
    warnings: dict = field(default_factory=dict)
    files: dict = field(default_factory=dict)


def decided(rows: DataFrame, stored: DataFrame, least_chars: int = 1) -> DataFrame:
    """Per row: row_number, uri, outcome (accepted, quarantined, skipped, failed), reasons, warnings, text_status, file, change, record_hash.

    rows(row_number, url, citation, full_text, html, file_path, file_text, language, judgment_date, error). file_text is what was
    read from the file at file_path, null if there is none; error says why a row couldn't be prepared. An address with
    more than one content quarantines all its rows; of equal rows the first counts; a row that failed is quarantined
    and the run goes on; a row with neither text nor a file is quarantined, and is stored as such. change says what an
    accepted row does to stored(uri, status, record_hash).
    """
    clean = {c: T.clean_value(F.col(c)) for c in ("citation", "full_text", "html", "file_path", "language", "judgment_date")}
    r = rows.select("row_number", T.judgment_path(T.clean_value(F.col("url")))["uri"].alias("uri"), "file_text", "error", *(v.alias(k) for k, v in clean.items()))
    content = V.stable_hash(*(F.col(c) for c in ("citation", "full_text", "html", "file_path", "language", "judgment_date")))
    r = r.withColumn("text", T.without_navigation(F.col("full_text"))).withColumn("print", content)
    by_uri = r.where("uri is not null").groupBy("uri").agg((F.min("print") != F.max("print")).alias("conflict"), F.min("row_number").alias("first_row"))
    long_enough = F.length("text") >= least_chars
    by_text = r.where(long_enough & F.col("uri").isNotNull()).groupBy(F.md5("text").alias("text_hash")).agg((F.min("uri") != F.max("uri")).alias("shared_text"))
    by_file = r.where("file_path is not null and uri is not null").groupBy("file_path").agg((F.min("uri") != F.max("uri")).alias("shared_file"))
    j = r.withColumn("text_hash", F.when(long_enough, F.md5("text"))).join(by_uri, "uri", "left").join(by_text, "text_hash", "left").join(by_file, "file_path", "left")
    has_file = F.col("file_path").isNotNull()
    j = j.withColumn("verdict", F.when(has_file, F.regexp_replace(file_verdict(F.coalesce("text", F.lit("")), F.col("file_text"), F.col("citation"), T.title_of(F.col("citation")), F.coalesce("shared_file", F.lit(False))), "^verified_.*", "verified")))
    available, readable = F.coalesce(long_enough, F.lit(False)), F.coalesce(F.col("verdict") != "missing", F.lit(False))
    status = F.when(available, "available").when(F.col("html").isNotNull(), "conversion_pending").when(readable, "ocr_pending").otherwise("missing")
    j = j.withColumn("text_status", status)
    early = F.when(F.col("uri").isNull(), "invalid_uri").when(F.col("conflict"), "duplicate_uri_conflict")
    twice = early.isNull() & (F.col("row_number") > F.col("first_row"))
    reason = early.when(twice, None).when(F.col("error").isNotNull(), "prepare_failed").when(status == "missing", "no_text_and_no_file")
    outcome = F.when(twice, "skipped").when(reason == "prepare_failed", "failed").when(reason.isNotNull(), "quarantined").otherwise("accepted")
    # Rows that are set aside before they are prepared have no warnings of their own.
    read = ~twice & (reason.isNull() | (reason == "no_text_and_no_file"))
    warn = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    told = F.array_compact(F.array(
        warn("duplicate_uri_identical", twice), warn("file_mismatch", read & (F.col("verdict") == "mismatch")), warn("file_missing", read & (F.col("verdict") == "missing")),
        warn("unparsed_date", read & F.col("judgment_date").isNotNull() & T.judgment_date(F.col("judgment_date")).isNull()), warn("shared_text", read & F.col("shared_text")),
    ))
    j = j.select("row_number", "uri", outcome.alias("outcome"), reason.alias("reason"), told.alias("warnings"), F.when(read, F.col("text_status")).alias("text_status"), F.when(read, F.col("verdict")).alias("file"), F.col("print").alias("record_hash"), "error")
    # A row that is accepted, or kept as one without text, is compared with what is stored of its address.
    held = stored.select("uri", F.col("record_hash").alias("_held"), F.col("status").alias("_status"))
    kept = (F.col("outcome") == "accepted") | (F.col("reason") == "no_text_and_no_file")
    state = F.when(F.col("outcome") == "accepted", "eligible").otherwise("quarantined")
    change = F.when(F.col("_held").isNull(), "inserted").when((F.col("_held") != F.col("record_hash")) | (F.col("_status") != state), "updated").otherwise("unchanged")
    return j.join(held, "uri", "left").select(*j.columns, F.when(kept, change).alias("change"), F.when(kept, state).alias("status"))


def metrics() -> list[Column]:
    count = lambda condition, name: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    outcome = F.col("outcome")
    own = [F.count("*").alias("rows_read"), count(outcome == "accepted", "accepted"), count(outcome == "quarantined", "quarantined"), count(outcome == "skipped", "skipped_duplicate"), count(outcome == "failed", "failed")]
    own += [count(F.col("change") == c, n) for c, n in (("inserted", "inserted"), ("updated", "updated"), ("unchanged", "skipped_unchanged"))]
    own += [count(F.col("text_status") == s, n) for s, n in (("available", "text_available"), ("ocr_pending", "ocr_pending"), ("conversion_pending", "conversion_pending"))]
    own += [count(F.col("reason") == r, f"reason_{r}") for r in QUARANTINE] + [count(F.array_contains("warnings", w), f"warning_{w}") for w in WARNINGS]
    return own + [count(F.col("file") == v, f"file_{v}") for v in VERDICTS]


def issues_of(rows: DataFrame) -> DataFrame:
    """(row_number, uri, severity, reason, detail) of decided rows."""
    severe = F.when(F.col("reason").isNotNull(), F.array(F.struct(F.lit("quarantine").alias("severity"), F.col("reason").alias("reason"), F.when(F.col("reason") == "prepare_failed", F.col("error")).alias("detail"))))
    mild = F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("severity"), w.alias("reason"), F.lit(None).cast("string").alias("detail")))
    return rows.select("row_number", "uri", F.explode(F.concat(F.coalesce(severe, F.array().cast("array<struct<severity:string,reason:string,detail:string>>")), mild)).alias("x")).select("row_number", "uri", "x.*")


def next_state(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """stored with the decided rows over it; what an address in conflict had stored is set aside, to come back once the conflict is gone."""
    fresh = rows.where("change is not null").select("uri", "status", "record_hash")
    kept = records.quarantined(stored, rows.where("reason = 'duplicate_uri_conflict'").select("uri")).join(fresh, "uri", "left_anti")
    return kept.select("uri", "status", "record_hash").unionByName(fresh)


def run_import(rows: DataFrame, stored: DataFrame | None = None, limit: int | None = None, dry_run: bool = False, to: str | None = None, least_chars: int = 1) -> Report:
    """Decides all rows (with limit, the first ones by row number) and gives the report.

    The rows pass once: what they are written to, or with dry_run nothing, counts them on the way. Otherwise the folder
    `to` (a new shared one by default) gets rows, stored (the next state), issues and report; report is written last,
    so a folder that has one is whole, and a run that died is run again into another folder.
    """
    spark = rows.sparkSession
    if limit is not None:
        rows = rows.orderBy("row_number").limit(limit)
    stored = stored if stored is not None else spark.createDataFrame([], STORED)
    seen = Observation("import")
    made = decided(rows, stored, least_chars).observe(seen, *metrics())
    if dry_run:
        made.write.format("noop").mode("overwrite").save()
    else:
        to = to or shared_path(spark, "import")
        made.write.mode("error").parquet(f"{to}/rows")
    counts = seen.get
    some = lambda prefix: {k.removeprefix(prefix): v for k, v in counts.items() if k.startswith(prefix) and v}
    plain = {k: v for k, v in counts.items() if k in Report.__dataclass_fields__}
    report = Report(dry_run=dry_run, **plain, reasons=some("reason_"), warnings=some("warning_"), files=some("file_"))
    if not dry_run:
        held = spark.read.schema(made.schema).parquet(f"{to}/rows")
        issues_of(held).write.parquet(f"{to}/issues")
        next_state(stored, held).write.parquet(f"{to}/stored")
        spark.createDataFrame([(json.dumps(asdict(report), sort_keys=True),)], "value string").coalesce(1).write.text(f"{to}/report")
    return report
