"""Decisions over stored records: what to cut, embed, keep, quarantine or review, as joins of what is with what was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def chunk_decisions(texts: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """(doc_id, decision) from texts(doc_id, text_hash, size) and the state(doc_id, text_hash, version) of their passages.

    delete: passages whose text is gone or empty; skip: no text and no passages; new; unchanged: same text and version; else changed.
    """
    held = state.select("doc_id", F.col("text_hash").alias("held_hash"), F.col("version").alias("held_version"))
    j = texts.join(held, "doc_id", "full")
    empty, none = F.coalesce("size", F.lit(0)) == 0, F.col("held_version").isNull()
    same = F.col("held_hash").eqNullSafe(F.col("text_hash")) & (F.col("held_version") == version)
    return j.select("doc_id", F.when(empty & none, "skip").when(empty, "delete").when(none, "new").when(same, "unchanged").otherwise("changed").alias("decision"))


def embedding_decisions(inputs: DataFrame, held: DataFrame) -> DataFrame:
    """(chunk_id, decision) from inputs(chunk_id, input_hash, context_hash) and the vectors held(chunk_id, the same hashes)."""
    h = held.select("chunk_id", F.col("input_hash").alias("held_input"), F.col("context_hash").alias("held_context"))
    decision = (
        F.when(F.col("held_input").isNull(), "new")
        .when(F.col("held_input") != F.col("input_hash"), "embed again")
        .when(~F.col("held_context").eqNullSafe(F.col("context_hash")), "back-fill")
        .otherwise("unchanged")
    )
    return inputs.join(h, "chunk_id", "left").select("chunk_id", decision.alias("decision"))


def embedding_input(prefix: Column, content: Column, most: int) -> Column:
    """prefix and content, arrays of tokens, as one input of at most `most` tokens: the prefix is cut, the content never.

    A blank line stands between them and takes one token. Null where the content alone is too long, which is an error.
    """
    room = F.greatest(F.lit(most - 1) - F.size(content), F.lit(0))
    head = F.when(room > 0, F.concat(F.array_join(F.slice(prefix, F.lit(1), room), " "), F.lit("\n\n"))).otherwise("")
    return F.when(F.size(content) <= most, F.concat(head, F.array_join(content, " ")))


def prepared(rows: DataFrame, least_chars: int = 200) -> DataFrame:
    """One record of each exported row: title, case_number, year, text_status, sources, issues, needs_review and record_hash.

    rows(row_number, citation, full_text, html, file_text, language). sources holds (kind, digest, size) of the texts that
    are there: a page's text without its navigation, its HTML, a file. issues lists what a reviewer should see.
    """
    clean = {c: T.clean_value(F.col(c)) for c in ("citation", "full_text", "html", "file_text", "language")}
    r = rows.select("row_number", F.coalesce(F.col("full_text").contains("\x00"), F.lit(False)).alias("nul"), *(v.alias(k) for k, v in clean.items()))
    r = r.withColumn("text", T.without_navigation(F.coalesce("full_text", "file_text"))).withColumn("plain", T.without_copy_label(F.col("citation")))
    source = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), V.sha256_text(F.col(c)).alias("digest"), F.length(c).alias("size")))
    size = F.coalesce(F.length("text"), F.lit(0))
    status = F.when(size == 0, F.when(F.col("html").isNotNull(), "conversion_pending").otherwise("missing")).when(size < least_chars, "short").otherwise("available")
    r = r.withColumn("text_status", status).withColumn("sources", F.array_compact(F.array(source("text", "full_text"), source("html", "html"), source("file", "file_text"))))
    issue = lambda name, when: F.when(when, F.lit(name))
    number = T.neutral_citation(F.col("plain"))
    issues = F.array_compact(F.array(issue("no_citation", number.isNull()), issue("nul_characters", F.col("nul")), issue("no_text", F.col("text_status") == "missing"), issue("short_text", F.col("text_status") == "short"), issue("no_language", F.col("language").isNull())))
    r = r.withColumn("issues", issues).withColumn("title", T.title_of(F.col("plain"))).withColumn("year", number["year"])
    hash_ = V.stable_hash(F.col("plain"), F.col("language"), F.array_join(F.transform("sources", lambda s: F.concat(s["kind"], F.lit("="), s["digest"])), ";"))
    return r.select("row_number", "title", "year", "text_status", "sources", "issues", (F.size("issues") > 0).alias("needs_review"), hash_.alias("record_hash"))


SENTINEL = "conflict"


def quarantined(stored: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Stored rows (uri, status, record_hash) with those of a conflicting URI set aside; their hash is a sentinel, so the next import that is clear restores them."""
    marked = conflicts.select("uri").distinct().withColumn("in_conflict", F.lit(True))
    hit = F.coalesce("in_conflict", F.lit(False))
    return stored.join(marked, "uri", "left").withColumn("status", F.when(hit, "quarantined").otherwise(F.col("status"))).withColumn("record_hash", F.when(hit, SENTINEL).otherwise(F.col("record_hash"))).drop("in_conflict")


def merged(stored: DataFrame, accepted: DataFrame) -> DataFrame:
    """The stored rows after an import, with outcome: inserted, updated, unchanged or kept (not in this import).

    Both are (uri, status, record_hash); a row is updated if its hash differs.
    """
    new = accepted.select("uri", F.col("status").alias("new_status"), F.col("record_hash").alias("new_hash"))
    j = stored.join(new, "uri", "full")
    none, gone = F.col("record_hash").isNull(), F.col("new_hash").isNull()
    outcome = F.when(gone, "kept").when(none, "inserted").when(F.col("record_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    return j.select("uri", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_hash", "record_hash").alias("record_hash"), outcome.alias("outcome"))


def page_flags(confidence: Column, text: Column, least: float) -> Column:
    """Flags of a page that was read by a machine."""
    return F.array_compact(F.array(F.when(F.length(F.trim(text)) == 0, F.lit("empty")), F.when(F.coalesce(confidence, F.lit(0.0)) < least, F.lit("low_confidence"))))


def gold_problems(questions: DataFrame) -> DataFrame:
    """(id, problems) of gold questions(id, question, category, year_from, year_to, gold_uris, expect_no_answer, reviewed).

    Every rule that a question breaks is named; an id that stands more than once breaks one in each of its rows.
    """
    twice = questions.groupBy("id").agg((F.count("*") > 1).alias("twice"))
    golds = F.size("gold_uris")
    rule = lambda name, broken: F.when(broken, F.lit(name))
    problems = F.array_compact(F.array(
        rule("duplicate_id", F.col("twice")), rule("empty_question", F.length(F.trim("question")) == 0), rule("unknown_category", ~F.col("category").isin("citation", "name", "words")),
        rule("years_reversed", F.col("year_from") > F.col("year_to")), rule("gold_missing", ~F.col("expect_no_answer") & (golds == 0)), rule("gold_unexpected", F.col("expect_no_answer") & (golds > 0)),
        rule("gold_repeated", golds != F.size(F.array_distinct("gold_uris"))), rule("reviewed_without_gold", F.col("reviewed") & ~F.col("expect_no_answer") & (golds == 0)),
    ))
    return questions.join(twice, "id").select("id", problems.alias("problems"))


def sheet_problems(sheet: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, problems) of recorded rows(id, question, filters, rank, url, results, searched_on), and of questions without a row.

    questions(id, question, filters) is what is asked now; a row whose question or filters differ is stale.
    """
    now = questions.select("id", F.col("question").alias("now_question"), F.col("filters").alias("now_filters"))
    twice = sheet.groupBy("id").agg((F.count("*") > 1).alias("twice"))
    rank = F.col("rank")
    rule = lambda name, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(name))
    problems = F.array_compact(F.array(
        rule("duplicate_id", F.col("twice")), rule("unknown_id", F.col("now_question").isNull()), rule("stale_question", F.col("question") != F.col("now_question")), rule("stale_filters", ~F.col("filters").eqNullSafe(F.col("now_filters")) & F.col("now_question").isNotNull()),
        rule("bad_rank", rank.isNotNull() & ~rank.rlike("^[1-9][0-9]*$")), rule("rank_without_url", rank.isNotNull() & F.col("url").isNull()), rule("bad_url", ~F.col("url").rlike("^https?://[^ ]+$")),
        rule("bad_results", ~F.col("results").rlike("^[0-9]+$")), rule("bad_date", F.try_to_date("searched_on", "yyyy-MM-dd").isNull()),
    ))
    told = sheet.join(twice, "id").join(now, "id", "left").select("id", problems.alias("problems"))
    return told.unionByName(questions.join(sheet, "id", "left_anti").select("id", F.array(F.lit("missing_row")).alias("problems")))


def stale_rows(sheet: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, reason) of recorded rows whose question or filters are no longer what is asked."""
    now = questions.select("id", F.col("question").alias("now_question"), F.col("filters").alias("now_filters"))
    reason = F.when(F.col("question") != F.col("now_question"), "question").when(~F.col("filters").eqNullSafe(F.col("now_filters")), "filters")
    return sheet.join(now, "id").select("id", reason.alias("reason")).where("reason is not null")


def gold_row(id_: Column, status: Column, version: Column, question: Column) -> Column:
    """(reviewed, snapshot): a stored question as it is exported, and what its history keeps."""
    return F.struct((status == "approved").alias("reviewed"), F.to_json(F.struct(id_.alias("id"), version.alias("version"), status.alias("status"), question.alias("question"))).alias("snapshot"))


def review_history(events: DataFrame, allowed: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """The history of reviewed items from events(id, at, action, version), as far as each step is legal.

    allowed: action -> (status it leads to, statuses it may come from; "" for none). A step counts if it comes from an
    allowed status and names the version that stands; others are refused with a reason and change nothing. Gives id,
    at, action, status and version after it, and refused.
    """
    steps = F.array_sort(F.collect_list(F.struct("at", "action", F.col("version").alias("named"))))
    leads = F.create_map(*(F.lit(x) for a, (to, _) in allowed.items() for x in (a, to)))
    froms = F.create_map(*(x for a, (_, f) in allowed.items() for x in (F.lit(a), F.array(*map(F.lit, f)))))
    kind = "array<struct<at:timestamp_ntz,action:string,status:string,version:int,refused:string>>"
    start = F.struct(F.lit("").alias("status"), F.lit(0).alias("version"), F.array().cast(kind).alias("out"))

    def step(s: Column, e: Column) -> Column:
        wrong = F.when(~F.coalesce(F.array_contains(F.try_element_at(froms, e["action"]), s["status"]), F.lit(False)), "illegal_step").when(e["named"] != s["version"], "version_conflict")
        status, version = F.when(wrong.isNull(), F.try_element_at(leads, e["action"])).otherwise(s["status"]), F.when(wrong.isNull(), s["version"] + 1).otherwise(s["version"])
        row = F.struct(e["at"].alias("at"), e["action"].alias("action"), status.alias("status"), version.alias("version"), wrong.alias("refused"))
        return F.struct(status.alias("status"), version.alias("version"), F.concat(s["out"], F.array(row)).alias("out"))

    return events.groupBy("id").agg(F.aggregate(steps, start, step, lambda s: s["out"]).alias("h")).select("id", F.explode("h").alias("h")).select("id", "h.*")


def valid_sessions(sessions: DataFrame, now: Column, idle_hours: int) -> DataFrame:
    """Sessions(token, user_id, created, expires, revoked, last_seen, active) that hold now: in time, not revoked, not idle, of an active user."""
    idle = F.col("last_seen") + F.make_dt_interval(hours=F.lit(idle_hours)) > now
    return sessions.where((F.col("expires") > now) & F.col("revoked").isNull() & idle & F.col("active") & (F.col("created") <= now))


def revoke(sessions: DataFrame, at: Column, which: Column, keep: Column | None = None) -> DataFrame:
    """The sessions with those of `which` revoked at a time, unless they are kept; a session stays revoked at the first time it was."""
    hit = which & (~keep if keep is not None else F.lit(True))
    return sessions.withColumn("revoked", F.when(hit, F.least(F.col("revoked"), at)).otherwise(F.col("revoked")))


def expired(rows: DataFrame, age: Column, now: Column, days: int) -> DataFrame:
    """What a retention run deletes: rows whose age lies more than so many days back."""
    return rows.where(age < now - F.make_dt_interval(F.lit(days)))


def draft(fields: dict[str, Column]) -> list[Column]:
    """Trimmed values; empty ones are null."""
    return [F.nullif(F.trim(c), F.lit("")).alias(name) for name, c in fields.items()]


def draft_problems(question: Column, year_from: Column, year_to: Column, passages: Column) -> Column:
    """The rules that a draft breaks: its years are numbers in order, it asks something, its passages have 20 characters."""
    first, last = year_from.try_cast("int"), year_to.try_cast("int")
    return F.array_compact(F.array(
        F.when(F.coalesce(F.length(question), F.lit(0)) == 0, F.lit("no_question")), F.when(year_from.isNotNull() & first.isNull(), F.lit("bad_year_from")), F.when(year_to.isNotNull() & last.isNull(), F.lit("bad_year_to")),
        F.when(first > last, F.lit("years_reversed")), F.when(F.exists(passages, lambda p: F.length(p) < 20), F.lit("short_passage")),
    ))


def toggle_case(cases: Column, passages: Column, case: Column) -> Column:
    """(cases, passages) with a case added, or removed with its passages; passages are structs (case, text)."""
    held = F.array_contains(cases, case)
    return F.struct(F.when(held, F.array_remove(cases, case)).otherwise(F.array_append(cases, case)).alias("cases"), F.when(held, F.filter(passages, lambda p: p["case"] != case)).otherwise(passages).alias("passages"))
