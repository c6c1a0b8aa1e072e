"""Stored records: preparing, quarantine, decisions on passages and vectors, review, sheets, sessions and drafts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import gold_import, ranking
from ..operators import records as R
from ..operators import retention as retention_days
from ..session import shared_path
from .base import JUDGMENTS, PASSAGES, derived, judgments, passages, query, table, twin
from .retrieval import CHANNEL, DENSE, FUSED, found

NOW = "timestamp '2024-01-31'"


def now():
    return F.expr("timestamp_ntz'2024-01-31'")


#: Texts as they are, and passages as they were cut from other texts, by another version, or from documents that are gone.
TEXTS = "select doc_id, md5(case when doc_id % 19 = 0 then '' else text end) as text_hash, length(case when doc_id % 19 = 0 then '' else text end) as size from {documents} where doc_id % 31 <> 0"
CUT = "select doc_id, md5(case when doc_id % 7 = 0 then text || '!' when doc_id % 19 = 0 and doc_id % 2 = 0 then '' else text end) as text_hash, case when doc_id % 11 = 0 then 'v1' else 'v2' end as version from {documents} where doc_id % 4 <> 0"


@query("c08_chunk_decision", f"select doc_id, case when coalesce(t.size, 0) = 0 and c.version is null then 'skip' when coalesce(t.size, 0) = 0 then 'delete' when c.version is null then 'new' when c.text_hash = t.text_hash and c.version = 'v2' then 'unchanged' else 'changed' end as decision from ({twin(TEXTS)}) t full join ({twin(CUT)}) c using (doc_id)")
def chunk_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_decisions(derived(spark, sf_dir, TEXTS), derived(spark, sf_dir, CUT), "v2")


@query("c09_embedding_decision", f"with p as ({PASSAGES}) select chunk_id, case when ordinal % 6 = 0 then 'new' when ordinal % 6 = 1 then 'embed again' when ordinal % 6 = 2 or doc_id % 23 = 0 then 'back-fill' else 'unchanged' end as decision from p")
def embedding_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, context = F.col("ordinal") % 6, F.md5(F.col("doc_id").cast("string"))
    p = passages(spark, sf_dir).select("chunk_id", "ordinal", "doc_id", F.col("content_hash").alias("input_hash"), context.alias("context_hash"))
    held = p.where(k != 0).select("chunk_id", F.when(k == 1, "old").otherwise(F.col("input_hash")).alias("input_hash"), F.when(k == 2, F.lit(None)).when(F.col("doc_id") % 23 == 0, "old").otherwise(F.col("context_hash")).alias("context_hash"))
    return R.embedding_decisions(p, held)


@query("c10_embedding_input", f"with x as (select chunk_id, string_split(source || ' ' || lang || ' case number ' || doc_id::varchar, ' ') as prefix, regexp_extract_all(content, '\\S+') as t from ({PASSAGES}) join documents using (doc_id)) select chunk_id, case when len(t) <= 60 then case when 59 - len(t) > 0 then array_to_string(prefix[1:59 - len(t)], ' ') || chr(10) || chr(10) else '' end || array_to_string(t, ' ') end as input from x")
def embedding_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(" ", "source", "lang", F.lit("case number"), F.col("doc_id").cast("string")), " ").alias("prefix"))
    p = passages(spark, sf_dir).join(d, "doc_id")
    return p.select("chunk_id", R.embedding_input(F.col("prefix"), F.regexp_extract_all("content", F.lit(r"(\S+)"), 1), 60).alias("input"))


EXPORTED = "select doc_id as row_number, case when doc_id % 9 = 4 then 'Party without number' else citation end as citation, case doc_id % 10 when 3 then ' N/A ' when 5 then '' else text end as full_text, case when doc_id % 4 = 1 then '<p>' || text end as html, case when doc_id % 6 = 5 then 'read from a file: ' || text end as file_text, case when doc_id % 8 = 0 then 'null' else court_code end as language from ({judgments})".replace("{judgments}", JUDGMENTS)
SIZE = "coalesce(length(coalesce(ft, file_text)), 0)"


@query("c02_prepared_records", f"""with e as (select *, case when row_number % 10 in (3, 5) or trim(full_text) = '' then null else trim(full_text) end as ft, case when row_number % 8 = 0 then null else language end as lang, trim(regexp_replace(citation, '\\s*Copy\\s*$', '')) as plain from ({twin(EXPORTED)})),
s as (select *, case when {SIZE} = 0 then case when html is not null then 'conversion_pending' else 'missing' end when {SIZE} < 200 then 'short' else 'available' end as text_status from e)
select row_number, text_status, len(list_filter([ft, html, file_text], lambda x: x is not null)) as n_sources,
  array_to_string(list_filter([case when row_number % 9 = 4 then 'no_citation' end, case when text_status = 'missing' then 'no_text' end, case when text_status = 'short' then 'short_text' end, case when lang is null then 'no_language' end], lambda x: x is not null), ',') as issues,
  case when row_number % 9 <> 4 then regexp_extract(plain, '\\[(\\d{{4}})\\]', 1)::int end as year,
  sha256(plain || chr(31) || coalesce(lang, '∅') || chr(31) || array_to_string(list_filter([case when ft is not null then 'text=' || sha256(ft) end, case when html is not null then 'html=' || sha256(trim(html)) end, case when file_text is not null then 'file=' || sha256(trim(file_text)) end], lambda x: x is not null), ';')) as record_hash from s""")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.prepared(derived(spark, sf_dir, EXPORTED))
    return made.select("row_number", "text_status", F.size("sources").cast("long").alias("n_sources"), F.array_join("issues", ",").alias("issues"), "year", "record_hash")


#: What is stored, and what an import brings: a third of it new, some of it changed, and some addresses twice with different content.
STORED = "select uri, 'eligible' as status, md5(case when doc_id % 5 = 0 then 'old' else text end) as record_hash from ({judgments}) where doc_id % 3 <> 0".replace("{judgments}", JUDGMENTS)
ACCEPTED = "select uri, eligibility as status, md5(text) as record_hash from ({judgments}) where doc_id % 7 <> 0".replace("{judgments}", JUDGMENTS)


@query("c01_merged_state", f"select uri, coalesce(a.status, s.status) as status, coalesce(a.record_hash, s.record_hash) as record_hash, case when a.uri is null then 'kept' when s.uri is null then 'inserted' when a.record_hash <> s.record_hash then 'updated' else 'unchanged' end as outcome from ({twin(STORED)}) s full join ({twin(ACCEPTED)}) a using (uri)")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(derived(spark, sf_dir, STORED), derived(spark, sf_dir, ACCEPTED))


@query("s18_quarantined", f"select uri, case when doc_id % 13 = 0 then 'quarantined' else 'eligible' end as status, case when doc_id % 13 = 0 then 'conflict' else md5(case when doc_id % 5 = 0 then 'old' else text end) end as record_hash from ({twin(JUDGMENTS)}) where doc_id % 3 <> 0")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflicts = judgments(spark, sf_dir).where("doc_id % 13 = 0").select("uri")
    return R.quarantined(derived(spark, sf_dir, STORED), conflicts.union(conflicts)).select("uri", "status", "record_hash")


@query("c17_final_score", f"with {CHANNEL}, {DENSE}, {FUSED} select qid, chunk_id, round(coalesce(rerank, rrf), 9) as score, case when lexical_rank is not null and dense_rank is not null then 'hybrid' when dense_rank is not null then 'dense' else 'lexical' end as channel from final")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir)
    return f.select("qid", "chunk_id", F.round(ranking.final_score(f), 9).alias("score"), ranking.channel_of(f).alias("channel"))


@query("a14_mean_confidence", f"with w as (select chunk_id, unnest(regexp_extract_all(content, '\\S+')) as word from ({PASSAGES})) select chunk_id, round(avg((length(word) * 37) % 101), 2) as confidence, count(*) as words from w group by chunk_id")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = passages(spark, sf_dir).select("chunk_id", F.explode(F.regexp_extract_all("content", F.lit(r"(\S+)"), 1)).alias("word"))
    return words.groupBy("chunk_id").agg(F.round(F.avg((F.length("word") * 37) % 101), 2).alias("confidence"), F.count("*").alias("words"))


@query("r05_page_flags", "select doc_id, i - 1 as page, array_to_string(list_filter([case when length(trim(content)) = 0 then 'empty' end, case when coalesce(confidence, 0) < 40 then 'low_confidence' end], lambda x: x is not null), ',') as flags from (select *, case when i % 5 = 0 then null else (length(content) * 7) % 100 end as confidence from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "content"))
    c = F.when((F.col("page") + 1) % 5 == 0, F.lit(None)).otherwise((F.length("content") * 7) % 100).cast("double")
    return p.select("doc_id", F.col("page").cast("long").alias("page"), F.array_join(R.page_flags(c, F.col("content"), 40.0), ",").alias("flags"))


#: Gold questions with every kind of mistake in some of them.
GOLD = "select case when item_id % 17 = 3 then item_id - 1 else item_id end as id, case when item_id % 9 = 4 then ' ' else text end as question, case item_id % 5 when 0 then 'citation' when 1 then 'name' when 2 then 'other' else 'words' end as category, 2000 as year_from, case when item_id % 6 = 1 then 1990 else 2010 end as year_to, item_id % 4 as n_gold, item_id % 8 = 5 as expect_no_answer, item_id % 3 = 0 as reviewed, case when item_id % 4 = 3 then 'one' else 'two' end as third from {benchmark}"


@query("s13_gold_problems", f"with g as (select *, count(*) over (partition by id) > 1 as twice from ({twin(GOLD)})) select id, array_to_string(list_filter([case when twice then 'duplicate_id' end, case when trim(question) = '' then 'empty_question' end, case when category = 'other' then 'unknown_category' end, case when year_from > year_to then 'years_reversed' end, case when not expect_no_answer and n_gold = 0 then 'gold_missing' end, case when expect_no_answer and n_gold > 0 then 'gold_unexpected' end, case when n_gold = 3 then 'gold_repeated' end, case when reviewed and not expect_no_answer and n_gold = 0 then 'reviewed_without_gold' end], lambda x: x is not null), ',') as problems from g")
def gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived(spark, sf_dir, GOLD).withColumn("gold_uris", F.slice(F.array(F.lit("one"), F.lit("zwei"), F.col("third")), F.lit(1), F.col("n_gold").cast("int")))
    return R.gold_problems(g).select("id", F.array_join("problems", ",").alias("problems"))


ASKED = "select item_id as id, text as question, case when item_id % 4 = 0 then 'court=en' end as filters from {benchmark}"
SHEET = "select case when item_id % 11 = 5 then item_id + 100000 when item_id % 13 = 6 then item_id - 1 else item_id end as id, case when item_id % 7 = 2 then 'another question' else text end as question, case when item_id % 4 = 0 and item_id % 3 <> 0 then 'court=en' end as filters, case item_id % 6 when 0 then 'x' when 1 then '0' when 2 then null else cast(1 + item_id % 40 as string) end as rank, case item_id % 5 when 0 then null when 1 then 'ftp://x' else 'https://host/' || cast(item_id as string) end as url, case when item_id % 10 = 9 then 'many' else '12' end as results, case when item_id % 9 = 0 then '2024-13-01' else '2024-05-0' || cast(1 + item_id % 9 as string) end as searched_on from {benchmark} where item_id % 10 <> 7"


@query("s16_sheet_problems", f"""with s as (select *, count(*) over (partition by id) > 1 as twice from ({twin(SHEET)})), q as ({twin(ASKED)})
select s.id, array_to_string(list_filter([case when twice then 'duplicate_id' end, case when q.id is null then 'unknown_id' end, case when s.question <> q.question then 'stale_question' end, case when q.id is not null and s.filters is distinct from q.filters then 'stale_filters' end, case when not regexp_matches(rank, '^[1-9][0-9]*$') then 'bad_rank' end, case when rank is not null and url is null then 'rank_without_url' end,
  case when not regexp_matches(url, '^https?://[^ ]+$') then 'bad_url' end, case when not regexp_matches(results, '^[0-9]+$') then 'bad_results' end, case when try_cast(searched_on as date) is null then 'bad_date' end], lambda x: x is not null), ',') as problems from s left join q on s.id = q.id
union all select id, 'missing_row' from q where id not in (select id from s)""")
def sheet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sheet_problems(derived(spark, sf_dir, SHEET), derived(spark, sf_dir, ASKED)).select("id", F.array_join("problems", ",").alias("problems"))


@query("r09_stale_rows", f"select id, case when s.question <> q.question then 'question' else 'filters' end as reason from ({twin(SHEET)}) s join ({twin(ASKED)}) q using (id) where s.question <> q.question or s.filters is distinct from q.filters")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stale_rows(derived(spark, sf_dir, SHEET), derived(spark, sf_dir, ASKED))


#: A review log: what each user's events would do to an item of the same number.
REVIEWS = "select user_id as id, ts as reviewed_at, case event_type when 'view' then 'create' when 'click' then 'approve' when 'purchase' then 'reopen' else 'retire' end as action, cast(event_id % 3 as int) as version from {events}"
STEPS = {"create": ("draft", ("",)), "approve": ("approved", ("draft",)), "reopen": ("draft", ("approved", "retired")), "retire": ("retired", ("draft", "approved"))}


@query("c29_review_history", f"""with recursive e as (select *, row_number() over (partition by id order by reviewed_at, action, version) as n from ({twin(REVIEWS)})),
h as (select id, 0::bigint as n, null::timestamp as reviewed_at, ''::varchar as action, ''::varchar as status, 0 as version, null::varchar as refused from (select distinct id from e)
  union all select e.id, e.n, e.reviewed_at, e.action, case when bad or e.version <> h.version then h.status when e.action = 'approve' then 'approved' when e.action = 'retire' then 'retired' else 'draft' end, case when bad or e.version <> h.version then h.version else h.version + 1 end, case when bad then 'illegal_step' when e.version <> h.version then 'version_conflict' end
  from h join e on e.id = h.id and e.n = h.n + 1, lateral (select not coalesce((e.action = 'create' and h.status = '') or (e.action = 'approve' and h.status = 'draft') or (e.action = 'reopen' and h.status in ('approved', 'retired')) or (e.action = 'retire' and h.status in ('draft', 'approved')), false) as bad))
select id, reviewed_at, action, status, version, refused from h where n > 0""")
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_history(derived(spark, sf_dir, REVIEWS).withColumnRenamed("reviewed_at", "at"), STEPS).withColumnRenamed("at", "reviewed_at")


@query("r08_gold_rows", "select item_id, status = 'approved' as reviewed, '{\"id\":' || item_id::varchar || ',\"version\":' || (item_id % 4)::varchar || ',\"status\":\"' || status || '\",\"question\":\"' || lang || '\"}' as snapshot from (select item_id, case item_id % 3 when 0 then 'approved' when 1 then 'draft' else 'retired' end as status, coalesce(lang, 'none') as lang from benchmark left join documents on doc_id = item_id)")
def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang"), "item_id", "left")
    status = F.when(F.col("item_id") % 3 == 0, "approved").when(F.col("item_id") % 3 == 1, "draft").otherwise("retired")
    return b.select("item_id", R.gold_row(F.col("item_id"), status, F.col("item_id") % 4, F.coalesce("lang", F.lit("none"))).alias("g")).select("item_id", "g.*")


#: Sessions from sign-in events: each ends after a week, some were revoked an hour later, and users with odd numbers above 40 aren't active.
SESSIONS = "select event_id as token, user_id, ts as created, ts + interval 7 day as expires, case when event_id % 5 = 0 then ts + interval 1 hour end as revoked, ts + case event_id % 4 when 0 then interval 1 hour when 1 then interval 30 hour else interval 100 hour end as last_seen, not (user_id > 40 and user_id % 2 = 1) as active from {events} where event_type = 'signup'"


@query("t02_valid_sessions", f"select token from ({twin(SESSIONS)}) where expires > {NOW} and revoked is null and last_seen + interval 48 hour > {NOW} and active and created <= {NOW}")
def valid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid_sessions(derived(spark, sf_dir, SESSIONS), now(), 48).select("token")


@query("r15_revoked_sessions", f"select token, (case when user_id % 3 = 0 and token % 7 <> 0 then least(coalesce(revoked, {NOW}), {NOW}) else revoked end)::varchar as revoked from ({twin(SESSIONS)})")
def revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.revoke(derived(spark, sf_dir, SESSIONS), now(), F.col("user_id") % 3 == 0, F.col("token") % 7 == 0)
    return s.select("token", F.col("revoked").cast("string").alias("revoked"))


ENDED = "least(expires, coalesce(revoked, expires), last_seen + interval 48 hour)"


@query("c31_retention", f"with s as ({twin(SESSIONS)}), e as (select * from events) select 'audit' as kind, count(*) as deleted from e where event_type = 'view' and ts < {NOW} - interval 20 day union all select 'auth', count(*) from e where event_type = 'error' and ts < {NOW} - interval 14 day union all select 'ledger', count(*) from e where event_type = 'purchase' and ts < {NOW} - interval 25 day union all select 'session', count(*) from s where {ENDED} < {NOW} - interval 7 day")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = derived(spark, sf_dir, SESSIONS).withColumn("ended", F.least("expires", "revoked", F.col("last_seen") + F.make_dt_interval(hours=F.lit(48))))
    rules = [("audit", e.where("event_type = 'view'"), "ts", 20), ("auth", e.where("event_type = 'error'"), "ts", 14), ("ledger", e.where("event_type = 'purchase'"), "ts", 25), ("session", s, "ended", 7)]
    counts = [R.expired(rows, F.col(age), now(), days).agg(F.lit(kind).alias("kind"), F.count("*").alias("deleted")) for kind, rows, age, days in rules]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("h02_file_digest", "select page_id, sha256(html) as digest from pages")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"))


@query("r06_version_tags", "select lang, 'chunks-' || max(n_chars)::varchar || '-' || left(sha256(string_agg(distinct source, ',' order by source)), 12) as tag from documents group by lang")
def version_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.sha2(F.array_join(F.array_sort(F.collect_set("source")), ","), 256)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(V.version_tag("chunks", F.max("n_chars"), sources).alias("tag"))


@query("r16_normal_email", "select c_custkey, lower(trim(' ' || upper(c_name) || '@Host.Example ')) as email from customer")
def email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", V.normal_email(F.concat(F.lit(" "), F.upper("c_name"), F.lit("@Host.Example "))).alias("email"))


@query("r21_report_rates", "select label, total, present, total - present as missing, present < total as needs_more, round(present / 3.5, 2) as per_second from (select label, count(*) as total, count(*) filter (where vec_id % 3 > 0) as present from embeddings group by label)")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("vec_id") % 3 > 0).alias("present"))
    return c.select("label", "total", "present", (F.col("total") - F.col("present")).alias("missing"), (F.col("present") < F.col("total")).alias("needs_more"), F.round(F.col("present") / 3.5, 2).alias("per_second"))


DRAFTS = "select item_id, case when item_id % 9 = 0 then '  ' else ' ' || text || ' ' end as question, case item_id % 4 when 0 then ' 2001 ' when 1 then 'x' when 2 then ' ' else '2020' end as year_from, case item_id % 5 when 0 then '2010' when 1 then 'next' else null end as year_to from {benchmark}"


@query("b02_drafts", f"select item_id, nullif(trim(question), '') as question, nullif(trim(year_from), '') as year_from, nullif(trim(year_to), '') as year_to from ({twin(DRAFTS)})")
def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DRAFTS).select("item_id", *R.draft({c: F.col(c) for c in ("question", "year_from", "year_to")}))


@query("b01_draft_problems", f"""with d as (select item_id, nullif(trim(question), '') as question, nullif(trim(year_from), '') as year_from, nullif(trim(year_to), '') as year_to, string_split(question, '. ') as parts from ({twin(DRAFTS)}))
select item_id, array_to_string(list_filter([case when question is null then 'no_question' end, case when year_from is not null and try_cast(year_from as int) is null then 'bad_year_from' end, case when year_to is not null and try_cast(year_to as int) is null then 'bad_year_to' end, case when try_cast(year_from as int) > try_cast(year_to as int) then 'years_reversed' end, case when len(list_filter(parts, lambda p: length(p) < 20)) > 0 then 'short_passage' end], lambda x: x is not null), ',') as problems from d""")
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived(spark, sf_dir, DRAFTS).withColumn("parts", F.split("question", r"\. "))
    d = raw.select("item_id", "parts", *R.draft({c: F.col(c) for c in ("question", "year_from", "year_to")}))
    return d.select("item_id", F.array_join(R.draft_problems(F.col("question"), F.col("year_from"), F.col("year_to"), F.col("parts")), ",").alias("problems"))


@query("b03_toggled_cases", "with s as (select user_id, list_sort(list(distinct event_type)) as kinds, list_sort(list(distinct event_type || '/' || (event_id % 3)::varchar)) as marked from events group by user_id) select user_id, array_to_string(list_sort(case when list_contains(kinds, 'click') then list_filter(kinds, lambda x: x <> 'click') else list_append(kinds, 'click') end), ',') as cases, array_to_string(case when list_contains(kinds, 'click') then list_filter(marked, lambda x: not starts_with(x, 'click/')) else marked end, ',') as passages from s")
def toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    passage = F.struct(F.col("event_type").alias("case"), F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("text"))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"), F.array_sort(F.collect_set(passage)).alias("p"))
    t = s.select("user_id", R.toggle_case(F.col("k"), F.col("p"), F.lit("click")).alias("t"))
    return t.select("user_id", F.array_join(F.array_sort("t.cases"), ",").alias("cases"), F.array_join(F.transform("t.passages", lambda p: p["text"]), ",").alias("passages"))


#: Kinds of events with their days, and what is kept longer.
KEPT_DAYS = {"view": 20, "error": 14, "purchase": 25}


@query("t04_retention_run", "select event_type, count(*) filter (where gone) as deleted, count(*) filter (where not gone) as kept from (select event_type, coalesce(ts < timestamp '2024-01-30 12:00:00' - case event_type when 'view' then interval 20 day when 'error' then interval 14 day else interval 25 day end and not (event_type = 'error' and user_id % 5 = 0), false) as gone from events where event_type in ('view', 'error', 'purchase')) group by event_type")
def retention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in day partitions; their expired days are deleted and what is left is read again."""
    e = table(spark, sf_dir, "events")
    schema, counts = "event_id long, user_id long, ts timestamp_ntz", []
    for kind, days in KEPT_DAYS.items():
        path = shared_path(spark, f"kept-{kind}")
        retention_days.write_days(e.where(F.col("event_type") == kind).select("event_id", "user_id", "ts"), "ts", path)
        cutoff = (datetime(2024, 1, 30, 12) - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")
        gone, _ = retention_days.delete_expired(spark, path, schema, "ts", cutoff, "user_id % 5 = 0" if kind == "error" else None)
        left = retention_days.read_days(spark, path, schema)
        counts.append(left.agg(F.lit(kind).alias("event_type"), F.lit(gone).cast("long").alias("deleted"), F.count("*").alias("kept")))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


GOLD_STORED = "select item_id as id, cast(1 + item_id % 3 as int) as version, case when item_id % 2 = 0 then 'approved' else 'draft' end as status, text as question, case when item_id % 5 = 0 then null else item_id % 7 end as year_from, array('u' || cast(item_id as string)) as gold from {benchmark} where item_id % 4 <> 0"
GOLD_NEW = "select item_id as id, case when item_id % 6 = 1 then text || '?' else text end as question, case when item_id % 10 = 0 then null else item_id % 7 end as year_from, array(case when item_id % 9 = 2 then 'v' else 'u' end || cast(item_id as string)) as gold from {benchmark} where item_id % 8 <> 3"
GOLD_FIELDS = ["question", "year_from", "gold"]


def gold_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    history = spark.createDataFrame([], "id long, version int, at string, field string, old string, new string")
    return gold_import.import_items(derived(spark, sf_dir, GOLD_STORED), history, derived(spark, sf_dir, GOLD_NEW), "id", GOLD_FIELDS, "2024-01-31")


GOLD_DIFF = f"""with s as ({twin(GOLD_STORED).replace("array(", "list_value(")}), n as ({twin(GOLD_NEW).replace("array(", "list_value(")}),
j as (select id, version, n.question as q, s.question as oq, n.year_from as y, s.year_from as oy, n.gold as g, s.gold as og from n left join s using (id)),
d as (select *, list_filter([case when q is distinct from oq then 'question' end, case when y is distinct from oy then 'year_from' end, case when g is distinct from og then 'gold' end], lambda x: x is not null) as c from j)"""


@query("c29_gold_differences", f"{GOLD_DIFF} select id, case when version is null then 'new' when len(c) > 0 then 'changed' else 'unchanged' end as change, coalesce(version, 0) + case when version is null or len(c) > 0 then 1 else 0 end as version, array_to_string(c, ',') as fields from d")
def gold_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = gold_imports(spark, sf_dir)[2]
    return told.select("id", "change", "version", F.array_join(F.transform("changes", lambda x: x["field"]), ",").alias("fields"))


@query("c29_gold_history", f"{GOLD_DIFF} select id, coalesce(version, 0) + 1 as version, f as field, case f when 'question' then oq when 'year_from' then oy::varchar else '[\"' || og[1] || '\"]' end as old, case f when 'question' then q when 'year_from' then y::varchar else '[\"' || g[1] || '\"]' end as new from (select *, unnest(c) as f from d)")
def gold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_imports(spark, sf_dir)[1].drop("at")
