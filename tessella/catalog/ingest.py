"""Import, extraction and file checks; English ranking; and the smaller operators around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import english
from ..functions import text as T
from ..functions import values as V
from ..plans import import_run, importing, lexical
from .base import JUDGMENTS, PASSAGES, derived, judgments, passages, query, table, twin
from .retrieval import NAMED, asked

EXPORT = "select doc_id as row_number, case when doc_id % 41 = 0 then null else 'u' || cast(case when doc_id % 5 = 0 then doc_id % 150 else doc_id end as string) end as uri, case when doc_id % 29 = 0 then '' when doc_id % 5 = 0 and doc_id % 2 = 0 then 'fixed' else text end as text from {documents}"
OUTCOMES = f"""
e as (select *, md5(text) as print from ({twin(EXPORT)})),
u as (select uri, count(distinct print) as contents, min(row_number) as first_row from e where uri is not null group by uri),
t as (select md5(text) as h, count(distinct uri) as uris from e where text <> '' group by 1),
r as (select row_number, e.uri, case when e.uri is null then 'invalid_uri' when contents > 1 then 'duplicate_uri_conflict' when row_number > first_row then 'duplicate_row' when text = '' then 'no_text' end as reason, coalesce(uris, 0) > 1 as shared_text
  from e left join u on e.uri = u.uri left join t on md5(e.text) = t.h),
o as (select row_number, uri, case when reason is null then 'accepted' when reason = 'duplicate_row' then 'skipped' else 'quarantined' end as outcome, reason, shared_text from r)
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived(spark, sf_dir, EXPORT)
    return importing.import_outcomes(e.withColumn("print", F.md5("text")))


@query("c01_import_outcomes", f"with {OUTCOMES} select * from o")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@query("c01_import_report", f"with {OUTCOMES} select outcome, reason, count(*) as n, count(*) filter (where shared_text) as warned from o group by all")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("outcome", "reason").agg(F.count("*").alias("n"), F.count_if("shared_text").alias("warned"))


#: An export with every kind of trouble, each told by the document's number; judgments' addresses are valid ones.
RUN = """
select doc_id as row_number, case when doc_id % 41 = 0 then 'no address' when doc_id % 5 = 1 and doc_id % 10 = 6 then replace(uri, cast(doc_id as string), cast(doc_id - 5 as string)) else uri end as url, 'A v. B [2020] ENSC ' || cast(doc_id as string) as citation,
  case when doc_id % 7 = 2 then ' N/A ' when doc_id % 11 = 3 then 'the same text in many documents' else text end as full_text, case when doc_id % 21 = 2 then '<p>' || text end as html,
  case when doc_id % 3 = 0 then 'files/' || cast(doc_id as string) end as file_path, case when doc_id % 9 = 0 then text when doc_id % 9 = 3 then '' end as file_text, lang as language,
  case when doc_id % 4 = 0 then 'some day' else '17 June 1963' end as judgment_date, case when doc_id % 37 = 5 then 'ValueError: broken' end as error
from (select doc_id, lang, text, '/akn/' || lang || '/judgment/' || source || '/2020/' || cast(doc_id as string) || '/eng@2020-01-01' as uri from {documents})
"""


def import_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_run.decided(derived(spark, sf_dir, RUN), spark.createDataFrame([], import_run.STORED))


@query("c01_import_run", f"""with e as (select *, case when row_number % 41 <> 0 then url end as uri, case when row_number % 7 = 2 or trim(full_text) = '' then null else trim(full_text) end as text from ({twin(RUN)})),
u as (select uri, count(*) > 1 as conflict from e where uri is not null group by uri),
d as (select row_number, case when e.uri is null then 'invalid_uri' when conflict then 'duplicate_uri_conflict' when error is not null then 'prepare_failed' when text is null and html is null and (file_path is null or file_text is null) then 'no_text_and_no_file' end as reason
  from e left join u using (uri))
select row_number, case when reason is null then 'accepted' when reason = 'prepare_failed' then 'failed' else 'quarantined' end as outcome, reason from d""")
def import_run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_run_rows(spark, sf_dir).select("row_number", "outcome", "reason")


@query("c01_run_report", f"""with e as (select *, case when row_number % 41 <> 0 then url end as uri, case when row_number % 7 = 2 or trim(full_text) = '' then null else trim(full_text) end as text from ({twin(RUN)})),
u as (select uri, count(*) > 1 as conflict from e where uri is not null group by uri),
d as (select *, case when e.uri is null then 'invalid_uri' when conflict then 'duplicate_uri_conflict' when error is not null then 'prepare_failed' when text is null and html is null and (file_path is null or file_text is null) then 'no_text_and_no_file' end as reason
  from e left join u using (uri))
select count(*) as rows_read, count(*) filter (where reason is null) as accepted, count(*) filter (where reason = 'prepare_failed') as failed, count(*) filter (where reason = 'invalid_uri') as invalid_uri,
  count(*) filter (where reason = 'duplicate_uri_conflict') as conflicts, count(*) filter (where reason is null) as inserted,
  count(*) filter (where coalesce(reason, 'no_text_and_no_file') = 'no_text_and_no_file' and row_number % 4 = 0) as unparsed_date,
  count(*) filter (where coalesce(reason, 'no_text_and_no_file') = 'no_text_and_no_file' and text is not null) as text_available from d""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run's report says."""
    r = import_run.run_import(derived(spark, sf_dir, RUN), dry_run=True)
    held = {"rows_read": r.rows_read, "accepted": r.accepted, "failed": r.failed, "invalid_uri": r.reasons.get("invalid_uri", 0), "conflicts": r.reasons.get("duplicate_uri_conflict", 0), "inserted": r.inserted - r.reasons.get("no_text_and_no_file", 0), "unparsed_date": r.warnings.get("unparsed_date", 0), "text_available": r.text_available}
    return spark.createDataFrame([tuple(held.values())], ", ".join(f"{k} long" for k in held))


@query("c03_content_fingerprint", "select doc_id, sha256(coalesce(case when doc_id % 3 = 0 then null else lang end, '∅') || chr(31) || source) as print from documents")
def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lang = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, " N/A ").otherwise("")).otherwise(F.col("lang"))
    return d.select("doc_id", importing.fingerprint({"lang": lang, "source": F.concat("source", F.lit(" Copy"))}).alias("print"))


@query("c05_extraction_candidates", "select l_orderkey as file_id, case when l_returnflag = 'N' then 'new' else 'stale' end as why from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P' where l_linenumber = 1 and l_linestatus = 'O' and ((l_returnflag = 'N' and l_orderkey % 2 = 0) or (l_orderkey % 2 = 1 and l_orderkey % 3 = 0)) and not (l_returnflag = 'N' and l_orderkey % 2 = 1)".replace("case when l_returnflag = 'N' then 'new' else 'stale' end", "case when l_orderkey % 2 = 0 then 'new' else 'stale' end"))
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "no").otherwise("eligible").alias("eligibility"))
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_linestatus = 'O'")
    new = F.col("l_returnflag") == "N"
    files = line.where(~(new & (F.col("l_orderkey") % 2 == 1))).select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("file_id"), F.when(new, "pending").otherwise("ready").alias("status"))
    pages = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 3 == 0, "v1").otherwise("v2").alias("version"))
    return importing.extraction_candidates(o, files, pages, "v2")


@query("c06_reassess_quality", "select doc_id from documents where (doc_id % 2 = 0) <> (doc_id % 100 < 40)")
def reassess(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 100).cast("double").alias("confidence"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return importing.reassessed(d, 40.0).select("doc_id")


FILES = "select doc_id, text as record, case doc_id % 6 when 0 then text when 1 then null when 2 then ' - ' when 3 then 'Cited as [2020]  ENSC 5 here' when 4 then 'Party Number Four against all' else 'nothing like it' end as file, 'Party Number Four [2020] ENSC 5' as citation, 'Party Number Four' as title, doc_id % 12 = 4 as shared from {documents}"


SQUASHED = "length(regexp_replace(lower(record), '[^a-z0-9]', '', 'g'))"


@query("x09_file_verdict", f"select doc_id, case doc_id % 6 when 0 then case when {SQUASHED} >= 20 then 'verified_text' when {SQUASHED} = 0 then 'unverified' else 'mismatch' end when 1 then 'missing' when 2 then 'unverified' when 3 then 'verified_citation' when 4 then case when shared then 'mismatch' else 'verified_title' end else 'mismatch' end as verdict from ({twin(FILES)})")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived(spark, sf_dir, FILES)
    return f.select("doc_id", importing.file_verdict(F.col("record"), F.col("file"), F.col("citation"), F.col("title"), F.col("shared")).alias("verdict"))


@query("x02_english_ranking")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english.ranked_matches(asked(spark, sf_dir), passages(spark, sf_dir), keys=table(spark, sf_dir, "documents").select("doc_id"))


@query("x02_all_words_match", f"with p as ({PASSAGES}), q as (select qid, coalesce(named, array_to_string(string_split(item, ' ')[3:8], ' ')) as text from ({twin(NAMED)})), w as (select qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from q), h as (select chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as word from p), a as (select qid, len(w) as n, unnest(w) as word from w) select qid, chunk_id, count(*) as hits from h join a using (word) group by qid, chunk_id, n having count(distinct word) = n")
def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.with_all_words(asked(spark, sf_dir), passages(spark, sf_dir), keys=table(spark, sf_dir, "documents").select("doc_id"))


KEY = b"key of the check"
INNER, OUTER = (bytes(b ^ x for b in KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))
HEX = lambda b: f"from_hex('{b.hex()}')"


@query("h06_keyed_hash", f"select c_custkey, sha256({HEX(OUTER)} || from_hex(sha256({HEX(INNER)} || lower(trim(c_name))::blob))) as digest from customer")
def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.sha2(F.concat(F.lit(bytearray(INNER)), F.encode(F.lower(F.trim("c_name")), "UTF-8")), 256)
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit(bytearray(OUTER)), F.unhex(inner)), 256).alias("digest"))


@query("h07_token_hash", "select event_id, sha256(props) as token, ('0x' || substr(sha256(props), 1, 15))::bigint as lock from events")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2("props", 256).alias("token"), V.lock_key(F.col("props")).alias("lock"))


@query("x01_english_lexemes")
def lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english.counted_lexemes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("a01_vector_coverage", "select label, count(*) as total, count(case when vec_id % 3 > 0 then vec_id end) as present from embeddings group by label")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("total"), F.count(F.when(F.col("vec_id") % 3 > 0, F.col("vec_id"))).alias("present"))


@query("c30_run_config", "select md5(string_agg(l, '' order by lang)) as config from (select lang, lang || '=' || count(*)::varchar || ';' as l from documents group by lang)")
def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.concat("lang", F.lit("="), F.count("*").cast("string"), F.lit(";")).alias("l"))
    return g.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "l"))), lambda x: x["l"]), "")).alias("config"))


@query("j03_sources_with_flag", "select c_custkey, o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_tax > 0.07) as flagged from customer join orders on o_custkey = c_custkey where c_acctbal > 5000")
def with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, line = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    flag = line.where("l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("f")).distinct()
    return c.where("c_acctbal > 5000").join(o, F.col("c_custkey") == F.col("o_custkey")).join(flag, "o_orderkey", "left").select("c_custkey", "o_orderkey", F.col("f").isNotNull().alias("flagged"))


@query("j16_set_overlap", "with a as (select user_id, list(distinct event_type) as kinds from events where value > 90 group by user_id) select user_id, list_has_any(kinds, ['purchase', 'signup']) as hit from a")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").where("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return a.select("user_id", F.arrays_overlap("kinds", F.array(F.lit("purchase"), F.lit("signup"))).alias("hit"))


@query("l02_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("l08_query_terms", "select item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: {'n': -length(w), 'w': w})), lambda x: x.w)[1:5], ' ') as terms from benchmark")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1))
    ordered = F.transform(F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), lambda x: x["w"])
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(ordered, 1, 5), " ").alias("terms"))


@query("u04_append_dedupe", "select o_orderkey, 'new' as origin from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'old' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("old").alias("origin"), F.lit(0).alias("seq")).unionByName(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("origin"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("extra")), allowMissingColumns=True)
    return rows.groupBy("o_orderkey").agg(F.max_by("origin", "seq").alias("origin"))


@query("u06_tagged_union", "select channel, count(*) as n from (select 'lexical' as channel from documents union all select 'dense' from embeddings) group by channel")
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "documents").select(F.lit("lexical").alias("channel")), table(spark, sf_dir, "embeddings").select(F.lit("dense").alias("channel"))
    return a.unionByName(b).groupBy("channel").agg(F.count("*").alias("n"))


@query("n16_sentences")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


LISTED = "select item_id as place, item_id * 3 as doc_id from {benchmark}"


@query("r03_listed_references", f"with j as ({twin(JUDGMENTS)}) select place, uri from ({twin(LISTED)}) l join j using (doc_id) where eligibility = 'eligible'")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, LISTED).join(judgments(spark, sf_dir).where("eligibility = 'eligible'"), "doc_id").select("place", "uri")


@query("b06_open_passage", f"with p as ({PASSAGES}) select chunk_id, case when ordinal % 3 = 0 then null else content_hash end as opened from p")
def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What a link names: an id of a passage, or something that only looks like one.
    named = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash"))
    return passages(spark, sf_dir).select("chunk_id", T.hex_id(named).alias("opened"))


@query("b07_known_events", "select event_id, case when event_type in ('click', 'view') and json_valid(props) then event_type end as event from events")
def known_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.try_parse_json("props").isNotNull()
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("click", "view") & valid, F.col("event_type")).alias("event"))


@query("t04_retention_kept", "select event_type, count(*) as kept from events where ts >= timestamp '2024-01-31' - case event_type when 'view' then interval 7 day when 'click' then interval 14 day else interval 21 day end group by event_type")
def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("event_type") == "view", 7).when(F.col("event_type") == "click", 14).otherwise(21)
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.expr("timestamp_ntz'2024-01-31'") - F.make_dt_interval(days)).groupBy("event_type").agg(F.count("*").alias("kept"))
