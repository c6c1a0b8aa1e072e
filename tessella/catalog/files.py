"""Readers and writers over columns of the tables, and streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_path
from ..sources import files, sheets, sqlite
from ..sources import jsonl as closed_lines
from ..streaming import events as stream
from .base import query, table

HEADS = "case page_id % 4 when 0 then '%PDF-1.4 ' when 1 then '{\\rtf1 ' when 2 then '' else 'PK' || chr(3) || chr(4) end"


@query("s04_sniff_mime", "select page_id, case page_id % 4 when 0 then 'application/pdf' when 1 then 'application/rtf' when 2 then 'text/html' else 'application/zip' end as mime from pages")
def sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    head = F.when(k == 0, "%PDF-1.4 ").when(k == 1, "{\\rtf1 ").when(k == 2, "").otherwise("PK\x03\x04")
    return table(spark, sf_dir, "pages").select("page_id", files.mime_type(F.encode(F.concat(head, "html"), "UTF-8")).alias("mime"))


@query("s05_visible_text")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_text(table(spark, sf_dir, "pages").select("page_id", "html"), files.visible_text, "html", "text").select("page_id", "text")


@query("s06_placeholder_pages")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(spark, sf_dir).select("page_id", (F.length("text") < files.PLACEHOLDER_CHARS).alias("placeholder"))


@query("s12_recognised_words", "select item_id, array_to_string(list_transform(range(0, (len(w) + 7) // 8), lambda i: array_to_string(w[8 * i + 1:8 * i + 8], ' ')), chr(10)) as text, round(list_avg(list_transform(range(0, len(w)), lambda i: (50 + i % 50)::double)), 2) as confidence from (select item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from benchmark)")
def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    line = lambda w, i: F.concat_ws("\t", F.lit("5\t1\t1\t1"), F.floor(i / 8).cast("string"), (i % 8).cast("string"), F.lit("0\t0\t0\t0"), (50 + i % 50).cast("string"), w)
    tsv = F.concat(F.lit("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"), F.array_join(F.transform("w", line), "\n"))
    return files.recognised_text(b.select("item_id", tsv.alias("tsv")), "item_id", "tsv")


@query("s14_jsonl_lines", """select doc_id, '{"doc_id":' || doc_id::varchar || ',"lang":"' || lang || '"' || case when doc_id % 2 = 0 then ',"source":"' || source || '"' else '' end || '}' as line, true as reads_back from documents""")
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    return files.json_lines(rows, "doc_id")


@query("s15_sheet_lines", "select o_orderkey, o_orderkey::varchar || ',' || o_orderstatus || ',' || o_orderpriority || ',' as line from orders")
def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit(None).cast("string").alias("notes"))).alias("line"))


@query("s26_run_record", "select lang, '{\"lang\":\"' || lang || '\",\"questions\":' || count(*)::varchar || ',\"longest\":' || max(n_chars)::varchar || '}' as record from documents group by lang")
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("questions"), F.max("n_chars").alias("longest"))
    return g.select("lang", F.to_json(F.struct("lang", "questions", "longest")).alias("record"))


@query("s28_event_frames", "select event_id, 2::bigint as n, 'stage,' || event_type as events, 'a' || chr(10) || 'b|' || user_id::varchar as data from events")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit(": hello\r\nevent: stage\r\ndata: a\r\ndata: b\r\n\r\nevent: "), "event_type", F.lit("\ndata:"), F.col("user_id").cast("string"), F.lit("\n\n"))
    f = e.select("event_id", files.event_frames(text).alias("f"))
    return f.select("event_id", F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda x: x["event"]), ",").alias("events"), F.array_join(F.transform("f", lambda x: x["data"]), "|").alias("data"))


@query("s30_crawl_projection", "select doc_id, case when length(text) > 500 then left(text, 500) || '...' else text end as text from documents")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") > 500, F.concat(F.left("text", F.lit(500)), F.lit("..."))).otherwise(F.col("text")).alias("text"))


@query("r04_machine_readable", "select page_id, length(regexp_replace(lower(html), '[^a-z0-9]', '', 'g')) >= 1000 as readable from pages")
def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", (F.length(T.squash(F.col("html"))) >= 1000).alias("readable"))


DAILY = "select event_type, date_trunc('day', ts)::date::varchar as day, count(*) as calls, sum(value::decimal(10,6))::double as spent from events group by all"


@query("t03_stream_daily_budget", DAILY)
def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema)
    r = stream.run_to_table(stream.daily_totals(e), "daily-totals", "complete")
    return r.select("event_type", F.to_date("w.start").cast("string").alias("day"), "calls", F.col("spent").cast("double").alias("spent"))


@query("t01_stream_lockout", "select event_id, n >= 5 as locked from (select event_id, count(*) over (partition by user_id order by ts, event_id range between interval 0 minutes preceding and current row) as z, (select count(*) from events b where b.user_id = a.user_id and b.event_type = 'error' and b.ts <= a.ts and b.ts >= a.ts - interval 1440 minutes and (b.ts < a.ts or b.event_id <= a.event_id)) as n from events a where event_type = 'error')".replace("count(*) over (partition by user_id order by ts, event_id range between interval 0 minutes preceding and current row) as z, ", ""))
def lockout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema)
    return stream.run_to_table(stream.lockouts(e, 5, 1440), "lockouts", "append").select("event_id", "locked")


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, written as SQLite files and read back by their source, with every value as text."""
    folder = shared_path(spark, "customers")
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    sqlite.write_files(own.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey"), "customer", folder)
    sqlite.register(spark)
    return spark.read.format("sqlite").options(path=folder, table="customer", required="c_custkey,c_name", rows_per_partition=500).load()


@query("s01_sqlite_rows", "select row_number() over (order by c_custkey) as row_number, c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def sqlite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir)


@query("s01_sqlite_filtered", "select * from (select row_number() over (order by c_custkey) as row_number, c_custkey::varchar as c_custkey, c_mktsegment from customer) where row_number > 10 and c_mktsegment = 'BUILDING'")
def sqlite_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, sf_dir).where("row_number > 10 and c_mktsegment = 'BUILDING'").select("row_number", "c_custkey", "c_mktsegment")


#: Benchmark items as lines, some of them bad.
LINES = """
select case item_id % 8 when 1 then '{{"id": ' || cast(item_id as string) when 2 then '[1, 2]' when 3 then '{{"id": "x", "question": "q"}}' when 4 then '{{"id": 5, "question": "q", "more": 1, "other": 2}}' when 5 then '{{"id": 6}}' when 6 then '   '
  else '{{"id": ' || cast(item_id as string) || ', "question": "w"}}' end as value from {benchmark}
"""


@query("s13_bad_lines", f"""with l as (select item_id % 8 as k from benchmark), p as (select unnest(case k when 1 then ['not_json'] when 2 then ['not_an_object'] when 3 then ['wrong_type:id'] when 4 then ['unknown:more', 'unknown:other'] when 5 then ['missing:question'] when 6 then [] else ['none'] end) as problem from l)
select problem, count(*) as n from p group by problem""")
def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "gold-lines")
    spark.sql(LINES, benchmark=table(spark, sf_dir, "benchmark")).write.text(path)
    found = closed_lines.read_closed(spark, path, closed_lines.T.StructType.fromDDL("id long, question string"), ("id", "question"))
    return found.select(F.explode(F.when(F.size("problems") > 0, F.col("problems")).otherwise(F.array(F.lit("none")))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


#: Questions for the sheets; some texts have quotes, commas and line ends.
QUESTIONS = "select item_id as id, case when item_id % 2 = 0 then 'words' else 'names' end as category, case when item_id % 3 = 0 then 'say \"it\", then' || chr(10) || text else text end as question, case when item_id % 4 = 0 then '{{\"court\":\"en\"}}' else '{{}}' end as filters from {benchmark}"


@query("s15_query_sheet", QUESTIONS.replace("{{", "{").replace("}}", "}").replace("from {benchmark}", ", '' as keyword_query from benchmark").replace("item_id as id", "item_id::varchar as id"))
def query_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet that a query writer gets, as it is read back."""
    path = shared_path(spark, "query-sheet")
    sheets.write_sheet(spark.sql(QUESTIONS, benchmark=table(spark, sf_dir, "benchmark")), sheets.QUERY_COLUMNS, path)
    return sheets.read_sheet(spark, path, sheets.QUERY_COLUMNS)


@query("s15_recording_sheet", "select item_id::varchar as id, 'query ' || item_id::varchar as keyword_query, 'Case ' || (item_id % 7)::varchar || ' (u' || (item_id % 7)::varchar || ') | Case x (z)' as look_for, '' as notes from benchmark")
def recording_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, items = shared_path(spark, "recording-sheet"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    gold = items.select("id", F.explode(F.array(F.struct(F.concat(F.lit("Case "), (F.col("id") % 7).cast("string")).alias("citation"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("uri")), F.struct(F.lit("Case x").alias("citation"), F.lit("z").alias("uri")))).alias("x")).select("id", "x.*")
    rows = items.withColumn("keyword_query", F.concat(F.lit("query "), F.col("id").cast("string"))).join(sheets.look_for(gold.union(gold), "id"), "id")
    sheets.write_sheet(rows, sheets.SHEET_COLUMNS, path)
    return sheets.read_sheet(spark, path, sheets.SHEET_COLUMNS).select("id", "keyword_query", "look_for", "notes")
