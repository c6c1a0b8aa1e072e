"""The registry, and the relations that queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query, with its SQL twin where SQL can express it."""

    def held(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return held


#: Relations in SQL that Spark and DuckDB both read. Documents stand for judgments: language for court, source for jurisdiction.
JUDGMENTS = """
select doc_id, md5(text) as source_text_hash, lang as court_code, 1990 + doc_id % 30 as year, 'Court ' || upper(lang) as court_name, source as jurisdiction,
  '/akn/' || lang || '/judgment/' || source || '/' || cast(1990 + doc_id % 30 as string) || '/' || cast(doc_id as string) || '/eng@'
    || cast(1990 + doc_id % 30 as string) || '-0' || cast(1 + doc_id % 9 as string) || '-1' || cast(doc_id % 10 as string) as uri,
  'Party' || cast(doc_id % 37 as string) || ' v. Other' || cast(doc_id % 11 as string) || ' (J' || cast(doc_id % 5 as string) || '/' || cast(doc_id as string) || '/2020) ['
    || cast(1990 + doc_id % 30 as string) || '] ' || upper(lang) || 'SC ' || cast(doc_id as string) || case when doc_id % 3 = 0 then ' Copy' else '' end as citation,
  case when doc_id % 17 = 0 then null else date '2000-01-01' + cast(doc_id % 8000 as int) end as judgment_date,
  case when doc_id % 13 = 0 then 'ineligible' else 'eligible' end as eligibility, text
from {documents}
"""
RAW_VALUES = """
select doc_id, case doc_id % 8 when 0 then ' N/A ' when 1 then 'null' when 2 then '' when 3 then '  ' || substr(text, 1, 30) || '  ' when 4 then 'NaN' when 5 then 'none' else substr(text, 1, 40) end as value
from {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation from the tables that it names in braces."""
    names = [t for t in ("documents", "orders", "customer", "nation", "events", "lineitem", "supplier", "part", "conversations", "benchmark", "embeddings", "pages", "labels", "region") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def twin(sql: str) -> str:
    """The same relation for an engine that has the tables by name."""
    for t in ("documents", "orders", "customer", "nation", "events", "lineitem", "supplier", "part", "conversations", "benchmark", "embeddings", "pages", "labels", "region"):
        sql = sql.replace("{" + t + "}", t)
    return sql


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, JUDGMENTS)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document that isn't blank: (doc_id, source_text_hash, ordinal, chunk_id, content, content_hash)."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.md5("text").alias("source_text_hash"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    lines = lines.where(F.trim("content") != "")
    return lines.select("doc_id", "source_text_hash", F.col("ordinal").cast("long").alias("ordinal"), (F.col("doc_id") * (1 << 32) + F.col("ordinal")).alias("chunk_id"), "content", F.md5("content").alias("content_hash"))


PASSAGES = """
select doc_id, source_text_hash, ordinal - 1 as ordinal, doc_id * 4294967296 + ordinal - 1 as chunk_id, content, md5(content) as content_hash
from (select doc_id, md5(text) as source_text_hash, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as ordinal from documents)
where trim(content) <> ''
"""
