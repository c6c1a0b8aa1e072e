"""Filters, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions import text as T
from ..operators import evaluation, ranking, snapshots
from ..plans import chunking
from .base import JUDGMENTS, PASSAGES, judgments, passages, query, table, twin

J = f"with j as ({twin(JUDGMENTS)})"
P = f"with p as ({PASSAGES})"
LIST_JUDGES = "['Judge ' || court_code, 'Ann Mensah ' || (doc_id % 7)::varchar]"


@query("f01_search_filters", f"{J} select doc_id from j where eligibility = 'eligible' and court_code = 'en' and judgment_date >= date '2003-01-01' and judgment_date < date '2016-01-01' and len(list_filter({LIST_JUDGES}, lambda n: contains(lower(n), 'mensah 3'))) > 0")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.concat(F.lit("Judge "), "court_code"), F.concat(F.lit("Ann Mensah "), (F.col("doc_id") % 7).cast("string")))
    day = F.col("judgment_date")
    return judgments(spark, sf_dir).where((F.col("eligibility") == "eligible") & (F.col("court_code") == "en") & (day >= F.make_date(F.lit(2003), F.lit(1), F.lit(1))) & (day < F.make_date(F.lit(2016), F.lit(1), F.lit(1))) & F.exists(names, lambda n: F.lower(n).contains("mensah 3"))).select("doc_id")


@query("f03_membership", f"{J} select doc_id, uri from j where source_text_hash in (select source_text_hash from j where doc_id % 10 = 0)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    return j.join(j.where("doc_id % 10 = 0").select("source_text_hash"), "source_text_hash", "left_semi").select("doc_id", "uri")


@query("f04_citation_predicate", f"{J} select doc_id from j where regexp_matches(' ' || regexp_replace(upper(citation), '[^A-Z0-9]+', ' ', 'g') || ' ', ' [0-9]{{4}} ENSC 1[0-9] ')")
def citation_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import normal_citation

    return judgments(spark, sf_dir).where(normal_citation(F.col("citation")).rlike(r"(^| )[0-9]{4} ENSC 1[0-9]( |$)")).select("doc_id")


@query("f07_stale_versions", "select l_orderkey, l_linenumber from lineitem where nullif(l_returnflag, 'N') is distinct from 'R'")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(~F.nullif(F.col("l_returnflag"), F.lit("N")).eqNullSafe(F.lit("R"))).select("l_orderkey", "l_linenumber")


@query("f08_exists_not_exists", "select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def exists_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kept = o.join(line.where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    returned = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    return kept.join(returned, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.col("k").isNotNull().alias("returned"))


@query("f12_verified_bounds", "select l_orderkey, l_linenumber, case when l_linestatus = 'O' then l_linenumber end as page_start from lineitem")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).alias("page_start"))


@query("f13_source_link", f"{J} select doc_id, 'https://example.org' || uri as link from j")
def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", F.concat(F.rtrim(F.lit("https://example.org//"), F.lit("/")), "uri").alias("link"))


@query("f15_keyset_page", "select doc_id from documents where doc_id > 400 order by doc_id limit 50")
def keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id > 400").orderBy("doc_id").limit(50).select("doc_id")


@query("f16_substring_search", "select doc_id, coalesce(contains(lower(text), 'thing'), false) as any_case, coalesce(contains(text, 'Thing'), false) as same_case from documents")
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.lower(t).contains("thing"), F.lit(False)).alias("any_case"), F.coalesce(t.contains("Thing"), F.lit(False)).alias("same_case"))


@query("f18_status_filter", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority like '1-%'")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P") & F.col("o_orderpriority").startswith("1-")).select("o_orderkey")


@query("f19_violations", """select 'documents' as tab, doc_id as id, case when n_chars <> length(text) then 'span' else 'lang' end as problem from documents where n_chars <> length(text) or lang not in ('en', 'fr', 'de')
union all select 'embeddings', vec_id, 'dimension' from embeddings where len(embedding) <> 64 union all select 'customer', c_custkey, 'lower' from customer where lower(c_name) <> c_name""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, c = (table(spark, sf_dir, t) for t in ("documents", "embeddings", "customer"))
    wrong = F.col("n_chars") != F.length("text")
    a = d.where(wrong | ~F.col("lang").isin("en", "fr", "de")).select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), F.when(wrong, "span").otherwise("lang").alias("problem"))
    b = e.where(F.size("embedding") != 64).select(F.lit("embeddings").alias("tab"), F.col("vec_id").alias("id"), F.lit("dimension").alias("problem"))
    x = c.where(F.lower("c_name") != F.col("c_name")).select(F.lit("customer").alias("tab"), F.col("c_custkey").alias("id"), F.lit("lower").alias("problem"))
    return a.unionByName(b).unionByName(x)


@query("f21_rights_filter", "select source, count(*) as n from documents where source in ('src0', 'src3') group by source")
def rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src3")).groupBy("source").agg(F.count("*").alias("n"))


@query("f22_status_case", f"{J} select doc_id, case when length(text) = 0 then 'missing' when doc_id % 5 = 0 then 'pending' else 'available' end as status, case when length(text) = 0 then 'quarantined' when judgment_date is null and doc_id % 2 = 0 then 'warning' else 'eligible' end as decision from j")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.length("text") == 0
    return judgments(spark, sf_dir).select("doc_id", F.when(empty, "missing").when(F.col("doc_id") % 5 == 0, "pending").otherwise("available").alias("status"), F.when(empty, "quarantined").when(F.col("judgment_date").isNull() & (F.col("doc_id") % 2 == 0), "warning").otherwise("eligible").alias("decision"))


@query("f23_year_parse", "select event_id, case when regexp_matches(substr(ts::varchar, 1, 4), '^[0-9]{4}$') and substr(ts::varchar, 1, 4)::int between 1900 and 2100 then substr(ts::varchar, 1, 4)::int end as year, event_id % 200 between 0 and 149 as within_depth from events")
def year_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.substring(F.col("ts").cast("string"), 1, 4)
    return table(spark, sf_dir, "events").select("event_id", F.when(y.rlike("^[0-9]{4}$") & y.cast("int").between(1900, 2100), y.cast("int")).alias("year"), (F.col("event_id") % 200).between(0, 149).alias("within_depth"))


@query("j01_passages_with_cases", f"with j as ({twin(JUDGMENTS)}), p as ({PASSAGES}) select chunk_id, citation, judgment_date::varchar as day from p join j using (doc_id) where eligibility = 'eligible'")
def with_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).where("eligibility = 'eligible'").select("doc_id", "citation", F.col("judgment_date").cast("string").alias("day"))
    return passages(spark, sf_dir).join(j, "doc_id").select("chunk_id", "citation", "day")


@query("j02_sources_with_pages", "select o_orderkey, count(*) as pages, sum(l_quantity) as quantity from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'F' group by o_orderkey")
def sources_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("pages"), F.sum("l_quantity").alias("quantity"))


VECTORS = "select vec_id, vec_id % 400 as doc_id, 'm' || cast(label as string) as model, case when vec_id % 9 = 0 then 'old' else md5(cast(vec_id % 400 as string)) end as context from {embeddings}"


@query("j04_current_vectors", f"""with v as ({twin(VECTORS)}) select d.doc_id, count(v.vec_id) as current from documents d left join v on v.doc_id = d.doc_id and v.model = 'm1' and v.context = md5(d.doc_id::varchar) group by d.doc_id""")
def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import derived

    v = derived(spark, sf_dir, VECTORS).where("model = 'm1'")
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("context"))
    return d.join(v, ["doc_id", "context"], "left").groupBy("doc_id").agg(F.count("vec_id").alias("current"))


@query("j05_three_way", "select n_name, count(*) as orders, sum(o_totalprice)::decimal(18,2)::double as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by n_name")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.sum("o_totalprice").cast("decimal(18,2)").cast("double").alias("total"))


@query("j07_late_text", f"{P}, top as (select chunk_id from p order by length(content) desc, chunk_id limit 20) select chunk_id, content from p semi join top using (chunk_id)")
def late_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    top = p.select("chunk_id", F.length("content").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(20).select("chunk_id")
    # Twenty rows by the limit.
    return p.join(F.broadcast(top), "chunk_id", "left_semi").select("chunk_id", "content")


@query("j08_neighbours", f"{P} select a.chunk_id as of_chunk, b.chunk_id from p a join p b on a.doc_id = b.doc_id and b.ordinal between a.ordinal - 1 and a.ordinal + 1")
def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).select("doc_id", "ordinal", "chunk_id")
    return ranking.neighbours(p, p, 1).select("of_chunk", "chunk_id")


@query("j11_chunk_counts", f"{P} select d.doc_id, (select count(*) from p where p.doc_id = d.doc_id) as chunks from documents d")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = passages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "documents").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"))


@query("j15_gold_containment", "select d.doc_id, count(*) as items, min(item_id) as first_item from documents d join benchmark b on contains(d.text, b.text) group by d.doc_id")
def gold_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = evaluation.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hit.groupBy("doc_id").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"))


@query("j17_live_sessions", "select e.event_id from events e join customer c on c.c_custkey = e.user_id where c.c_acctbal > 0 and e.ts >= timestamp '2024-01-10' and e.ts < timestamp '2024-01-20' and e.event_type <> 'error'")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return e.where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-01-20' and event_type <> 'error'").join(c, F.col("user_id") == F.col("c_custkey"), "left_semi").select("event_id")


@query("j18_display_names", "select s_suppkey, n_name, r_name from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("j19_unnest_parallel", "select user_id, unnest(ids) as event_id, unnest(kinds) as kind from (select user_id, list(event_id order by event_id) as ids, list(event_type order by event_id) as kinds from events group by user_id)")
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("all"))
    zipped = g.select("user_id", F.explode(F.arrays_zip(F.col("all.event_id").alias("ids"), F.col("all.event_type").alias("kinds"))).alias("x"))
    return zipped.select("user_id", F.col("x.ids").alias("event_id"), F.col("x.kinds").alias("kind"))


@query("a02_courts_mode", f"{J} select court_code, count(*) as n, (select s from (select source as s, count(*) as c from documents d where d.lang = j.court_code group by source) order by c desc, s limit 1) as common_source from j group by court_code")
def courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counts first, then the most frequent: no group of all rows is sorted.
    n = judgments(spark, sf_dir).groupBy("court_code", "jurisdiction").agg(F.count("*").alias("c"))
    return n.groupBy("court_code").agg(F.sum("c").alias("n"), F.min_by("jurisdiction", F.struct(-F.col("c"), F.col("jurisdiction"))).alias("common_source"))


@query("a03_version_state", "select l_orderkey, min(l_returnflag) as version, count(distinct l_returnflag) = 1 as uniform from lineitem group by l_orderkey")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("version"), (F.min("l_returnflag") == F.max("l_returnflag")).alias("uniform"))


@query("a06_status_counts", "with s as (select unnest(['F', 'O', 'P', 'X']) as status) select status, count(o_orderkey) as n from s left join orders on o_orderstatus = status group by status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([(x,) for x in "FOPX"], "status string")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return s.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("a07_fingerprint", "select lang, count(*) as n, count(*) filter (where length(text) > 1000) as long_texts, sum(('0x' || substr(md5(doc_id::varchar || chr(31) || text), 1, 15))::bigint::hugeint)::varchar as digest from documents group by lang")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A sum of row digests: it needs no order, so tasks add up what they read and one number of each group shuffles.
    line = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), "text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 1000).alias("long_texts"), F.sum(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))


@query("a08_import_prepass", "select md5(text) as text_hash, count(*) as rows, count(distinct source) as sources, count(distinct lang || text) > 1 as conflict, string_agg(distinct source, ',' order by source) as published from documents group by md5(text) having count(*) > 1")
def prepass(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("rows"), F.countDistinct("source").alias("sources"), (F.countDistinct(F.concat("lang", F.sha2("text", 256))) > 1).alias("conflict"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("published"))
    return g.where("rows > 1")


@query("a09_outcome_counts", "select count(*) as read, count(*) filter (where n_chars = 0) as empty, count(*) filter (where n_chars between 1 and 500) as short, count(*) filter (where n_chars > 500) as stored, max(n_chars) as longest from documents")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("read"), F.count_if(n == 0).alias("empty"), F.count_if(n.between(1, 500)).alias("short"), F.count_if(n > 500).alias("stored"), F.max(n).alias("longest"))


@query("a11_nearest_rank", "select o_orderpriority, list_sort(list(o_totalprice))[round_even(0.5 * (count(*) - 1), 0)::int + 1] as p50, list_sort(list(o_totalprice))[round_even(0.95 * (count(*) - 1), 0)::int + 1] as p95 from orders group by o_orderpriority")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p95": 0.95})


@query("a15_next_id", "select event_type, 'q-' || lpad((max(regexp_extract('q-' || event_id::varchar, '([0-9]+)$', 1)::bigint) + 1)::varchar, 6, '0') as next_id from events group by event_type")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract(F.concat(F.lit("q-"), F.col("event_id").cast("string")), "([0-9]+)$", 1).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.concat(F.lit("q-"), F.lpad((F.max(n) + 1).cast("string"), 6, "0")).alias("next_id"))


@query("a16_year_histogram", "select year(o_orderdate)::int as year, count(*) as n, avg(length(o_orderpriority)) as mean, median(length(o_orderpriority)) as middle, sum(length(o_orderpriority))::bigint as total from orders group by 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.median(n).alias("middle"), F.sum(n).alias("total"))


@query("a17_distinct_rows", "select distinct lang, source from documents")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("a18_all_pass", "select lang, bool_and(n_chars > 0) as all_full, bool_or(n_chars > 20000) as any_long from documents group by lang")
def all_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.every(F.col("n_chars") > 0).alias("all_full"), F.some(F.col("n_chars") > 20000).alias("any_long"))


@query("w01_distinct_passages", f"{P} select distinct on (content_hash) content_hash, chunk_id, length(content) as score from p order by content_hash, score desc, doc_id, chunk_id")
def distinct_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).withColumn("score", F.length("content").cast("long"))
    # An aggregate, not a window: copies meet before the shuffle.
    best = p.groupBy("content_hash").agg(F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), F.col("doc_id"), F.col("chunk_id"))).alias("b"))
    return best.select("content_hash", "b.chunk_id", "b.score")


@query("w02_case_cap", f"{P} select chunk_id from (select chunk_id, row_number() over (partition by source_text_hash order by length(content) desc, chunk_id) as n from p) where n <= 3")
def case_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cap_per_group(passages(spark, sf_dir), ["source_text_hash"], [F.length("content").desc(), F.col("chunk_id")], 3).select("chunk_id")


@query("w07_first_wins", "select doc_id from (select doc_id, row_number() over (partition by md5(text) order by doc_id) as n from documents) where n = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("w08_last_wins", "select user_id, max(event_id) as event_id from events group by user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("w09_leading_and_closing", f"{P}, r as (select *, row_number() over (partition by doc_id order by ordinal) as a, row_number() over (partition by doc_id order by ordinal desc) as b from p) select doc_id, chunk_id, case when a = 1 then 'leading' else 'closing' end as role from r where a = 1 or b <= 3")
def leading_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy
    r = passages(spark, sf_dir).select("doc_id", "chunk_id", F.row_number().over(w("ordinal")).alias("a"), F.row_number().over(w(F.desc("ordinal"))).alias("b"))
    return r.where("a = 1 or b <= 3").select("doc_id", "chunk_id", F.when(F.col("a") == 1, "leading").otherwise("closing").alias("role"))


@query("w10_page_offsets", f"{P} select chunk_id, coalesce(sum(length(content) + 2) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0)::bigint as start from p")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return passages(spark, sf_dir).select("chunk_id", F.coalesce(F.sum(F.length("content") + 2).over(w), F.lit(0)).cast("long").alias("start"))


@query("w11_carry_section", f"{P} select chunk_id, last_value(case when length(content) < 40 then content end ignore nulls) over (partition by doc_id order by ordinal rows between unbounded preceding and current row) as section from p")
def section(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return passages(spark, sf_dir).select("chunk_id", F.last(F.when(F.length("content") < 40, F.col("content")), ignorenulls=True).over(w).alias("section"))


@query("w12_sentence_windows", """with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as s from documents),
w as (select distinct doc_id, array_to_string(s[i:i + k - 1], ' ') as run from (select doc_id, s, k, unnest(range(1, greatest(len(s) - k + 1, 1) + 1)) as i from l, (select unnest([1, 2, 3]) as k) where len(s) > 0)) select doc_id, run from w""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentence_windows(lines)).alias("run"))


@query("w14_page_of_span", f"with p as ({PASSAGES}), s as (select doc_id, ordinal as page, length(content) as n, sum(length(content) + 2) over (partition by doc_id order by ordinal) - length(content) - 2 as start from p), d as (select doc_id, max(start + n) as size from s group by doc_id), a as (select doc_id, unnest(range(0, size::bigint, 100)) as at from d) select a.doc_id, a.at::int as char_at, max(page) as page from a join s on s.doc_id = a.doc_id and start <= a.at group by all")
def page_of_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chunking.join_pages(passages(spark, sf_dir).select("doc_id", F.col("ordinal").alias("page"), F.col("content").alias("text")))
    spans = joined.select("doc_id", "page_starts", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(100))).alias("char_at"))
    return spans.select("doc_id", "char_at", chunking.page_of(F.col("page_starts"), F.col("char_at")).alias("page"))


@query("l01_stable_order", f"{J} select doc_id, row_number() over (order by judgment_date nulls last, uri) as place from j")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.numbered(judgments(spark, sf_dir).select("doc_id", "judgment_date", "uri"), [F.col("judgment_date").asc_nulls_last(), F.col("uri")], "place").select("doc_id", "place")


@query("l03_class_order", f"{J}, r as (select doc_id, case when doc_id % 50 = 7 then 0 when doc_id % 20 = 3 then 1 else 2 end as class from j) select doc_id, row_number() over (order by class, doc_id) as place from r")
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    r = judgments(spark, sf_dir).select("doc_id", F.when(k % 50 == 7, 0).when(k % 20 == 3, 1).otherwise(2).alias("class"))
    return ranking.numbered(r, [F.col("class"), k], "place").select("doc_id", "place")


@query("l05_fixed_slice", "select o_orderkey, place from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders) where place between 21 and 30")
def fixed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranking.ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 150, "place")
    return ranking.page(r, "place", 20, 10).select("o_orderkey", "place")


@query("l06_greedy_budget", f"""with recursive p as (select *, row_number() over (partition by doc_id order by ordinal) as n, (floor(length(content) / 3.5)::int + 40) as cost from ({PASSAGES})),
h as (select distinct doc_id, 0::bigint as n, 0::bigint as used, 0::bigint as held, ''::varchar as chosen from p
  union all select p.doc_id, p.n, case when fits then used + cost else used end, case when fits then held + 1 else held end, case when fits then chosen || case when chosen = '' then '' else ',' end || p.chunk_id::varchar else chosen end
  from h join p on p.doc_id = h.doc_id and p.n = h.n + 1, lateral (select held < 8 and used + cost <= 400 as fits))
select doc_id, arg_max(chosen, n) as chosen from h group by doc_id""")
def greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.verification import choose_within_budget

    p = passages(spark, sf_dir)
    items = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", V.estimate_tokens(F.col("content")).alias("cost")))).alias("items"))
    return items.select("doc_id", F.array_join(F.transform(choose_within_budget(F.col("items"), 8, 400), lambda x: x["chunk_id"].cast("string")), ",").alias("chosen"))


@query("l07_source_choice", "select distinct on (l_orderkey) l_orderkey, l_linenumber from lineitem order by l_orderkey, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end, l_linenumber")
def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(rank, F.col("l_linenumber"))).alias("l_linenumber"))


@query("u01_twins_union", f"{J} select doc_id, uri from j where doc_id % 40 = 1 union select t.doc_id, t.uri from j t join j g on t.source_text_hash = g.source_text_hash where g.doc_id % 40 = 1")
def twins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    gold = j.where("doc_id % 40 = 1")
    return gold.select("doc_id", "uri").union(j.join(gold.select("source_text_hash"), "source_text_hash", "left_semi").select("doc_id", "uri")).distinct()


@query("u02_ordered_dedupe", "select user_id, string_agg(event_type, ',' order by first) as kinds from (select user_id, event_type, min(event_id) as first from events group by all) group by user_id")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("u03_set_operations", "with a as (select user_id, list_sort(list_distinct(list(event_type) filter (where value > 50))) as x, list_sort(list_distinct(list(event_type) filter (where value <= 20))) as y from events group by user_id) select user_id, array_to_string(list_sort(list_intersect(coalesce(x, []), coalesce(y, []))), ',') as both_sets, len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) as all_kinds from a")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("x"), F.collect_set(F.when(F.col("value") <= 20, F.col("event_type"))).alias("y"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_intersect("x", "y")), ",").alias("both_sets"), F.size(F.array_union("x", "y")).cast("long").alias("all_kinds"))


@query("u05_missing_ids", "select item_id from benchmark where item_id not in (select doc_id from labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "labels"), F.col("item_id") == F.col("doc_id"), "left_anti").select("item_id")


@query("s17_upsert", "with stored as (select o_orderkey, md5(o_orderstatus || o_totalprice::varchar) as v, o_orderstatus as s from orders where o_orderkey % 3 > 0), incoming as (select o_orderkey, case when o_orderkey % 5 = 0 then 'changed' else md5(o_orderstatus || o_totalprice::varchar) end as v, 'N' as s from orders where o_orderkey % 2 = 0) select coalesce(i.o_orderkey, s.o_orderkey) as o_orderkey, case when i.v is null or i.v = s.v then s.v else i.v end as version, case when i.v is null or i.v = s.v then s.s else i.s end as status from stored s full join incoming i using (o_orderkey)")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    v = F.md5(F.concat("o_orderstatus", F.col("o_totalprice").cast("string")))
    stored = o.where("o_orderkey % 3 > 0").select("o_orderkey", v.alias("version"), F.col("o_orderstatus").alias("status"))
    incoming = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(v).alias("version"), F.lit("N").alias("status"))
    return snapshots.upsert(stored, incoming, ["o_orderkey"], [F.col("version")], "version")


@query("s19_replace_children", "with f as (select distinct l_orderkey as k from lineitem where l_orderkey % 4 = 0 and l_linenumber = 1) select l_orderkey, l_linenumber, case when k is not null then 'fresh' else 'kept' end as state from lineitem left join f on k = l_orderkey where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'P') and (k is null or l_linenumber = 1)")
def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    stored = line.select("l_orderkey", "l_linenumber", F.lit("kept").alias("state"))
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    fresh = line.where("l_orderkey % 4 = 0 and l_linenumber = 1").join(parents, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", F.lit("fresh").alias("state"))
    return snapshots.replace_children(stored, parents, fresh, "l_orderkey")


@query("s20_newest_wins", "select distinct on (user_id, event_type) user_id, event_type, event_id, value from events order by user_id, event_type, ts desc, event_id desc")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id", "x.value")


@query("s21_backfill", "select vec_id, case when vec_id % 3 = 0 then md5(vec_id::varchar) end as context from embeddings where vec_id % 3 <> 1 union all select vec_id, 'old' from embeddings where vec_id % 3 = 1")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 1, "old").alias("context"))
    fill = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select("vec_id", F.md5(F.col("vec_id").cast("string")).alias("new"))
    return v.join(fill, "vec_id", "left").select("vec_id", F.coalesce("context", "new").alias("context"))


@query("s22_insert_absent", "select n_nationkey, n_name from nation where n_regionkey < 3 union all select n_nationkey, 'new' from nation where n_regionkey >= 3")
def absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return snapshots.insert_absent(n.where("n_regionkey < 3").select("n_nationkey", "n_name"), n.select("n_nationkey", F.lit("new").alias("n_name")), ["n_nationkey"])


@query("s31_snapshot_counts", " union all ".join(f"select '{t}' as tab, count(*) as n from {t}" for t in ("orders", "lineitem", "customer", "documents")))
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [table(spark, sf_dir, t).agg(F.lit(t).alias("tab"), F.count("*").alias("n")) for t in ("orders", "lineitem", "customer", "documents")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
