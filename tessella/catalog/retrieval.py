"""The search plan's channels, fusion, reranking, cases, and passages cut from documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking
from ..plans import chunking, lexical, pair_scorer, search, vector_index
from ..plans.lexical import SIMPLE
from .base import JUDGMENTS, PASSAGES, derived, judgments, passages, query, table, twin


#: Every tenth question is a citation, every tenth a case name, the others are words 3 to 8 of a benchmark item; some have filters.
NAMED = """
select b.item_id as qid, case when b.item_id % 10 = 3 then 'See [' || cast(1990 + b.item_id % 30 as string) || '] ' || upper(d.lang) || 'SC ' || cast(b.item_id as string)
  when b.item_id % 10 = 7 then 'Party' || cast(b.item_id % 37 as string) || ' v Other' || cast(b.item_id % 11 as string) end as named, b.text as item,
  case when b.item_id % 4 = 1 then 'en' end as court_code, case when b.item_id % 6 = 2 then 2000 end as year_from, case when b.item_id % 12 = 2 then 2012 end as year_to
from {benchmark} b left join {documents} d on d.doc_id = b.item_id
"""
#: Vectors of some judgments were made in a context that has changed since.
CURRENT = "doc_id % 23 <> 0"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: qid, text, and the filters court_code, year_from and year_to."""
    words = F.array_join(F.slice(F.split("item", " "), 3, 6), " ")
    return derived(spark, sf_dir, NAMED).select("qid", F.coalesce("named", words).alias("text"), "court_code", "year_from", "year_to")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages with what their judgment is filtered by, written once for a run."""
    held = passages(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("court_code")), "doc_id")
    return search.index_passages(held.withColumn("year", 1990 + F.col("doc_id") % 30).withColumn("current", F.expr(CURRENT)))


PASSES = "(q.court_code is null or coalesce(p.court_code = q.court_code, false)) and (q.year_from is null or p.year >= q.year_from) and (q.year_to is null or p.year <= q.year_to)"
#: Atoms of the questions q, where they begin in the passages' words pw, and ls, the score of the passages that match.
LEXICAL = r"""
tok as (select qid, unnest(t) as tok, generate_subscripts(t, 1) as i from (select qid, regexp_extract_all(text, '-?"[^"]*"|\S+') as t from q)),
alt as (select *, count(*) filter (where lower(tok) = 'or') over (partition by qid order by i) as g from tok),
ato as (select qid, g, i as atom, starts_with(tok, '-') as negated, regexp_extract_all(lower(tok), '[a-z0-9]+') as ws from alt where lower(tok) <> 'or' and len(ws) > 0
  qualify row_number() over (partition by qid, g, negated, ws order by i) = 1),
aw as (select qid, g, atom, negated, unnest(ws) as word, unnest(range(len(ws))) as off, len(ws) as n from ato),
ah as (select qid, g, atom, negated, chunk_id, place - off as place from pw join aw using (word) group by qid, g, atom, negated, chunk_id, place - off, n having count(*) = n),
need as (select qid, g, count(*) as n from ato where not negated group by qid, g),
gp as (select qid, g, chunk_id, n from ah join need using (qid, g) where not negated group by qid, g, chunk_id, n having count(distinct atom) = n),
gm as (select * from gp where not exists (select 1 from ah where negated and ah.qid = gp.qid and ah.g = gp.g and ah.chunk_id = gp.chunk_id)),
lasts as (select h.qid, h.g, h.chunk_id, n, h.place, h.atom, a.atom as other, max(a.place) as last from gm join ah h using (qid, g, chunk_id) join ah a using (qid, g, chunk_id)
  where not h.negated and not a.negated and a.place <= h.place group by all),
covers as (select qid, g, chunk_id, n, place, atom, min(last) as start from lasts group by qid, g, chunk_id, n, place, atom having count(*) = n),
shortest as (select qid, g, chunk_id, n, start, min(place) as place from covers group by all),
densities as (select qid, g, chunk_id, sum(1.0::double / (1 + greatest(place - start + 1 - n, 0))) as score from shortest group by qid, g, chunk_id),
ls as (select qid, chunk_id, round(max(score), 9) as score from densities group by qid, chunk_id)
"""
CHANNEL = f"""
n as ({twin(NAMED)}), q as (select qid, coalesce(named, array_to_string(string_split(item, ' ')[3:8], ' ')) as text, court_code, year_from, year_to from n),
p as materialized (select x.*, lang as court_code, 1990 + x.doc_id % 30 as year from ({PASSAGES}) x join documents using (doc_id)),
pw as materialized (select chunk_id, unnest(w) as word, generate_subscripts(w, 1) as place from (select chunk_id, regexp_extract_all(lower(content), '[a-z0-9]+') as w from p)),
{LEXICAL},
lo as (select qid, chunk_id, doc_id, source_text_hash, content_hash, score from ls join p using (chunk_id) join q using (qid) where {PASSES}
  qualify row_number() over (partition by qid, source_text_hash, content_hash order by score desc, doc_id, chunk_id) = 1),
lc as (select * from lo qualify row_number() over (partition by qid, source_text_hash order by score desc, doc_id, chunk_id) <= 3),
lexical as materialized (select *, row_number() over (partition by qid order by score desc, doc_id, chunk_id) as rank from lc qualify rank <= 450)
"""
DENSE = f"""
pb as (select chunk_id, substr(sha256(word), 63, 2) as b, count(*)::double as n from pw group by all),
pn as materialized (select chunk_id, b, n / sqrt(sum(n * n) over (partition by chunk_id)) as v from pb),
qb as (select qid, substr(sha256(word), 63, 2) as b, count(*)::double as n from (select qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from q) group by all),
qn as (select qid, b, n / sqrt(sum(n * n) over (partition by qid)) as v from qb),
hit as (select qid, chunk_id, round(sum(pn.v * qn.v), 9) as score from pn join qn using (b) group by all),
ds as (select q.qid, p.chunk_id, coalesce(score, 0) as score from q join p on {PASSES} and p.{CURRENT} left join hit on hit.qid = q.qid and hit.chunk_id = p.chunk_id),
dr as (select * from ds qualify row_number() over (partition by qid order by score desc, chunk_id) <= 600),
dd as (select qid, chunk_id, doc_id, source_text_hash, content_hash, score from dr join p using (chunk_id)
  qualify row_number() over (partition by qid, source_text_hash, content_hash order by score desc, doc_id, chunk_id) = 1),
dc as (select * from dd qualify row_number() over (partition by qid, source_text_hash order by score desc, doc_id, chunk_id) <= 3),
dense as materialized (select *, row_number() over (partition by qid order by score desc, doc_id, chunk_id) as rank from dc qualify rank <= 450)
"""
FUSED = """
fused as (select qid, source_text_hash, content_hash, coalesce(l.chunk_id, d.chunk_id) as chunk_id, coalesce(l.doc_id, d.doc_id) as doc_id, l.rank as lexical_rank, d.rank as dense_rank,
  coalesce(1.0::double / (60 + l.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0) as rrf, coalesce(l.rank, d.rank + (1::bigint << 40)) as seen
  from lexical l full join dense d using (qid, source_text_hash, content_hash)),
placed as (select *, row_number() over (partition by qid order by rrf desc, seen, chunk_id) as position from fused),
reranked as (select x.*, case when position <= 30 then round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(p.content), '[a-z0-9]+'))))::double
  / (1 + sqrt(len(regexp_extract_all(lower(p.content), '[a-z0-9]+')))), 9) end as rerank from placed x join q using (qid) join p using (chunk_id)),
final as (select *, row_number() over (partition by qid order by case when position <= 30 then 0 else 1 end, case when position <= 30 then -rerank end, position) as final from reranked)
"""
CASES = rf"""
j as (select * from ({twin(JUDGMENTS)}) where eligibility = 'eligible'),
cited as (select qid, 0 as class, j.doc_id, j.source_text_hash from q join (select doc_id, source_text_hash, court_code, year, regexp_extract(citation, '\[[0-9]+\] [A-Z]+ [0-9]+') as own from j) j on contains(q.text || ' ', j.own || ' ') join j p using (doc_id) where q.text like 'See [%' and {PASSES}),
by_name as (select qid, 1 as class, p.doc_id, p.source_text_hash from q join j p on q.text like 'Party%' and starts_with(p.citation, replace(q.text, ' v ', ' v. ') || ' ') where {PASSES}),
named as (select qid, source_text_hash, arg_min(class, class * (1::bigint << 40) + doc_id) as class, arg_min(doc_id, class * (1::bigint << 40) + doc_id) as doc_id from (select * from cited union all select * from by_name) group by all),
exact as (select qid, class, p.chunk_id, p.doc_id, p.source_text_hash, p.content_hash from named join p using (doc_id) qualify row_number() over (partition by qid, doc_id order by p.ordinal) = 1),
every as (select qid, chunk_id, doc_id, source_text_hash, content_hash, 2 as class, final as place, lexical_rank, dense_rank, rrf, rerank from final
  union all select qid, chunk_id, doc_id, source_text_hash, content_hash, class, doc_id, null, null, null, null from exact),
once as (select * from every qualify row_number() over (partition by qid, source_text_hash, content_hash order by class, place) = 1),
best as (select *, min(class * (1::bigint << 40) + place) over (partition by qid, source_text_hash) as best, row_number() over (partition by qid, source_text_hash order by class, place) as in_case from once qualify in_case <= 3),
cased as (select *, dense_rank() over (partition by qid order by best, source_text_hash) as case_rank from best),
t as (select source_text_hash, string_agg(uri, ' ' order by judgment_date is null, judgment_date, uri) as uris from j group by 1)
"""


def channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(questions, indexed passages, lexical, dense). The twins have no stemmer, so words are matched as they stand."""
    questions, held = asked(spark, sf_dir), indexed(spark, sf_dir)
    return questions, held, search.lexical_channel(questions, held, forms=(SIMPLE,)), search.dense_channel(search.bag_vectors(questions, "text"), held, embed=search.bag_matrix)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, held, lexical, dense = channels(spark, sf_dir)
    return search.hybrid(questions, lexical, dense, held)


@query("c11_lexical_channel", f"with {CHANNEL} select qid, chunk_id, score, rank from lexical")
def lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_channel(asked(spark, sf_dir), indexed(spark, sf_dir), forms=(SIMPLE,)).select("qid", "chunk_id", "score", "rank")


@query("c11_english_channel")
def english_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_channel(asked(spark, sf_dir), indexed(spark, sf_dir)).select("qid", "chunk_id", "score", "rank")


#: Phrases, alternatives and exclusions made of the words of each benchmark item.
GRAMMAR = """
select item_id * 10 + k as qid, case k when 0 then '"' || w[3] || ' ' || w[4] || '"' when 1 then w[3] || '-' || w[4] || ' ' || w[6] when 2 then w[3] || ' ' || w[5] || ' or "' || w[6] || ' ' || w[7] || '"'
  when 3 then w[3] || ' ' || w[4] || ' -' || w[9] when 4 then w[3] || ' -"' || w[4] || ' ' || w[5] || '"' when 5 then w[3] || ' OR ' || w[4] || ' -' || w[3] when 6 then '-' || w[3] else 'or "' || w[3] || ' ' || w[3] || '" or' end as text
from (select item_id, {w} as w from {benchmark}), (select {ks} as k)
"""


@query("x02_phrases", f"""with q as ({GRAMMAR.format(w="string_split(text, ' ')", ks='unnest(range(8))', benchmark='benchmark')}),
pw as materialized (select chunk_id, unnest(w) as word, generate_subscripts(w, 1) as place from (select chunk_id, regexp_extract_all(lower(content), '[a-z0-9]+') as w from ({PASSAGES}))),
{LEXICAL} select qid, chunk_id, score from ls""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.concat(F.array(F.lit("")), F.split("text", " ")).alias("w"), F.explode(F.array(*(F.lit(k) for k in range(8)))).alias("k"))
    text = re.sub(r"w\[(\d)\]", r"get(w, \1)", GRAMMAR[GRAMMAR.index("case") : GRAMMAR.index(" as text")])
    asked_items = items.select((F.col("item_id") * 10 + F.col("k")).alias("qid"), F.expr(text).alias("text"))
    return lexical.matching(asked_items, passages(spark, sf_dir), lambda near: near, (lexical.SIMPLE,), keys=table(spark, sf_dir, "documents").select("doc_id"))


@query("c12_dense_channel", f"with {CHANNEL}, {DENSE} select qid, chunk_id, score, rank from dense")
def dense_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_channel(search.bag_vectors(asked(spark, sf_dir), "text"), indexed(spark, sf_dir), embed=search.bag_matrix).select("qid", "chunk_id", "score", "rank")


@query("c13_rrf_fusion", f"with {CHANNEL}, {DENSE}, {FUSED} select qid, chunk_id, lexical_rank, dense_rank, rrf, position from placed")
def fused_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("qid", "chunk_id", "lexical_rank", "dense_rank", "rrf", "position")


@query("c14_rerank", f"with {CHANNEL}, {DENSE}, {FUSED} select qid, chunk_id, rerank, final from final")
def rerank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("qid", "chunk_id", "rerank", "final")


@query("c15_search", f"with {CHANNEL}, {DENSE}, {FUSED}, {CASES} select qid, case_rank, in_case, chunk_id, round(case when class < 2 then 1.0 else coalesce(rerank, rrf) end, 9) as score, case when class = 0 then 'citation' when class = 1 then 'case_name' when lexical_rank is not null and dense_rank is not null then 'hybrid' when lexical_rank is not null then 'lexical' else 'dense' end as channel, uris from cased left join t using (source_text_hash) where case_rank <= 10")
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, held, lexical, dense = channels(spark, sf_dir)
    r = search.search(questions, judgments(spark, sf_dir), held, lexical, dense)
    return r.select("qid", "case_rank", "in_case", "chunk_id", F.round("score", 9).alias("score"), "channel", F.array_join("uris", " ").alias("uris"))


@query("c16_degradation", "with c as (select label as model, count(*) as total, count(*) filter (where vec_id % (label + 1) = 0) as current from embeddings group by label) select model, case when current = 0 then 'lexical' else 'hybrid' end as mode, case when current = 0 then 'no vectors' when current < total then (total - current)::varchar || ' vectors missing' else '' end as reason from c")
def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("model")).agg(F.count("*").alias("total"), F.count_if(F.col("vec_id") % (F.col("label") + 1) == 0).alias("current"))
    none, some = F.col("current") == 0, F.col("current") < F.col("total")
    return c.select("model", F.when(none, "lexical").otherwise("hybrid").alias("mode"), F.when(none, "no vectors").when(some, F.concat((F.col("total") - F.col("current")).cast("string"), F.lit(" vectors missing"))).otherwise("").alias("reason"))


@query("c18_text_twins", f"with j as ({twin(JUDGMENTS)}) select source_text_hash, string_agg(uri, ' ' order by judgment_date is null, judgment_date, uri) as uris from j where eligibility = 'eligible' group by 1")
def twins_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.twins(judgments(spark, sf_dir)).select("source_text_hash", F.array_join("uris", " ").alias("uris"))


@query("c19_passage_context", f"with p as ({PASSAGES}), l as (select p.*, d.lang from p join documents d using (doc_id)) select a.chunk_id as of_chunk, string_agg(b.content, chr(10) order by b.ordinal) as context from l a join p b on a.doc_id = b.doc_id and b.ordinal between a.ordinal - 2 and a.ordinal + 2 group by a.chunk_id")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    n = ranking.neighbours(p, p, 2)
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "content")))
    return n.groupBy("of_chunk").agg(F.array_join(F.transform(listed, lambda x: x["content"]), "\n").alias("context"))


@query("c07_chunking")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.md5("content").alias("content_hash"), "char_start", "char_end", "token_count", "section")


@query("c07_chunk_invariants", "select doc_id, true as exact, true as within, true as dense, len(regexp_extract_all(text, '\\S+')) as tokens from documents where trim(text) <> ''")
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = chunking.chunk_documents(d).join(d.select("doc_id", "text"), "doc_id")
    exact = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("content")
    return c.groupBy("doc_id").agg(F.every(exact).alias("exact"), F.every(F.col("token_count") <= 400).alias("within"), (F.max("ordinal") + 1 == F.count("*")).alias("dense"), F.sum("token_count").alias("tokens"))


@query("c07_page_bounds", f"with p as ({PASSAGES}) select doc_id, min(ordinal) as first_page, max(ordinal) as last_page, true as ordered, true as within from p group by doc_id")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chunking.join_pages(passages(spark, sf_dir).select("doc_id", F.col("ordinal").alias("page"), F.col("content").alias("text")))
    c = chunking.with_page_bounds(chunking.chunk_documents(joined, keep=("page_starts",)))
    starts = F.element_at(F.filter("page_starts", lambda p: p["page"] == F.col("page_start")), 1)["start"]
    return c.groupBy("doc_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), F.every(F.col("page_start") <= F.col("page_end")).alias("ordered"), F.every(starts <= F.col("char_start")).alias("within"))


@query("c07a_headings", "select doc_id, i - 1 as line from (select doc_id, unnest(string_split(text || chr(10) || 'FACTS' || chr(10) || 'II. THE LAW:', chr(10))) as line, generate_subscripts(string_split(text || chr(10) || 'FACTS' || chr(10) || 'II. THE LAW:', chr(10)), 1) as i from documents) where trim(line) in ('FACTS', 'II. THE LAW:')")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\nFACTS\nII. THE LAW:")), "\n")).alias("line", "content"))
    plain = F.trim("content")
    return lines.where((F.length(plain) <= chunking.HEADING_CHARS) & (F.upper(plain) == plain) & plain.rlike(f"^{chunking.HEADING.pattern}$")).select("doc_id", F.col("line").cast("long").alias("line"))


@query("x12_bag_vectors", "with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from benchmark), b as (select item_id, substr(sha256(word), 63, 2) as b, count(*)::double as n from w group by all) select item_id, round(max(n) / sqrt(sum(n * n)), 9) as largest from b group by item_id")
def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = search.bag_vectors(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return made.select("item_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, x)), 9).alias("largest"))


@query("j14_nearest_neighbours", "select q.vec_id as qid, e.vec_id from embeddings q join embeddings e on true where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)), 9) desc, e.vec_id) <= 10")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("source_text_hash"), F.lit("").alias("content_hash"), F.col("embedding").cast("array<double>").alias("vector"))
    q = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "vector")
    return search.dense_channel(q, e, raw=10, limit=10, per_case=1).select("qid", F.col("chunk_id").alias("vec_id"))


def in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth vector against an inverted file of all of them."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return vector_index.nearest(rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), vector_index.build(rows))


@query("j14_ivf_neighbours")
def ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_lists(spark, sf_dir).select("qid", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("j14_ivf_recall", "select count(*) as questions, true as enough from embeddings where vec_id % 20 = 0")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = nearest(spark, sf_dir).select("qid", F.col("vec_id").alias("id"))
    return vector_index.recall_of(in_lists(spark, sf_dir), exact).agg(F.count("*").alias("questions"), (F.avg("recall") >= 0.9).alias("enough"))


#: Weights as a fit on pairs gave them, rounded; fixed, so that SQL can have them too.
WEIGHTS = (-4.0, 3.5, 2.5, 1.5, -0.25)
PAIRED = f"""
heads as (select x.qid, x.chunk_id, x.position, regexp_extract_all(lower(q.text), '[a-z0-9]+') as a, regexp_extract_all(lower(p.content), '[a-z0-9]+') as h from placed x join q using (qid) join p using (chunk_id) where position <= 30),
counted as (select *, list_distinct(a) as wanted, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) as ap, list_distinct(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) as hp from heads),
logits as (select qid, chunk_id, position, {WEIGHTS[0]}::double + {WEIGHTS[1]}::double * coalesce(len(list_intersect(wanted, list_distinct(h)))::double / nullif(len(wanted), 0), 0) + {WEIGHTS[2]}::double * coalesce(len(list_intersect(ap, hp))::double / nullif(len(ap), 0), 0)
  + {WEIGHTS[3]}::double * coalesce(len(list_filter(h, lambda w: list_contains(wanted, w)))::double / nullif(len(h), 0), 0) + {WEIGHTS[4]}::double * ln(1 + len(h)) as z from counted)
"""


@query("c14_pair_scorer", f"with {CHANNEL}, {DENSE}, {FUSED.split('reranked as')[0].rstrip().rstrip(',')}, {PAIRED} select qid, chunk_id, position, round(1 / (1 + exp(-z)), 9) as rerank from logits")
def pair_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, held, lexical_list, dense = channels(spark, sf_dir)
    r = search.hybrid(questions, lexical_list, dense, held, scorer=lambda top: pair_scorer.with_scores(top, WEIGHTS))
    return r.where("rerank is not null").select("qid", "chunk_id", "position", F.round("rerank", 9).alias("rerank"))
