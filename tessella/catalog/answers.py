"""Answers checked against their sources, evaluation of retrieval and answers, and paired comparison."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import evaluation
from ..operators.verification import abstain_reason, check_support, choose_sources, offered, opened, verify_claims
from ..plans import search
from .base import PASSAGES, derived, passages, query, table, twin
from .retrieval import CHANNEL, DENSE, FUSED, channels

#: Claims: assistant turns. Sources: the user turns of the same conversation, labelled S1 and on.
SOURCES = "select conv_id as answer_id, 'S' || cast(row_number() over (partition by conv_id order by turn) as string) as label, text as excerpt, 'Case ' || cast(conv_id as string) || ' [2020] XYSC ' || cast(turn as string) as citation from {conversations} where role = 'user'"
CLAIMS = """
select c.conv_id as answer_id, c.turn as claim_id,
  case c.turn % 4 when 1 then 'It was so held.' when 3 then 'See [2020] XYSC ' || cast(c.turn - 1 as string) || ' again' else 'See [1999] UKHL 4 at length' end as text,
  case when c.conv_id % 6 = 0 then 'S9' else ' [s1] ' end as label,
  case when c.conv_id % 5 = 0 then 'two words' when c.conv_id % 5 = 1 then 'these words are not in it' else substr(u.text, 1, 40) end as quote
from {conversations} c join (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from {conversations} where role = 'user') u on u.conv_id = c.conv_id and u.n = 1
where c.role = 'assistant'
"""
PLAIN = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
EDGE = "regexp_replace(regexp_replace({}, '^[ \"''`.,;:]+', ''), '[ \"''`.,;:]+$', '')"
VERIFIED = f"""
s as ({twin(SOURCES)}), c as ({twin(CLAIMS)}),
v as (select c.answer_id, c.claim_id, c.text, c.label, {EDGE.format(PLAIN.format('quote'))} as q, s.excerpt, s.citation from c left join s on s.answer_id = c.answer_id and s.label = upper(trim(trim(c.label), '[]'))),
r as (select answer_id, claim_id, case when excerpt is null then 0 else 1 end::bigint as n_valid, case when excerpt is null then 1 else 0 end::bigint as n_unknown,
  case when excerpt is null then 'no_valid_source' when q = '' or len(string_split(q, ' ')) < 4 then 'quote_too_short' when not contains({PLAIN.format('excerpt')}, q) then 'quote_not_found'
    when contains(text, '[') and not contains(citation, regexp_extract(text, '\\[[0-9]+\\] [A-Z]+ [0-9]+') ) and not contains({PLAIN.format('excerpt')}, lower(regexp_extract(text, '\\[[0-9]+\\] [A-Z]+ [0-9]+'))) then 'unsupported_reference' end as reason from v)
"""


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = derived(spark, sf_dir, CLAIMS).withColumn("labels", F.array("label"))
    return verify_claims(claims, derived(spark, sf_dir, SOURCES))


@query("c21_verify_claims", f"with {VERIFIED} select answer_id, claim_id, n_valid, n_unknown, reason from r")
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir)


#: Claims of several kinds about the first source: its first line, words of it in another order, with a negation, and others.
STATED = "select a.conv_id as answer_id, a.turn as claim_id, 'S1' as label, case a.turn % 5 when 0 then u.text when 1 then substr(u.text, 1, 60) when 3 then substr(u.text, 20, 50) || ' not ' || substr(u.text, 1, 30) else 'nothing of the kind was decided' end as text from {conversations} a join (select conv_id, text, row_number() over (partition by conv_id order by turn) as n from {conversations} where role = 'user') u on u.conv_id = a.conv_id and u.n = 1"
LONG = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 3))"
SAYS_NOT = "list_has_any(regexp_extract_all(lower({}), '[a-z0-9]+'), ['not', 'no', 'never'])"
NEUTRAL = "len(list_filter(regexp_extract_all(lower({1}), '[a-z0-9]+'), lambda w: length(w) > 3 and not list_contains(regexp_extract_all(lower({0}), '[a-z0-9]+'), w))) > 0"


@query("c22_check_support", f"""with s as ({twin(SOURCES)}), c as ({twin(STATED)}), j as (select c.*, s.excerpt, list_filter(string_split(excerpt, chr(10)), lambda x: trim(x) <> '') as parts from c join s using (answer_id, label)),
w as (select distinct answer_id, claim_id, text, array_to_string(parts[i:i + k - 1], ' ') as run from (select *, unnest(range(1, greatest(len(parts) - k + 1, 1) + 1)) as i from j, (select unnest([1, 2, 3]) as k) where len(parts) > 0)),
b as (select answer_id, claim_id, max(struct_pack(share := case when len({LONG.format('text')}) = 0 then 0.0::double else len(list_intersect({LONG.format('text')}, {LONG.format('run')}))::double / len({LONG.format('text')}) end, entails := not ({NEUTRAL.format('run', 'text')}) and {SAYS_NOT.format('run')} = {SAYS_NOT.format('text')})) as best from w group by all)
select answer_id, claim_id, case when contains({PLAIN.format('excerpt')}, {PLAIN.format('text')}) then 'verbatim' when coalesce(best.share >= 0.8 and best.entails, false) then 'entailed' when not ({NEUTRAL.format('excerpt', 'text')}) and {SAYS_NOT.format('excerpt')} <> {SAYS_NOT.format('text')} then 'contradicted' else 'not_entailed' end as verdict,
  round(case when contains({PLAIN.format('excerpt')}, {PLAIN.format('text')}) then 1.0 else coalesce(best.share, 0.0) end, 9) as score from j left join b using (answer_id, claim_id)""")
def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = derived(spark, sf_dir, SOURCES).withColumn("parts", F.filter(F.split("excerpt", "\n"), lambda x: F.trim(x) != ""))
    return check_support(derived(spark, sf_dir, STATED), sources).withColumn("score", F.round("score", 9))


@query("c23_answer_assembly", f"with {VERIFIED} select answer_id, string_agg(v.text || ' [' || label_no || ']', chr(10) order by claim_id) as answer from (select v.*, substr(upper(trim(trim(label), '[]')), 2) as label_no from v) v join r using (answer_id, claim_id) where reason is null group by answer_id")
def assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = verified(spark, sf_dir).where("reason is null").select("answer_id", "claim_id")
    c = derived(spark, sf_dir, CLAIMS).join(kept, ["answer_id", "claim_id"])
    line = F.concat("text", F.lit(" ["), F.substring(T.labels(F.array("label"))[0], 2, 10), F.lit("]"))
    return c.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))


@query("c24_abstain_reasons", f"with {VERIFIED}, n as (select conv_id as answer_id, count(*) filter (where role = 'user') as results, bool_and(length(text) < 3000) as readable, conv_id % 9 = 4 as abstained from conversations group by conv_id), k as (select answer_id, count(*) filter (where reason is null) as kept from r group by answer_id) select answer_id, case when results < 2 then 'no_results' when not readable then 'invalid_model_output' when abstained then 'model_abstained' when coalesce(kept, 0) = 0 then 'no_supported_claims' end as reason from n left join k using (answer_id)")
def abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("answer_id")).agg(F.count_if(F.col("role") == "user").alias("results"), F.every(F.length("text") < 3000).alias("readable"))
    k = verified(spark, sf_dir).groupBy("answer_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"))
    found = F.when(F.col("results") < 2, 0).otherwise(F.col("results"))
    return n.join(k, "answer_id", "left").select("answer_id", abstain_reason(found, F.col("readable"), F.col("answer_id") % 9 == 4, F.coalesce("kept", F.lit(0))).alias("reason"))


#: What an answer may cite: each line of a conversation's turns, a turn being a case, in order.
OFFERED = "select conv_id as answer_id, turn, place, content, cast(ceil(length(content) / 4.0) as bigint) as cost from lines"


@query("c20_select_sources", f"""with recursive lines as (select conv_id, turn, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as place from conversations),
o as (select *, row_number() over (partition by answer_id order by turn, place) as n from ({OFFERED})),
h as (select distinct answer_id, 0::bigint as n, 0::bigint as used, []::bigint[] as cases, ''::varchar as chosen from o
  union all select o.answer_id, o.n, case when fits then used + cost else used end, case when fits then list_append(cases, o.turn::bigint) else cases end, case when fits then chosen || o.turn::varchar || '.' || o.place::varchar || ' ' else chosen end
  from h join o on o.answer_id = h.answer_id and o.n = h.n + 1, lateral (select len(cases) < 8 and len(list_filter(cases, lambda x: x = o.turn)) < 2 and used + cost <= 400 as fits))
select answer_id, arg_max(chosen, n) as chosen from h group by answer_id""")
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), "turn", F.posexplode(F.split("text", "\n")).alias("place", "content"))
    item = F.struct("turn", (F.col("place") + 1).alias("place"), F.col("turn").alias("case"), F.ceil(F.length("content") / 4.0).cast("long").alias("cost"))
    g = lines.groupBy("answer_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    name = lambda x: F.concat(x["turn"].cast("string"), F.lit("."), x["place"].cast("string"), F.lit(" "))
    return g.select("answer_id", F.array_join(F.transform(choose_sources(F.col("items"), budget=400), name), "").alias("chosen"))


#: Records of an evaluation: a rank, a category and a latency for each order.
RECORDS = "select o_orderkey as id, o_orderpriority as category, case when o_orderkey % 4 = 0 then null else o_custkey % 30 + 1 end as rank, case when o_orderkey % 5 = 0 then null else o_custkey % 25 + 1 end as rank_b, o_orderkey % 10 = 3 as expect_no_answer, o_totalprice as latency, o_orderkey % 3 = 0 as abstained, o_orderkey % 7 as claims, o_orderkey % 2 as removed from {orders}"


@query("a10_retrieval_metrics", f"with r as ({twin(RECORDS)}) select category, count(*) as questions, count(*) filter (where not expect_no_answer) as answerable, avg(case when rank <= 20 then 1.0 else 0.0 end) filter (where not expect_no_answer) as recall, avg(case when rank <= 10 then 1.0 / rank else 0.0 end) filter (where not expect_no_answer) as mrr, any_value(p50) as p50, any_value(p95) as p95 from r join (select category, list_sort(list(latency))[round_even(0.5 * (count(*) - 1), 0)::int + 1] as p50, list_sort(list(latency))[round_even(0.95 * (count(*) - 1), 0)::int + 1] as p95 from r group by category) using (category) group by category")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, RECORDS).withColumn("answerable", ~F.col("expect_no_answer"))
    return evaluation.retrieval_metrics(r, ["category"]).join(evaluation.nearest_rank(r, ["category"], "latency", {"p50": 0.5, "p95": 0.95}), "category")


#: Records of answers: what each conversation cited, claimed and lost.
ANSWERS = "select conv_id, case conv_id % 3 when 0 then 'citation' when 1 then 'name' else 'words' end as category, conv_id % 11 = 3 as expect_no_answer, conv_id % 7 = 5 as abstained, case conv_id % 7 when 5 then 'no_results' when 6 then 'quote_not_found' end as reason, case when conv_id % 4 = 0 then 0 else 1 end as gold_cited, 1 + conv_id % 3 as cited, conv_id % 3 as valid_ids, conv_id % 3 + case when conv_id % 13 = 0 then 1 else 0 end as cited_ids, cast(count(*) as int) as claims, cast(conv_id % 2 as int) as removed, cast(sum(length(text)) as bigint) as words from {conversations} group by conv_id"
RATE = "round(count(*) filter (where {0} and {1})::double / nullif(count(*) filter (where {1}), 0), 4)"


@query("a12_answer_metrics", f"""with r as ({twin(ANSWERS)}) select category, count(*) as questions, {RATE.format('not abstained', 'not expect_no_answer')} as answered_rate, {RATE.format('abstained', 'expect_no_answer')} as abstention_rate,
  {RATE.format('gold_cited > 0', 'not expect_no_answer and not abstained')} as gold_cited_rate, round(sum(gold_cited) filter (where not expect_no_answer and not abstained)::double / nullif(sum(cited) filter (where not expect_no_answer and not abstained), 0), 4) as evidence_precision,
  round(sum(valid_ids)::double / nullif(sum(cited_ids), 0), 4) as id_validity, round(sum(claims)::double / nullif(sum(claims + removed), 0), 4) as support_rate, round(avg(words) filter (where not abstained), 4) as mean_words, round(avg(claims) filter (where not abstained), 4) as mean_claims from r group by category""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.answer_metrics(derived(spark, sf_dir, ANSWERS), ["category"])


@query("c27_answer_reasons", f"with r as ({twin(ANSWERS)}) select category, reason, count(*) as n from r where reason is not null group by all")
def answer_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.removal_reasons(derived(spark, sf_dir, ANSWERS), ["category"])


@query("a13_paired_comparison", f"""with r as ({twin(RECORDS)}), p as (select category, coalesce(rank <= 20, false) as a, coalesce(rank_b <= 20, false) as b, id from r where not expect_no_answer),
n as (select category, count(*) filter (where a and b) as both_found, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b, count(*) filter (where not a and not b) as neither from p group by category)
select *, round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1))) from (select unnest(range(0, (select max(least(only_a, only_b)) + 1 from n))) as k) where k <= least(only_a, only_b)) / pow(2.0, only_a + only_b)) end, 6) as p from n""")
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda c: F.coalesce(F.col(c) <= 20, F.lit(False))
    r = derived(spark, sf_dir, RECORDS).where("not expect_no_answer")
    n = r.groupBy("category").agg(F.count_if(hit("rank") & hit("rank_b")).alias("both_found"), F.count_if(hit("rank") & ~hit("rank_b")).alias("only_a"), F.count_if(hit("rank_b") & ~hit("rank")).alias("only_b"), F.count_if(~hit("rank") & ~hit("rank_b")).alias("neither"))
    return n.withColumn("p", F.round(V.mcnemar(F.col("only_a"), F.col("only_b")), 6))


HIT = "(select qid, min(rank) as rank from ({}) s join gold using (qid, doc_id) group by qid)"


@query("c28_benchmark_sides", f"""with {CHANNEL}, {DENSE}, {FUSED}, gold as (select item_id as qid, doc_id from benchmark b join documents d on contains(d.text, b.text)),
s as (select case qid % 10 when 3 then 'citation' when 7 then 'name' else 'words' end as arm, coalesce(a.rank <= 20, false) as ours, coalesce(b.rank <= 20, false) as theirs from q left join {HIT.format('select qid, doc_id, final as rank from final')} a using (qid) left join {HIT.format('select qid, doc_id, rank from lexical')} b using (qid) where qid in (select qid from gold))
select arm, count(*) as questions, count(*) filter (where ours) as ours, count(*) filter (where theirs) as theirs, count(*) filter (where ours and not theirs) as only_ours, count(*) filter (where theirs and not ours) as only_theirs from s group by arm""")
def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, held, lexical, dense = channels(spark, sf_dir)
    gold = evaluation.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item_id", "qid")
    k = F.col("qid") % 10
    asked = questions.join(gold, "qid", "left_semi").select("qid", F.when(k == 3, "citation").when(k == 7, "name").otherwise("words").alias("arm"))
    ours = search.hybrid(questions, lexical, dense, held).select("qid", "doc_id", F.col("final").alias("rank"))
    return evaluation.paired_sides(asked, "arm", ours, lexical.select("qid", "doc_id", "rank"), gold)


@query("w13_first_hit", "select user_id, min(place) as rank from (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as place from events) where event_type = 'purchase' group by user_id")
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The earliest hit by an aggregate; then only rows before it are counted.
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    first = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("at").alias("first"))
    return e.join(first, "user_id").where(F.col("at") <= F.col("first")).groupBy("user_id").agg(F.count("*").alias("rank"))


@query("c26_evaluate_retrieval", f"""with {CHANNEL}, {DENSE}, {FUSED},
gold as (select item_id as qid, doc_id, b.text from benchmark b join documents d on contains(d.text, b.text)),
shown as (select 'lexical' as config, qid, chunk_id, doc_id, rank from lexical union all select 'dense', qid, chunk_id, doc_id, rank from dense union all select 'hybrid', qid, chunk_id, doc_id, position from placed union all select 'reranked', qid, chunk_id, doc_id, final from final),
asked as (select config, qid, case qid % 10 when 3 then 'citation' when 7 then 'name' else 'words' end as category, qid in (select qid from gold) as answerable from q, (select distinct config from shown)),
hits as (select config, s.qid, min(rank) as rank from shown s join gold g on g.qid = s.qid and g.doc_id = s.doc_id group by all),
parts as (select config, s.qid, min(rank) as passage_rank from shown s join p using (chunk_id) join benchmark b on b.item_id = s.qid where rank <= 20 and (contains(p.content, b.text) or contains(b.text, p.content)) group by all)
select config, category, count(*) as questions, count(*) filter (where answerable) as answerable, avg(case when rank <= 20 then 1.0 else 0.0 end) filter (where answerable) as recall,
  avg(case when rank <= 10 then 1.0 / rank else 0.0 end) filter (where answerable) as mrr, avg(case when passage_rank <= 20 then 1.0 else 0.0 end) filter (where answerable) as passage_recall
from asked left join hits using (config, qid) left join parts using (config, qid) group by all""")
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, held, lexical, dense = channels(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark")
    gold = evaluation.containing(table(spark, sf_dir, "documents"), items).withColumnRenamed("item_id", "qid")
    fused = search.hybrid(questions, lexical, dense, held)
    lists = {"lexical": (lexical, "rank"), "dense": (dense, "rank"), "hybrid": (fused, "position"), "reranked": (fused, "final")}
    ranked = [f.select(F.lit(name).alias("config"), "qid", "chunk_id", "doc_id", F.col(place).alias("rank")) for name, (f, place) in lists.items()]
    k = F.col("qid") % 10
    asked = questions.select("qid", F.when(k == 3, "citation").when(k == 7, "name").otherwise("words").alias("category"))
    records = evaluation.retrieval_records(asked, reduce(DataFrame.unionByName, ranked), gold, held, items.select(F.col("item_id").alias("qid"), "text"))
    return evaluation.retrieval_metrics(records, ["config", "category"])


@query("r10_models_used", "select event_type, string_agg(distinct 'm' || (user_id % 4)::varchar, ',' order by 'm' || (user_id % 4)::varchar) as models from events group by event_type")
def models_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")))), ",").alias("models"))


#: Passages of a source are the lines of a user's turn; a claim quotes one of the first source's and has a marker, or none.
MARKED = "select conv_id, turn, case when turn % 4 > 0 then turn % 4 end as marker, turn % 2 as nth from {conversations} where role = 'assistant'"


@query("b04_claim_source", f"""with s as (select conv_id, row_number() over (partition by conv_id order by turn) as number, list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: turn * 1000 + i) as passages from conversations where role = 'user'),
q as (select c.*, coalesce(f.passages[1 + nth], f.passages[1]) as quote, s.passages from ({twin(MARKED)}) c join s f on f.conv_id = c.conv_id and f.number = 1 left join s on s.conv_id = c.conv_id and s.number = c.marker)
select conv_id, turn, case when marked then quote else passages[1] end as chunk_id, marked from (select *, marker is null or passages is null or list_contains(passages, quote) as marked from q)""")
def claim_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    chunks = F.transform(F.split("text", "\n"), lambda _, i: F.col("turn") * 1000 + i + 1)
    s = users.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("number"), chunks.alias("passages"))
    quoted = s.where("number = 1").select("conv_id", F.col("passages").alias("own"))
    c = derived(spark, sf_dir, MARKED).join(quoted, "conv_id").withColumn("quote", F.coalesce(F.get("own", F.col("nth").cast("int")), F.get("own", F.lit(0))))
    j = c.join(s.withColumnRenamed("number", "marker"), ["conv_id", "marker"], "left")
    return j.select("conv_id", "turn", opened(F.col("quote"), F.col("marker"), F.col("passages")).alias("x")).select("conv_id", "turn", "x.*")


@query("c20_named_case", f"""with recursive lines as (select conv_id as answer_id, turn, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as place, len(string_split(text, chr(10))) as held, turn = min(turn) over (partition by conv_id) and conv_id % 3 = 0 as named from conversations),
o as (select answer_id, turn, place, cast(ceil(length(content) / 4.0) as bigint) as cost, row_number() over (partition by answer_id order by turn, place) as n from lines where case when named then place = 1 or place > held - 2 else place <= 2 end),
h as (select distinct answer_id, 0::bigint as n, 0::bigint as used, 0::bigint as taken, ''::varchar as chosen from o
  union all select o.answer_id, o.n, case when fits then used + cost else used end, case when fits then taken + 1 else taken end, case when fits then chosen || o.turn::varchar || '.' || o.place::varchar || ' ' else chosen end
  from h join o on o.answer_id = h.answer_id and o.n = h.n + 1, lateral (select taken < 8 and used + cost <= 400 as fits))
select answer_id, arg_max(chosen, n) as chosen from h group by answer_id""")
def named_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    passages = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.col("turn").alias("turn"), (i + 1).alias("place"), F.col("turn").alias("case"), F.ceil(F.length(x) / 4.0).cast("long").alias("cost")))
    g = c.groupBy(F.col("conv_id").alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("turn", passages.alias("passages")))).alias("cases"))
    listed = offered(F.col("cases"), named=F.col("answer_id") % 3 == 0)
    name = lambda x: F.concat(x["turn"].cast("string"), F.lit("."), x["place"].cast("string"), F.lit(" "))
    return g.select("answer_id", F.array_join(F.transform(choose_sources(listed, per_case=1 << 30, budget=400), name), "").alias("chosen"))


#: What a run was made with: the settings that ranking depends on.
SETTINGS = {
    "chunk_most": 400, "chunk_target": 250, "dense_raw": search.RAW, "dimension": search.DIMENSION, "forms": "simple", "head": search.RERANK, "model": "hashed words", "per_case": search.PER_CASE, "pool": search.POOL, "rrf_k": 60, "scorer": "overlap",
}


@query("c30_run_settings", f"""with p as (select count(*)::varchar as n, sum(('0x' || substr(md5(doc_id::varchar || chr(31) || content_hash), 1, 15))::bigint::hugeint)::varchar as d from ({PASSAGES}) where true),
x as (select '{{"corpus":{{"digest":"' || d || '","passages":' || n || '}},"settings":{json.dumps(SETTINGS, sort_keys=True, separators=(",", ":"))}}}' as config from p)
select config, sha256(config) as config_hash from x""")
def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_config(passages(spark, sf_dir), SETTINGS)


@query("s26_run_parts", f"""with r as ({twin(RECORDS)})
select 'question' as part, id::varchar as key, '{{"category":"' || category || '"' || case when rank is null then '' else ',"rank":' || rank::varchar end || '}}' as value from r
union all select 'metrics', category, '{{"found":' || count(rank)::varchar || ',"in_top_5":' || count(*) filter (where rank <= 5)::varchar || ',"questions":' || count(*)::varchar || '}}' from r group by category
union all select 'config', 'settings', '{json.dumps(SETTINGS, sort_keys=True, separators=(",", ":"))}'""")
def run_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, RECORDS)
    metrics = r.groupBy("category").agg(F.count("rank").alias("found"), F.count_if(F.col("rank") <= 5).alias("in_top_5"), F.count("*").alias("questions"))
    return evaluation.run_record("a run", SETTINGS, metrics, "category", r.select("id", "category", "rank"), "id").drop("run_id")
