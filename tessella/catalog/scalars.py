"""Scalar functions over values that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import fuzzy
from .base import JUDGMENTS, RAW_VALUES, derived, judgments, query, table, twin

J = f"with j as ({twin(JUDGMENTS)})"


@query("n01_clean_value", f"with r as ({twin(RAW_VALUES)}) select doc_id, case when lower(trim(value)) in ('', 'n/a', 'na', 'nan', 'none', 'null') then null else regexp_replace(value, '^\\s+|\\s+$', '', 'g') end as clean, contains(value, chr(0)) as had_nul from r")
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, RAW_VALUES)
    return r.select("doc_id", T.clean_value(F.col("value")).alias("clean"), T.has_nul(F.col("value")).alias("had_nul"))


@query("n02_collapse_whitespace", "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as collapsed from documents")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"))


@query("n03_strip_copy_suffix", f"{J} select doc_id, nullif(trim(regexp_replace(citation, '\\s*Copy\\s*$', '')), '') as citation from j")
def copy_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.without_copy_label(F.col("citation")).alias("citation"))


@query("n04_normalize_citation", f"{J} select doc_id, trim(regexp_replace(regexp_replace(upper(citation), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as normal from j")
def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.normal_citation(F.col("citation")).alias("normal"))


@query("n05_neutral_citation", f"{J} select doc_id, regexp_extract(citation, '\\[(\\d{{4}})\\]\\s+([A-Za-z][A-Za-z0-9]*)\\s+(\\d+)', 1)::int as year, regexp_extract(citation, '\\[(\\d{{4}})\\]\\s+([A-Za-z][A-Za-z0-9]*)\\s+(\\d+)', 2) as court, regexp_extract(citation, '\\[(\\d{{4}})\\]\\s+([A-Za-z][A-Za-z0-9]*)\\s+(\\d+)', 3)::bigint as number from j")
def neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.neutral_citation(F.col("citation")).alias("c")).select("doc_id", "c.year", "c.court", "c.number")


@query("n06_derive_title", f"{J} select doc_id, trim(split_part(split_part(citation, ' [', 1), ' (', 1)) as title from j")
def title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.title_of(F.col("citation")).alias("title"))


CASE_NUMBERS = "select doc_id, 'A' || cast(doc_id as string) || '  /20;  ' || case when doc_id % 2 = 0 then ' ;' else '' end || ' B  ' || cast(doc_id % 9 as string) as value from {documents}"


@query("n07_case_number", f"with r as ({twin(CASE_NUMBERS)}) select doc_id, array_to_string(list_filter(list_transform(string_split(value, ';'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''), '; ') as case_number from r")
def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CASE_NUMBERS).select("doc_id", T.case_number(F.col("value")).alias("case_number"))


@query("n08_split_judges", """
with x as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(trim(regexp_replace(l, '\\s+', ' ', 'g')), '[,;]+$', ''))), lambda n: n <> '') as names from documents)
select doc_id, len(names) as n, array_to_string(names, '|') as judges from x""")
def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", T.judges_of(F.col("text")).alias("names"))
    return r.select("doc_id", F.size("names").cast("long").alias("n"), F.array_join("names", "|").alias("judges"))


URLS = "select doc_id, 'https://example.org' || uri || case when doc_id % 4 = 0 then '/' when doc_id % 4 = 1 then '?x=1' when doc_id % 4 = 2 then '-bad' else '' end as url from ({judgments})".replace("{judgments}", JUDGMENTS)
PATH = "^/akn/([a-z0-9-]+)/judgment/([a-z0-9-]+)/(\\d{4})/([A-Za-z0-9-]+)/([a-z]{3})@(\\d{4}-\\d{2}-\\d{2})/?$"


@query("n09_parse_uri", f"""with u as (select doc_id, regexp_replace(replace(url, 'https://example.org', ''), '[?#].*$', '') as path from ({twin(URLS)}))
select doc_id, case when ok then rtrim(path, '/') end as uri, case when ok then regexp_extract(path, '{PATH}', 1) end as jurisdiction, case when ok then regexp_extract(path, '{PATH}', 3)::int end as year,
  case when ok then regexp_extract(path, '{PATH}', 4) end as number, case when ok then regexp_extract(path, '{PATH}', 6) end as day
from (select *, regexp_matches(path, '{PATH}') and try_cast(nullif(regexp_extract(path, '{PATH}', 6), '') as date) is not null as ok from u)""")
def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, URLS).select("doc_id", T.judgment_path(F.col("url")).alias("p"))
    return r.select("doc_id", "p.uri", "p.jurisdiction", "p.year", "p.number", F.col("p.day").cast("string").alias("day"))


QUERIES_TYPED = "select doc_id, case doc_id % 4 when 0 then citation when 1 then '2020 XYSC ' || cast(doc_id as string) when 2 then 'Party' || cast(doc_id % 37 as string) || '  vs Other  Thing' else substr(text, 1, 40) end as typed from ({judgments})".replace("{judgments}", JUDGMENTS)


@query("n10_detect_citation", f"""select doc_id, coalesce(nullif(regexp_extract(typed, '\\[(\\d{{4}})\\]\\s+([A-Za-z][A-Za-z0-9]*)\\s+(\\d+)', 2), ''), nullif(regexp_extract(typed, '\\b(\\d{{4}})\\s+([A-Z][A-Za-z]*[A-Z][A-Za-z]*)\\s+(\\d+)\\b', 2), '')) as court from ({twin(QUERIES_TYPED)})""")
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, QUERIES_TYPED).select("doc_id", T.detect_citation(F.col("typed"))["court"].alias("court"))


@query("n11_parse_query", f"""select doc_id, q as text, regexp_matches(q, '\\[\\d{{4}}\\]\\s+[A-Za-z][A-Za-z0-9]*\\s+\\d+') or regexp_matches(q, '\\b\\d{{4}}\\s+[A-Z][A-Za-z]*[A-Z][A-Za-z]*\\s+\\d+\\b') as has_citation, regexp_matches(q, '(?i)\\S\\s+(?:v|vs|vrs|versus)\\.?\\s+\\S') as case_name
from (select doc_id, trim(regexp_replace(typed, '\\s+', ' ', 'g')) as q from ({twin(QUERIES_TYPED)}))""")
def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, QUERIES_TYPED).select("doc_id", T.collapse(F.col("typed")).alias("text"))
    return r.select("doc_id", "text", T.detect_citation(F.col("text")).isNotNull().alias("has_citation"), T.looks_like_case_name(F.col("text")).alias("case_name"))


STOP = "['AND','ANOR','ANR','ORS','OTHERS','ANOTHER','THE','OF','EX','PARTE','FOR','IN','ON','AT','BY']"


@query("n12_party_words", f"""with s as (select doc_id, unnest(regexp_split_to_array(' ' || citation || ' ', '(?i)\\s(?:v|vs|vrs|versus)\\.?\\s')) as side, generate_subscripts(regexp_split_to_array(' ' || citation || ' ', '(?i)\\s(?:v|vs|vrs|versus)\\.?\\s'), 1) as i from ({twin(JUDGMENTS)})),
w as (select doc_id, i, list_sort(list_distinct(list_filter(regexp_extract_all(upper(side), '[A-Z0-9]{{3,}}'), lambda x: not list_contains({STOP}, x)))) as words from s)
select doc_id, string_agg(array_to_string(words, ' '), '|' order by i) as parties from w where len(words) > 0 group by doc_id""")
def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judgments(spark, sf_dir).select("doc_id", T.party_words(F.col("citation")).alias("sides"))
    return r.select("doc_id", F.array_join(F.transform("sides", lambda s: F.array_join(s, " ")), "|").alias("parties"))


@query("f05_names_every_party", f"{J} select doc_id, regexp_matches(n, '(^| )(PARTY3|PARTY5)( |$)') and regexp_matches(n, '(^| )OTHER7( |$)') as named from (select doc_id, trim(regexp_replace(regexp_replace(upper(citation), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as n from j)")
def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.names_every_party(T.party_words(F.lit("Party3 and Party5 v Other7")), F.col("citation")).alias("named"))


@query("f14_escape_like", "select p_partkey, replace(replace(replace(p_name || '_%', chr(92), chr(92) || chr(92)), '%', chr(92) || '%'), '_', chr(92) || '_') as escaped from part")
def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_like(F.concat("p_name", F.lit("_%"))).alias("escaped"))


@query("n13_normalise_text", "select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as normal from documents")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_text(F.col("text")).alias("normal"))


@query("n13_folded_text", "select doc_id, lower(trim(regexp_replace(replace(replace(lower('Ｆｕｌｌ ﬁne ' || text), 'ß', 'ss'), lower('Ｆｕｌｌ ﬁne'), 'full fine'), '\\s+', ' ', 'g'))) as normal from documents")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_text(F.concat(F.lit("Ｆｕｌｌ ﬁne "), "text")).alias("normal"))


QUOTED = "select a.doc_id, substr(a.text, 5, 30) || ' ... ' || substr(a.text, 60 + case when a.doc_id % 3 = 0 then 0 else 10 end, 20) as quote, a.text as passage from {documents} a"
NORMAL = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
PART = "regexp_replace(regexp_replace({}, '^[ \"''`.,;:]+', ''), '[ \"''`.,;:]+$', '')"


@query("n14_quote_in", f"""with q as (select doc_id, {NORMAL.format('passage')} as p, list_filter(list_transform(regexp_split_to_array(quote, '\\s*(?:\\.\\s*){{3,}}\\s*|\\s*…\\s*'), lambda x: {PART.format(NORMAL.format('x'))}), lambda x: x <> '') as parts from ({twin(QUOTED)}))
select doc_id, len(parts) = 0 or regexp_matches(p, array_to_string(list_transform(parts, lambda x: regexp_escape(x)), '.*'), 's') as found, coalesce(list_sum(list_transform(parts, lambda x: len(string_split(x, ' ')))), 0)::int as words from q""")
def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, QUOTED).select("doc_id", T.quote_in(F.col("quote"), F.col("passage")).alias("found"), T.quote_words(F.col("quote")).alias("words"))


CLAIMS = "select doc_id, 'It was held in ' || case doc_id % 3 when 0 then '[2020] XYSC 7' when 1 then '[' || cast(1990 + doc_id % 30 as string) || '] ' || upper(court_code) || 'SC ' || cast(doc_id as string) else 'court' end || case when doc_id % 5 = 0 then ' at page 12' else '' end as claim, citation, text from ({judgments})".replace("{judgments}", JUDGMENTS)


@query("n17_references_supported", f"""select doc_id, not regexp_matches(claim, '(?i)\\b(?:pages?|pgs?|pp?)(?:\\.\\s*|\\s+)\\d+') and (c = '' or contains(citation, c) or contains(lower(text), lower(c))) as supported
from (select *, regexp_extract(claim, '\\[\\s*\\d{{4}}\\s*\\]\\s*[A-Za-z]+\\s*\\d+') as c from ({twin(CLAIMS)}))""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived(spark, sf_dir, CLAIMS)
    return r.select("doc_id", T.references_supported(F.col("claim"), F.array(T.neutral_citation(F.col("citation"))), F.col("text")).alias("supported"))


@query("n18_resolve_labels", "with x as (select event_id, list_transform(['[s' || (event_id % 4)::varchar || ']', ' S' || (event_id % 3)::varchar || ' ', event_type], lambda l: upper(trim(trim(l), '[]'))) as l from events) select event_id, array_to_string(list_filter([l[1], case when l[2] <> l[1] then l[2] end, l[3]], lambda v: v is not null and v in ('S0', 'S1', 'S2')), ',') as known, len(list_filter(l, lambda v: v not in ('S0', 'S1', 'S2'))) as unknown from x")
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.array(F.concat(F.lit("[s"), (F.col("event_id") % 4).cast("string"), F.lit("]")), F.concat(F.lit(" S"), (F.col("event_id") % 3).cast("string"), F.lit(" ")), F.col("event_type"))
    sources = F.array(*map(F.lit, ("S0", "S1", "S2")))
    x = e.select("event_id", T.labels(raw).alias("l"))
    return x.select("event_id", F.array_join(F.array_intersect("l", sources), ",").alias("known"), F.size(F.array_except("l", sources)).cast("long").alias("unknown"))


@query("n19_source_envelope", f"""{J} select doc_id, '<source id="S1" citation="' || replace(replace(replace(citation, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '">' || chr(10) || regexp_replace(text || ' </source> < SOURCE', '(?i)<(/?)\\s*source', '&lt;\\1source', 'g') || chr(10) || '</source>' as block from j""")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.envelope(F.lit("S1"), F.col("citation"), F.concat("text", F.lit(" </source> < SOURCE"))).alias("block"))


PAGED = "select l_orderkey, l_linenumber, l_linenumber as first_page, l_linenumber + l_orderkey % 2 as last_page, case when l_returnflag = 'R' then 'unverified' else 'verified' end as status from {lineitem}"


@query("n20_page_label", f"select l_orderkey, l_linenumber, case when status = 'verified' then case when first_page = last_page then 'p. ' || (first_page + 1)::varchar else 'pp. ' || (first_page + 1)::varchar || '-' || (last_page + 1)::varchar end end as label from ({twin(PAGED)})")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAGED).select("l_orderkey", "l_linenumber", T.page_label(F.col("first_page"), F.col("last_page"), F.col("status")).alias("label"))


@query("n21_describe_filters", f"{J} select doc_id, array_to_string(list_filter(['court ' || court_code, case when doc_id % 2 = 0 then 'jurisdiction ' || jurisdiction end, 'from ' || year(judgment_date)::varchar], lambda x: x is not null), '; ') as described from j")
def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array_compact(F.array(F.concat(F.lit("court "), "court_code"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("jurisdiction "), "jurisdiction")), F.concat(F.lit("from "), F.year("judgment_date").cast("string"))))
    return judgments(spark, sf_dir).select("doc_id", F.array_join(c, "; ").alias("described"))


@query("n22_url_path", "select page_id, rtrim(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/') as path from pages")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_path(F.col("url")).alias("path"))


FLAWED = "select doc_id, case doc_id % 6 when 0 then '  ' when 1 then text || '��' when 2 then '�' || substr(text, 1, 20) when 3 then 'â€' || text when 4 then 'Summary\n\nDownload PDF\nThis document is 1.2 MB. Do you want to load it?' else text end as text from {documents}"


@query("n23_text_quality", f"""select doc_id, case when t = '' then 'empty' else array_to_string(list_filter([case when len(regexp_extract_all(t, '�')) > 0.01 * length(t) then 'replacement_characters' end, case when contains(t, 'â€') or regexp_matches(t, 'Â([\\s\\x{{00a0}}-\\x{{00bf}}]|$)') then 'mojibake' end,
  case when starts_with(t, 'Summary' || chr(10)) and contains(t, 'Do you want to load it?') then 'viewer_boilerplate' end], lambda x: x is not null), ',') end as flags from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from ({twin(FLAWED)}))""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FLAWED).select("doc_id", F.array_join(T.quality_flags(F.col("text")), ",").alias("flags"))


MENUS = "select doc_id, case doc_id % 3 when 0 then 'Summary\n\n  Pages\n' || text when 1 then text else 'Search' end as text from {documents}"


@query("n24_strip_navigation", f"select doc_id, case doc_id % 3 when 0 then regexp_replace(substr(text, 18), '^\\s+|\\s+$', '', 'g') when 1 then text else '' end as body from ({twin(MENUS)})")
def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MENUS).select("doc_id", T.without_navigation(F.col("text")).alias("body"))


@query("n25_context_prefix", f"{J} select doc_id, array_to_string(list_filter([array_to_string(list_filter([citation, court_name, year(judgment_date)::varchar], lambda x: x is not null), ' | '), case when doc_id % 2 = 0 then 'FACTS' end], lambda x: x is not null), chr(10)) as prefix from j")
def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", T.context_prefix(F.col("citation"), F.col("court_name"), F.col("judgment_date"), F.when(F.col("doc_id") % 2 == 0, "FACTS")).alias("prefix"))


@query("x05_tokens", "select doc_id, len(t) as n, array_to_string(t, ' ') as words from (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) as t from documents)")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.tokens(F.col("text"))).alias("t"))
    return r.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("words"))


@query("x06_squash", "select doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as squashed from documents")
def squashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squash(F.col("text")).alias("squashed"))


@query("x07_char_grams", "select p_partkey, len(list_distinct(list_transform(range(1, greatest(length(p_name || p_type) - 18, 1)), lambda i: substr(p_name || p_type, i, 20)))) as n from part")
def grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(T.char_grams(F.concat("p_name", "p_type"))).cast("long").alias("n"))


@query("x08_containment", """with t as (select o.doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, length(text) // 2)), '[a-z0-9]{3,}')) as a, list_distinct(regexp_extract_all(lower(substr(text, length(text) // 2 + 1)), '[a-z0-9]{3,}')) as b from documents o)
select doc_id, case when len(a) = 0 then 0.0::double else len(list_filter(a, lambda x: list_contains(b, x)))::double / len(a) end as share from t""")
def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.containment(T.tokens(F.expr("substring(text, 1, length(text) div 2)")), T.tokens(F.expr("substring(text, length(text) div 2 + 1)"))).alias("share"))


@query("x13_containment_nli", """with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as p, regexp_extract_all(lower(substr(text, 20) || case when doc_id % 3 = 0 then ' not' else '' end), '[a-z0-9]+') as c from documents)
select doc_id, case when len(list_filter(c, lambda w: length(w) > 3 and not list_contains(p, w))) > 0 then 'neutral' when list_has_any(p, ['not', 'no', 'never']) <> list_has_any(c, ['not', 'no', 'never']) then 'contradiction' else 'entailment' end as verdict from t""")
def nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    claim = F.concat(F.expr("substring(text, 20)"), F.when(F.col("doc_id") % 3 == 0, " not").otherwise(""))
    return d.select("doc_id", T.entails(F.col("text"), claim).alias("verdict"))


@query("x14_highlight", "select item_id, regexp_replace(text, '(?i)\\b(there|the|of)', '«\\1»', 'g') as marked from benchmark")
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.highlight(F.col("text"), ["of", "the", "there"]).alias("marked"))


#: Names that are asked for, each with a letter too few, and the names that may be meant.
ASKED_NAMES = "select distinct left(p_name, length(p_name) - 1) as asked from {part}"
HELD_NAMES = "select p_partkey, p_name || ' of ' || p_brand as held from {part}"
GRAMS = "list_distinct(flatten(list_transform(list_transform({}, lambda w: '  ' || w || ' '), lambda w: list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))))"
WORDS_OF = "regexp_extract_all(lower({}), '[a-z0-9]+')"
EXTENTS = f"""q as (select asked, {GRAMS.format(WORDS_OF.format('asked'))} as a from ({twin(ASKED_NAMES)})), h as (select p_partkey, {WORDS_OF.format('held')} as w from ({twin(HELD_NAMES)})),
e as (select p_partkey, {GRAMS.format('w[i:j]')} as g from (select p_partkey, w, unnest(range(1, len(w) + 1)) as i from h), lateral (select unnest(range(i, len(w) + 1)) as j)),
s as (select asked, p_partkey, round(max(len(list_intersect(a, g))::double / len(list_distinct(list_concat(a, g)))), 9) as similarity from q, e group by all)"""


@query("x03_word_similarity", f"with {EXTENTS} select asked, p_partkey, similarity from s where similarity > 0")
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Keys of the same names are compared once and joined back; a repeated key counts once, by the best of its names.
    parts = derived(spark, sf_dir, HELD_NAMES).groupBy("p_partkey").agg(F.array_sort(F.collect_set("held")).alias("names"))
    held = parts.select("names").distinct().select("names", F.explode("names").alias("held"))
    near = fuzzy.similar_names(derived(spark, sf_dir, ASKED_NAMES), "asked", held, "held", 1e-9)
    best = near.groupBy("asked", "names").agg(F.round(F.max("similarity"), 9).alias("similarity"))
    # By a merge, as Parquet's size makes all parts look small enough for a broadcast.
    return parts.join(best.hint("merge"), "names").select("asked", "p_partkey", "similarity")


@query("j13_fuzzy_join", f"with {EXTENTS} select asked, p_partkey, similarity from s where similarity >= 0.6")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.similar_names(derived(spark, sf_dir, ASKED_NAMES), "asked", derived(spark, sf_dir, HELD_NAMES), "held", 0.6).select("asked", "p_partkey", F.round("similarity", 9).alias("similarity"))


@query("x04_cosine", "with q as (select embedding as e from embeddings where vec_id = 0) select vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda p: p[1]::double * p[2]::double)), 6) as similarity from embeddings, q")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    # One row however many have the key: an aggregate without keys.
    q = v.where("vec_id = 0").agg(F.first("embedding").alias("e"))
    return v.join(F.broadcast(q)).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("e")), 6).alias("similarity"))


@query("h01_sha256_text", "select doc_id, sha256(text) as digest from documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.sha256_text(F.col("text")).alias("digest"))


@query("h03_stable_hash", f"{J} select doc_id, sha256(doc_id::varchar || chr(31) || coalesce(judgment_date::varchar, '∅') || chr(31) || citation) as digest from j")
def stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", V.stable_hash(F.col("doc_id"), F.col("judgment_date"), F.col("citation")).alias("digest"))


ASCII = "array_to_string(list_transform(string_split({}, ''), lambda c: case when c = '' or unicode(c) < 128 then c else '\\u' || lpad(lower(hex(unicode(c))), 4, '0') end), '')"


@query("h03_json_hash", f"select doc_id, sha256({ASCII.format(chr(39) + '{' + chr(34) + 'lang' + chr(34) + ':' + chr(39) + ' || to_json(lang) || ' + chr(39) + ',' + chr(34) + 'size' + chr(34) + ':' + chr(39) + ' || n_chars::varchar || ' + chr(39) + ',' + chr(34) + 'text' + chr(34) + ':' + chr(39) + ' || to_json(text) || ' + chr(39) + '}' + chr(39))}) as digest from documents")
def json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.stable_json_hash({"text": F.col("text"), "lang": F.col("lang"), "size": F.col("n_chars")}).alias("digest"))


@query("h04_stable_id", """with d as (select doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || (doc_id::varchar || chr(31) || lang)::blob) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from d""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.stable_id(F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@query("h05_context_hash", f"{J} select doc_id, md5(citation || chr(31) || court_name || chr(31) || coalesce(year(judgment_date)::varchar, '')) as digest from j")
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judgments(spark, sf_dir).select("doc_id", V.context_hash(F.col("citation"), F.col("court_name"), F.col("judgment_date")).alias("digest"))


@query("h08_json_fields", "select event_id, json_extract_string(props, '$.page') as page, len(json_keys(props)) as n_keys from events")
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("h09_filters_json", f"""{J} select doc_id, '{{' || array_to_string(list_filter(['"court":"' || court_code || '"', case when doc_id % 2 = 0 then '"jurisdiction":"' || jurisdiction || '"' end, '"year_from":' || year(judgment_date)::varchar], lambda x: x is not null), ',') || '}}' as filters from j""")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.struct(F.col("court_code").alias("court"), F.when(F.col("doc_id") % 2 == 0, F.col("jurisdiction")).alias("jurisdiction"), F.year("judgment_date").alias("year_from"))
    return judgments(spark, sf_dir).select("doc_id", F.to_json(f).alias("filters"))


@query("h10_date_parts", "select event_id, make_date(year(ts), 1, 1)::date::varchar as year_start, date_trunc('day', ts)::date::varchar as day, ts - interval 15 minute as before from events")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.make_date(F.year("ts"), F.lit(1), F.lit(1)).cast("string").alias("year_start"), F.to_date("ts").cast("string").alias("day"), F.expr("ts - interval 15 minutes").alias("before"))


DATED = "select doc_id, case doc_id % 4 when 0 then '17 June ' || cast(1950 + doc_id % 50 as string) when 1 then '1963-0' || cast(1 + doc_id % 9 as string) || '-17' when 2 then 'June 1963' else '31 February 2001' end as value from {documents}"


@query("h11_judgment_date", f"select doc_id, case doc_id % 4 when 0 then make_date(1950 + (doc_id % 50)::int, 6, 17)::date::varchar when 1 then value end as day from (select doc_id, case when doc_id % 4 = 1 then value else '2000-01-01' end as value from ({twin(DATED)}))")
def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DATED).select("doc_id", T.judgment_date(F.col("value")).cast("string").alias("day"))


@query("h12_rrf_terms", "select l_orderkey, l_linenumber, 1.0::double / (60 + l_linenumber) as rrf, case when l_linenumber <= 10 then 1.0::double / l_linenumber else 0 end as reciprocal from lineitem")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.rrf_term(n).alias("rrf"), F.when(n <= 10, 1.0 / n).otherwise(0.0).alias("reciprocal"))


@query("h13_softmax", "select o_orderkey, round(exp(a - greatest(a, b, c)) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 9) as first, case greatest(a, b, c) when a then 'a' when b then 'b' else 'c' end as label from (select o_orderkey, o_totalprice / 1e5 as a, (o_orderkey % 7)::double as b, (o_custkey % 5)::double as c from orders)")
def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 1e5, (F.col("o_orderkey") % 7).cast("double"), (F.col("o_custkey") % 5).cast("double")).alias("l"))
    label = F.element_at(F.array(*map(F.lit, "abc")), F.array_position("l", F.array_max("l")).cast("int"))
    return o.select("o_orderkey", F.round(V.softmax(F.col("l"))[0], 9).alias("first"), label.alias("label"))


@query("h14_costs", "select doc_id, floor(length(text) / 3.5)::int + 40 as tokens, (round(greatest(length(text) - doc_id % 100, 0) * 0.10 + (doc_id % 100) * 0.01 + 120 * 0.50, 0) / 1000000)::decimal(10,6)::double as usd from documents")
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    usd = V.estimate_usd(F.length("text"), F.col("doc_id") % 100, F.lit(120), ("0.10", "0.01", "0.50"))
    return d.select("doc_id", V.estimate_tokens(F.col("text")).alias("tokens"), usd.cast("double").alias("usd"))


@query("h17_password_rules", "select c_custkey, length(c_name) >= 12 as long_enough, len(list_distinct(string_split(c_name, ''))) >= 4 as varied, lower(c_name) <> lower(c_mktsegment) as not_the_name from customer")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.length("c_name") >= 12).alias("long_enough"), (F.size(F.array_distinct(F.filter(F.split("c_name", ""), lambda x: x != ""))) >= 4).alias("varied"), (F.lower("c_name") != F.lower("c_mktsegment")).alias("not_the_name"))


@query("x01_simple_lexemes", "with w as (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as word, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1) as i from benchmark) select item_id, word, count(*) as n, string_agg(i::varchar, ',' order by i) as places from w group by all")
def lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.simple_words(F.col("text"))).alias("at", "word"))
    places = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("at") + 1)), lambda x: x.cast("string")), ",")
    return w.groupBy("item_id", "word").agg(F.count("*").alias("n"), places.alias("places"))
