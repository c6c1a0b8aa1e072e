"""Columns that clean, parse and compare texts. All are native expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
MISSING = ("", "n/a", "na", "nan", "none", "null")
PARTY_STOPWORDS = ("AND", "ANOR", "ANR", "ORS", "OTHERS", "ANOTHER", "THE", "OF", "EX", "PARTE", "FOR", "IN", "ON", "AT", "BY")
NAVIGATION = ("Skip to document content", "Summary", "Table of contents", "Pages", "Search")
VIEWER = ("Loading PDF...", "Load document", "Error loading PDF", "Try reloading the page or downloading the PDF.", "Reload page", "Download PDF", "Error:")
VIEWER_PROMPT = r"^This document is [\d.,]+\s*[KMG]?B\. Do you want to load it\?$"
NEUTRAL_CITATION = r"\[(\d{4})\]\s+([A-Za-z][A-Za-z0-9]*)\s+(\d+)"
BARE_CITATION = r"\b(\d{4})\s+([A-Z][A-Za-z]*[A-Z][A-Za-z]*)\s+(\d+)\b"
CASE_NAME = r"(?i)\S\s+(?:v|vs|vrs|versus)\.?\s+\S"
PARTY_SEPARATOR = r"(?i)\s(?:v|vs|vrs|versus)\.?\s"
JUDGMENT_PATH = r"^/akn/([a-z0-9-]+)/judgment/([a-z0-9-]+)/(\d{4})/([A-Za-z0-9-]+)/([a-z]{3})@(\d{4}-\d{2}-\d{2})/?$"
CITATION_IN_CLAIM = r"\[\s*\d{4}\s*\]\s*[A-Za-z]+\s*\d+"
PAGE_REFERENCE = r"(?i)\b(?:pages?|pgs?|pp?)(?:\.\s*|\s+)\d+"
ELLIPSIS = r"\s*(?:\.\s*){3,}\s*|\s*…\s*"
MOJIBAKE = "Â(?=[\\s -¿]|$)|â€"
QUOTE_FROM, QUOTE_TO = "‘’‚‛“”„‟–—‐‑−", "''''\"\"\"\"-----"
DROPPED = "­​﻿"
EDGE = " \t\n\"'`.,;:"


def strip(value: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def not_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def clean_value(value: Column) -> Column:
    """Null for a marker of a missing value; NUL characters and outer white space go."""
    plain = strip(F.translate(value, "\x00", ""))
    return F.when(~F.lower(plain).isin(*MISSING), plain)


def has_nul(value: Column) -> Column:
    return F.coalesce(value.contains("\x00"), F.lit(False))


def collapse(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def without_copy_label(value: Column) -> Column:
    return not_empty(strip(F.regexp_replace(value, r"(?U)\s*Copy\s*$", "")))


def normal_citation(value: Column) -> Column:
    return collapse(F.regexp_replace(F.upper(value), r"(?U)[^\w\s]|_", " "))


def neutral_citation(value: Column, pattern: str = NEUTRAL_CITATION) -> Column:
    """struct(year, court, number) of the first citation, null if there is none."""
    part = lambda i: F.regexp_extract(value, pattern, i)
    return F.when(value.rlike(pattern), F.struct(part(1).cast("int").alias("year"), part(2).alias("court"), part(3).cast("long").alias("number")))


def detect_citation(value: Column) -> Column:
    """A bracketed citation, or else a bare one whose court has two capitals."""
    return F.coalesce(neutral_citation(value), neutral_citation(value, BARE_CITATION))


def title_of(citation: Column) -> Column:
    """The text before the bracketed citation or the first parenthesis that closes."""
    before = F.when(F.instr(citation, " [") > 0, F.substring_index(citation, " [", 1)).otherwise(citation)
    return not_empty(strip(F.regexp_replace(before, r"(?s)\s\((?=[^)]*\)).*$", "")))


def case_number(value: Column) -> Column:
    parts = F.filter(F.transform(F.split(value, ";"), collapse), lambda p: p != "")
    return not_empty(F.array_join(parts, "; "))


def judges_of(value: Column) -> Column:
    names = F.transform(F.split(F.coalesce(value, F.lit("")), r"\R"), lambda line: strip(F.regexp_replace(collapse(line), "[,;]+$", "")))
    return F.filter(names, lambda n: n != "")


def judgment_path(url: Column) -> Column:
    """struct of the parts of a judgment's address, null if the path or its date isn't valid."""
    path = F.regexp_replace(F.regexp_replace(strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    part = lambda i: F.regexp_extract(path, JUDGMENT_PATH, i)
    plain = F.rtrim(path, F.lit("/"))
    day = F.try_to_date(part(6), "yyyy-MM-dd")
    made = F.struct(
        plain.alias("uri"), F.regexp_replace(plain, "/[^/]*$", "").alias("work"), part(1).alias("jurisdiction"), part(2).alias("court"),
        part(3).cast("int").alias("year"), part(4).alias("number"), part(5).alias("language"), day.alias("day"),
    )
    return F.when(path.rlike(JUDGMENT_PATH) & day.isNotNull(), made)


def judgment_date(value: Column) -> Column:
    """"17 June 1963" or "1963-06-17"; anything else is null."""
    plain = collapse(value)
    return F.coalesce(F.when(plain.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.try_to_date(F.initcap(plain), "d MMMM yyyy")), F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(plain, "yyyy-M-d")))


def looks_like_case_name(value: Column) -> Column:
    return value.rlike(CASE_NAME)


def party_words(value: Column) -> Column:
    """array of arrays: each side's significant words, sorted; sides without any go."""
    sides = F.split(F.concat(F.lit(" "), value, F.lit(" ")), PARTY_SEPARATOR)
    stop = F.array(*map(F.lit, PARTY_STOPWORDS))
    words = F.transform(sides, lambda s: F.array_sort(F.array_except(F.regexp_extract_all(F.upper(s), F.lit("([A-Z0-9]{3,})"), 1), stop)))
    return F.filter(words, lambda w: F.size(w) > 0)


def names_every_party(sides: Column, citation: Column) -> Column:
    """Each side has a word among the citation's words."""
    held = F.split(normal_citation(citation), " ")
    return F.forall(sides, lambda side: F.arrays_overlap(side, held))


def escape_like(value: Column) -> Column:
    return F.regexp_replace(value, r"([\\%_])", r"\\$1")


def plain_text(value: Column) -> Column:
    """Lower case, plain quotes and dashes, single spaces. Compatibility forms of Unicode stay as they are."""
    return F.lower(collapse(F.translate(F.translate(value, QUOTE_FROM, QUOTE_TO), DROPPED, "")))


def quote_parts(quote: Column) -> Column:
    parts = F.transform(F.split(quote, ELLIPSIS), lambda p: F.trim(plain_text(p), F.lit(EDGE)))
    return F.filter(parts, lambda p: p != "")


def quote_in(quote: Column, passage: Column) -> Column:
    """All parts of the quote stand in the passage, in order."""
    held = plain_text(passage)

    def step(at: Column, part: Column) -> Column:
        found = F.position(part, held, F.greatest(at, F.lit(1)))
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(found + F.length(part))

    return F.aggregate(quote_parts(quote), F.lit(1), step) > 0


def quote_words(quote: Column) -> Column:
    return F.aggregate(quote_parts(quote), F.lit(0), lambda n, p: n + F.size(F.split(p, " ")))


def references_supported(claim: Column, own: Column, passages: Column) -> Column:
    """Each citation in a claim is one of its cases' own, or stands in a cited passage; no page is named."""
    cited = F.regexp_extract_all(claim, F.lit(f"({CITATION_IN_CLAIM})"), 1)
    known = lambda c: F.coalesce(F.exists(own, lambda o: o.eqNullSafe(neutral_citation(c)) & neutral_citation(c).isNotNull()), F.lit(False)) | F.coalesce(plain_text(passages).contains(plain_text(c)), F.lit(False))
    return F.forall(cited, known) & ~claim.rlike(PAGE_REFERENCE)


def labels(raw: Column) -> Column:
    """Source labels without brackets, in capitals, each once."""
    return F.array_distinct(F.transform(raw, lambda x: F.upper(F.trim(strip(x), F.lit("[]")))))


def envelope(label: Column, citation: Column, excerpt: Column) -> Column:
    """A source block that its own text cannot close or reopen."""
    safe = F.regexp_replace(excerpt, r"(?i)<(/?)\s*source", "&lt;$1source")
    attribute = F.replace(F.replace(F.replace(citation, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit('<source id="'), label, F.lit('" citation="'), attribute, F.lit('">\n'), safe, F.lit("\n</source>"))


def page_label(first: Column, last: Column, status: Column) -> Column:
    """"p. 3" or "pp. 3-5", counted from 1; only verified pages are named."""
    one = F.concat(F.lit("p. "), (first + 1).cast("string"))
    more = F.concat(F.lit("pp. "), (first + 1).cast("string"), F.lit("-"), (last + 1).cast("string"))
    return F.when(status == "verified", F.when(first == last, one).otherwise(more))


def is_chrome(line: Column) -> Column:
    return line.isin(*NAVIGATION, *VIEWER) | line.rlike(VIEWER_PROMPT)


def is_viewer_boilerplate(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    return F.coalesce((F.size(lines) > 0) & F.forall(lines, is_chrome), F.lit(False))


def without_navigation(text: Column) -> Column:
    """The text from the first line that is neither blank nor a navigation label."""
    lines = F.split(text, r"\R")
    body = F.filter(F.transform(lines, lambda x, i: F.when((strip(x) != "") & ~strip(x).isin(*NAVIGATION), i)), lambda i: i.isNotNull())
    first = F.get(body, 0)
    cut = strip(F.array_join(F.slice(lines, first + 1, F.size(lines) - first), "\n"))
    return F.when(first == 0, text).when(first.isNull(), F.lit("")).otherwise(cut)


def quality_flags(text: Column) -> Column:
    plain = strip(text)
    broken = F.length(plain) - F.length(F.translate(plain, "�", ""))
    flags = F.array_compact(F.array(
        F.when(broken > 0.01 * F.length(plain), F.lit("replacement_characters")),
        F.when(plain.rlike(MOJIBAKE), F.lit("mojibake")),
        F.when(is_viewer_boilerplate(plain), F.lit("viewer_boilerplate")),
    ))
    return F.when(plain == "", F.array(F.lit("empty"))).otherwise(flags)


def context_prefix(title: Column, court: Column, day: Column, section: Column) -> Column:
    head = F.array_join(F.array_compact(F.array(not_empty(title), not_empty(court), F.year(day).cast("string"))), " | ")
    return F.array_join(F.array_compact(F.array(not_empty(head), not_empty(section))), "\n")


def tokens(text: Column) -> Column:
    """The different words of letters and digits of three or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), 1))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def char_grams(text: Column, n: int = 20) -> Column:
    """The different n-grams of characters; none if the text is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def ascii_grams(text: Column, n: int = 20) -> Column:
    """char_grams of a text of ASCII characters: taken from its bytes, where a place is found without counting characters."""

    def of(data: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(data) - (n - 1), F.lit(1))), lambda i: F.substring(data, i, F.lit(n)).cast("string"))
        return F.when(F.length(data) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    # The bytes are a bound variable: else they would be made again for each gram.
    return F.element_at(F.transform(F.array(F.encode(text, "US-ASCII")), of), 1)


def containment(reference: Column, candidate: Column) -> Column:
    """Which share of the reference's members the candidate has; 0 for an empty reference."""

    def share(both: Column) -> Column:
        return F.when(F.size(both["r"]) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(both["r"], both["c"])) / F.size(both["r"]))

    # Bound once, as both are often made from whole texts.
    return F.element_at(F.transform(F.array(F.struct(reference.alias("r"), candidate.alias("c"))), share), 1)


def entails(premise: Column, claim: Column) -> Column:
    """The word-containment stand-in for an inference model: entailment, contradiction or neutral."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1)
    negated = lambda t: F.arrays_overlap(words(t), F.array(F.lit("not"), F.lit("no"), F.lit("never")))
    missing = F.array_except(F.filter(words(claim), lambda w: F.length(w) > 3), words(premise))
    return F.when(F.size(missing) > 0, "neutral").when(negated(premise) != negated(claim), "contradiction").otherwise("entailment")


def highlight(text: Column, words: list[str]) -> Column:
    """Marks the words, longest first, where they begin a word."""
    pattern = "|".join(sorted({w.lower() for w in words}, key=lambda w: (-len(w), w)))
    return F.regexp_replace(text, rf"(?iU)\b({pattern})", "«$1»")


def simple_words(text: Column) -> Column:
    """The words of the simple text configuration: lower case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def trigrams(text: Column) -> Column:
    """The different trigrams of each word with two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def url_path(url: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), F.lit("/"))


def hex_id(value: Column) -> Column:
    """An identifier of 32 hexadecimal digits, dashes left out, in lower case; null for anything else."""
    plain = F.lower(F.replace(strip(value), F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def sentences(text: Column) -> Column:
    """A rough split at ends of sentences and blank lines; a piece of fewer than four words takes the next one to it."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+(?=[A-Z\"“(\[])|\n\s*\n"), collapse), lambda p: p != "")
    short = lambda p: F.size(F.split(p, " ")) < 4
    step = lambda out, p: F.when((F.size(out) > 0) & short(F.element_at(out, -1)), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.lit(" "), p)))).otherwise(F.concat(out, F.array(p)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def sentence_windows(parts: Column, most: int = 3) -> Column:
    """Runs of one to most sentences in order, each once; of fewer sentences than a run's size, all of them are one run."""
    n = F.size(parts)

    def of_size(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.lit(size)), " "))
        return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*(of_size(k) for k in range(1, most + 1)))))


def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def folded(value: Column) -> Column:
    """The compatibility form of Unicode, case folded; no built-in function has either."""
    # Made when it is used: workers that import this module have no session.
    return F.pandas_udf(_fold, StringType())(value)


def normal_text(value: Column) -> Column:
    """plain_text over the folded form: what quotes and excerpts are compared by where they may hold any script."""
    return plain_text(folded(value))
