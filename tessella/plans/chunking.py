"""Exact-span passages: a document becomes pieces of its own text, each within a token budget.

One document is one unit of work and stays in its Arrow batch; nothing shuffles. Every token gets the strength of the
break in front of it: none, the end of a sentence, the beginning of a paragraph, or a heading. Places to cut follow
from the strengths alone, and one walk over them fills passages up to a target. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words of headings, abbreviations that end no sentence, and the patterns of headings, citations and numbers.
HEADINGS = (
    "JUDGMENT", "JUDGEMENT", "RULING", "CORAM", "FACTS", "BACKGROUND", "INTRODUCTION", "ISSUES?", "ANALYSIS", "EVALUATION", "HOLDINGS?", "DECISION", "CONCLUSIONS?",
    "ORDERS?", "DISPOSITION", "EVIDENCE", "SUBMISSIONS", "THE LAW", "GROUNDS? OF APPEAL", "RESOLUTION", "DETERMINATION", "REASONS?", "COSTS",
)
ABBREVIATIONS = (
    "no", "nos", "v", "vs", "vrs", "j", "jj", "jsc", "ja", "cj", "j.s.c", "j.a", "ltd", "co", "inc", "mr", "mrs", "ms", "dr", "prof", "hon", "s", "ss", "sec", "art",
    "arts", "para", "paras", "p", "pp", "cf", "e.g", "i.e", "etc", "al", "op", "cit", "ibid", "supra", "rev", "st", "esq", "gov", "govt", "corp", "dept", "ord", "cap",
    "vol",
)
HEADING = re.compile(r"(?:(?:[IVXLC]+|\d{1,2}|[A-Z])[.)]\s+)?(?:[A-Z][A-Z ,&'-]*\s)?(?:" + "|".join(HEADINGS) + r")(?:\s+[A-Z][A-Z ,&'-]*)?\s*:?")
PROTECTED = re.compile(r"\[\d{4}\]\s*[A-Za-z][A-Za-z0-9]*\s*\d+|\(\d{4}\)\s*\d+\s*[A-Z][A-Za-z.]*\s*\d*")
STOP = re.compile(r"[.?!;:](?=[\"')\]]?\s+[\"'(\[]?[A-Z0-9])")
BRACKETED, NUMBERED = re.compile(r"\s*\[(\d{1,3})\]"), re.compile(r"\s*(\d{1,3})\.\s+\S")
HEADING_CHARS, STRAY, NUMBERED_TOKENS = 60, 30, 30

NONE, SENTENCE, PARAGRAPH, SECTION = range(4)
#: Where the tokens of a text are: one row (start, end) each. Any tokenizer that tells offsets fits.
Tokenizer = Callable[[str], np.ndarray]


def words(text: str) -> np.ndarray:
    """Tokens as runs without white space."""
    return np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)


def is_heading(line: str) -> bool:
    return len(line) <= HEADING_CHARS and line.upper() == line and HEADING.fullmatch(line) is not None


def sentence_ends(text: str) -> np.ndarray:
    """Where a sentence ends: stops that aren't within a citation and don't belong to an abbreviation or an initial."""
    inside = np.zeros(len(text) + 1, bool)
    for m in PROTECTED.finditer(text):
        inside[m.start() : m.end() - 1] = True
    short = frozenset(ABBREVIATIONS)

    def ends(at: int) -> bool:
        if inside[at]:
            return False
        before = re.search(r"[^\s(\[\"']*\Z", text[max(0, at - 20) : at])[0].lower()
        return text[at] != "." or not (before in short or len(before) == 1 and before.isalpha())

    return np.array([m.start() for m in STOP.finditer(text) if ends(m.start())], np.int64)


def strengths(text: str, tokens: np.ndarray) -> np.ndarray:
    """The break in front of each token."""
    out = np.zeros(len(tokens), np.int8)
    following = np.searchsorted(tokens[:, 0], sentence_ends(text), side="right")
    out[following[following < len(tokens)]] = SENTENCE
    feeds = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    line = np.searchsorted(feeds, tokens[:, 0])
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    begins, ends = np.append(0, feeds + 1), np.append(feeds, len(text))
    titled = np.array([is_heading(text[begins[k] : ends[k]].strip()) for k in line[first].tolist()], bool)
    after_gap = np.append(True, np.diff(line[first]) > 1)
    after_title = np.append(False, titled[:-1])
    out[first[after_gap | after_title]] = PARAGRAPH
    out[first[titled]] = SECTION
    return out


def cuts(strength: np.ndarray, most: int) -> np.ndarray:
    """Token numbers where pieces of at most `most` tokens begin: as few kinds of break as that takes, the strong ones first."""
    at = np.flatnonzero(strength >= PARAGRAPH)
    for weaker in (np.flatnonzero(strength >= SENTENCE), np.arange(len(strength))):
        sizes = np.diff(at, append=len(strength))
        for start, size in zip(at[sizes > most].tolist(), sizes[sizes > most].tolist()):
            inner = weaker[(weaker > start) & (weaker < start + size)]
            at = np.append(at, inner if len(inner) < size - 1 else np.arange(start + most, start + size, most))
        at = np.unique(at)
    return at


def filled(at: np.ndarray, strength: np.ndarray, target: int, most: int) -> list[tuple[int, int]]:
    """(begin, named) of passages in token numbers: a passage's section is the one that stands at named.

    A heading always begins a passage. A stray, which is a passage of few tokens, goes into the one before it if there is
    room, whose section stays; one that can't is taken in by the one behind it, whose section then counts.
    """
    begins: list[int] = []
    for start, end in zip(at.tolist(), [*at[1:].tolist(), len(strength)]):
        if not begins or strength[start] == SECTION or end - begins[-1] > target:
            begins.append(start)
    made: list[tuple[int, int]] = []
    for start, end in zip(begins, [*begins[1:], len(strength)]):
        before = made[-1][0] if made else None
        room = before is not None and end - before <= most
        if room and start - before < STRAY:
            made[-1] = before, start
        elif not (room and end - start < STRAY):
            made.append((start, start))
    return made


class Piece(NamedTuple):
    start: int
    end: int
    tokens: int
    section: str | None
    refs: list[str]


def chunk(text: str, target: int = 350, most: int = 400, tokenizer: Tokenizer = words) -> list[Piece]:
    """The passages of a text in order.

    section is the last heading at or before a passage's begin, or that of the passage which a stray in front of it has
    joined; refs are the numbers of the paragraphs that begin in it: those in brackets, and those with a point if the
    paragraph has NUMBERED_TOKENS tokens. A tokenizer may see more tokens in a passage alone than in its text; such a
    passage is halved until it fits.
    """
    tokens = tokenizer(text)
    if not len(tokens):
        return []
    strength = strengths(text, tokens)
    passages = filled(cuts(strength, most), strength, target, most)
    paragraphs = np.flatnonzero(strength >= PARAGRAPH)
    sizes = np.diff(paragraphs, append=len(tokens))
    titles = np.flatnonzero(strength == SECTION)

    def label(k: int) -> str | None:
        last = int(np.searchsorted(titles, k, side="right")) - 1
        if last < 0:
            return None
        start = int(tokens[titles[last], 0])
        end = text.find("\n", start)
        return " ".join(text[start : end if end >= 0 else len(text)].split()).rstrip(":").rstrip()

    def piece(a: int, b: int, section: str | None) -> Iterator[Piece]:
        start, end = int(tokens[a, 0]), int(tokens[b - 1, 1])
        # Runs without white space are the same in a part of the text.
        n = b - a if tokenizer is words else len(tokenizer(text[start:end]))
        if n > most and b - a > 1:
            yield from piece(a, (a + b) // 2, section)
            yield from piece((a + b) // 2, b, section)
            return
        refs = []
        for k in range(*np.searchsorted(paragraphs, [a, b]).tolist()):
            at = int(tokens[paragraphs[k], 0])
            found = BRACKETED.match(text, at) or (NUMBERED.match(text, at) if sizes[k] >= NUMBERED_TOKENS else None)
            refs += [found[1]] if found else []
        yield Piece(start, end, n, section, list(dict.fromkeys(refs)))

    ends = [*(begin for begin, _ in passages[1:]), len(tokens)]
    return [p for (a, named), b in zip(passages, ends) for p in piece(a, b, label(named))]


CHUNKS = [("ordinal", pa.int32(), "int"), ("content", pa.string(), "string"), ("char_start", pa.int32(), "int"), ("char_end", pa.int32(), "int"), ("token_count", pa.int32(), "int"), ("section", pa.string(), "string"), ("refs", pa.list_(pa.string()), "array<string>")]


def chunked(target: int, most: int, tokenizer: Tokenizer) -> Callable:
    """Of each row a row per passage; the columns behind the text are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, rows = [], []
            for k, text in enumerate(batch.column(0).to_pylist()):
                for i, p in enumerate(chunk(text or "", target, most, tokenizer)):
                    rows.append((i, text[p.start : p.end], *p))
                    whole.append(k)
            made = [pa.array([r[j] for r in rows], t) for j, (_, t, _) in enumerate(CHUNKS)]
            kept = batch.select(batch.schema.names[1:]).take(pa.array(whole, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, *(n for n, _, _ in CHUNKS)])

    return run


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = 350, most: int = 400, tokenizer: Tokenizer = words, keep: tuple[str, ...] = ()) -> DataFrame:
    """Passages of each document, with their exact place in it, and the columns to keep."""
    if target > most:
        raise ValueError("the target must not exceed the limit")
    slim = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), *keep)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:]), *(f"{n} {t}" for n, _, t in CHUNKS)])
    return slim.mapInArrow(chunked(target, most, tokenizer), fields)


def join_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) as one text per document, pages a blank line apart, in page order.

    page_starts holds (page, start) of each page in that text, in order.
    """
    text = F.coalesce("text", F.lit(""))
    before = F.sum(F.length(text) + 2).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    placed = pages.select("doc_id", "page", text.alias("text"), F.coalesce(before, F.lit(0)).cast("int").alias("start"))
    made = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "start"))).alias("pages"))
    starts = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["start"].alias("start")))
    return made.select("doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"), starts.alias("page_starts"))


def page_of(page_starts: Column, char: Column) -> Column:
    """The last page that begins at or before a character."""
    return F.element_at(F.filter(page_starts, lambda p: p["start"] <= char), -1)["page"]


def with_page_bounds(chunks: DataFrame, status: Column | None = None) -> DataFrame:
    """Adds page_start and page_end to passages that kept page_starts: the pages of their first and last character.

    status says how far a document's pages are to be trusted; only "verified" ones give bounds, others are null.
    """
    trusted = F.lit(True) if status is None else F.coalesce(status == "verified", F.lit(False))
    bound = lambda char: F.when(trusted, page_of(F.col("page_starts"), char))
    return chunks.withColumn("page_start", bound(F.col("char_start"))).withColumn("page_end", bound(F.col("char_end") - 1))
