"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, a line being what stands between two block tags. A line's weight is its text outside
links and outside parts that are no article by their own markup, and more inside article and main elements. Weights
are summed over a sliding window of lines: where the sum jumps above a threshold the text surges, where it falls to
nothing it dives, and the lines with a weight around a surge, from the first sum above nothing to the dive, are text.

A page is read once from left to right: a tag ends before the next "<" outside quotes, and behind the last ">" there
are none, so broken markup costs no more than any other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import OWN

# Element names and the words of class, id and role that mark a part as no article.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SKIPPED = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "button", "select", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NO_ARTICLE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup",
    "promo", "promoted", "promotion", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
    "complementary", "contentinfo", "alert",
}
# Words that name a place or a shape, beside which a word of NO_ARTICLE keeps its meaning.
SHAPES = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "card", "col", "column", "container", "content", "fixed", "form", "global", "group", "icons", "inner", "item", "items", "large", "left", "link",
    "links", "list", "main", "mobile", "module", "outer", "overlay", "page", "panel", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "text", "thread", "top", "unit", "wrap", "wrapper",
}
SMALL_PRINT = re.compile(r"^\s*(©|\(c\)\s*\d{4}|copyright\s*(?:©|\(c\)|\d{4})|all rights reserved)", re.I)
#: A line of small print is no longer than this.
SMALL_CHARS = 200

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?>[^<>=]+|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words of a class, id or role, however they are joined.
WORDS = re.compile(r"[a-z]+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an element's attributes say of it: an article's part, perhaps none, surely none.
SURE, DOUBT = 2, 1

WINDOW, SURGE = 3, 80


def told_by(value: str) -> int:
    """What one class, id or role says: its words are all known and one of NO_ARTICLE, or only the first one is."""
    words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    if not words or NO_ARTICLE.isdisjoint(words):
        return 0
    if all(w in NO_ARTICLE or w in SHAPES for w in words):
        return SURE
    return DOUBT if words[0] in NO_ARTICLE else 0


def no_article(name: str, attributes: str) -> int:
    """SURE if an element is no article, DOUBT if it may be none; by its name, or by its attributes' names and values.

    Inline elements are part of their line whatever their class is, and a heading's id is made of its words.
    """
    if name in SKIPPED:
        return SURE
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    found = 0
    for attribute, *values in ATTRIBUTE.findall(attributes):
        attribute, value = attribute.lower(), "".join(values)
        if attribute == "hidden" or attribute == "aria-hidden" and value.strip().lower() == "true" or attribute == "style" and NOT_SHOWN.search(value):
            return SURE
        if name in INLINE:
            continue
        if attribute in ("class", "role"):
            found = max([found, *map(told_by, value.split())])
        elif attribute == "aria-label" or attribute == "id" and name not in HEADINGS:
            found = max(found, told_by(value))
    return found


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, number of the outermost article or main element or 0) of each line, those of skipped parts with an empty text.

    Outside article and main elements a part that may be none by its class or id has less weight, a line at a time, so
    that only full paragraphs of it count. A form is skipped too, unless it holds more text than the rest of the page that isn't skipped: then it wraps the page.
    """
    plain, forms = _lines(page, True)
    if forms:
        wrapped, _ = _lines(page, False)
        if sum(w for _, w, _ in wrapped) > 2 * sum(w for _, w, _ in plain):
            return wrapped
    return plain


def _lines(page: str, skip_forms: bool) -> tuple[list[tuple[str, int, int]], bool]:
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = [0]
    skip, depth, link, article, articles, forms = "", 0, 0, 0, 0, False
    doubt, doubts = "", 0
    at, size, last = 0, len(page), page.rfind(">") + 1

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        weight = 0 if not article and len(text) <= SMALL_CHARS and SMALL_PRINT.match(text) else max(0, len(text) - 2 * linked[0])
        if doubt and not article:
            weight = max(0, weight - SURGE)
        out.append((text, weight, articles if article else 0))
        parts.clear()
        linked[0] = 0

    while at < size:
        found = TOKEN.search(page, at, last) if at < last else None
        text = page[at : found.start() if found else size]
        if text and not skip:
            parts.append(text)
            if link:
                linked[0] += len(text.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        closing = bool(found[1])
        if name in RAW and not closing:
            # Raw text ends at its own end tag only, whatever it holds.
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            if name != "iframe" and not skip and name not in INLINE:
                end_line()
            continue
        if skip:
            if name == skip:
                depth += -1 if closing else name not in VOID
            # A part that never ends doesn't swallow the article.
            if depth <= 0 or not closing and name in ("main", "body") or not closing and name == "article" and skip in SKIPPED or closing and name in ("body", "html", "article") and skip not in ("html", "body"):
                skip = ""
                end_line()
            if skip or closing and name not in ("article", "body", "html"):
                continue
        told = no_article(name, found[3]) if not closing and name not in VOID and (name != "form" or skip_forms) else 0
        if told == SURE:
            end_line()
            skip, depth, link, forms = name, 1, 0, forms or name == "form"
            continue
        if name == doubt:
            end_line()
            doubts += -1 if closing else 1
            doubt = doubt if doubts else ""
        elif told == DOUBT and not doubt:
            end_line()
            doubt, doubts = name, 1
        if name == "a":
            link = 0 if closing else 1
        elif name not in INLINE:
            end_line()
            link = 0
            if name in ("article", "main"):
                articles += not closing and not article
                article = max(0, article - 1) if closing else article + 1
    end_line()
    return out, forms


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surges and dives, blocks joined by one space.

    A line with a weight inside an article or main element has surge more. Windows and stretches end at the borders of
    these elements. The surge threshold is the smaller of surge and a third of the fullest window, so short pages keep
    their text, and of several stretches those count that have a fifth of the fullest one's weight, those of one
    article or main element taken together.
    """
    lines = lines_of(page or "")
    weights = [weight + surge if weight and article else weight for _, weight, article in lines]
    within = [article for _, _, article in lines]
    sums = [sum(w for w, article in zip(weights[i : i + window], within[i : i + window]) if article == within[i]) for i in range(len(weights))]
    if not sums or not max(sums):
        return ""
    threshold = min(surge, max(1, max(sums) // 3))
    stretches, totals, i = [], Counter(), 0
    while i < len(lines):
        if weights[i] and sums[i] >= threshold:
            j = i
            while j < len(lines) and sums[j] and within[j] == within[i]:
                j += 1
            # A title or another short line in front belongs to the text as one behind it does.
            while i and sums[i - 1] and within[i - 1] == within[i]:
                i -= 1
            owner = within[i] or -i - 1
            stretches.append((owner, i, j))
            totals[owner] += sum(weights[i:j])
            i = j
        else:
            i += 1
    most = max(totals.values(), default=0)
    return " ".join(lines[k][0] for owner, i, j in stretches if 5 * totals[owner] >= most for k in range(i, j) if weights[k])


def extracted(html_col: str, window: int, surge: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x, window, surge) for x in batch.column(html_col).to_pylist()]
            names = [n for n in batch.schema.names if n != html_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Replaces html_col by text (empty if there is none) and n_chars, its code points; other columns stay.

    A null page has no text. Rows that repeat are extracted each. Columns named text and n_chars in the input are
    replaced; an empty table stays empty. Pages are read whole, however long, one at a time.
    """
    held = f"{OWN}html"
    rest = pages.withColumnRenamed(html_col, held).drop("text", "n_chars")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != held]
    return rest.mapInArrow(extracted(held, window, surge), ", ".join([*fields, "text string", "n_chars long"]))
