"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a Column that is true when a document passes. On a sample of rows each rule is run and timed, which
tells how much it rejects and what it costs; the rules then run by rejection per cost, and a document that one rule
rejects skips the rest. The order changes the cost only: a document is kept when it passes all rules. Rules read the
measures that all of them share, so words are cut and counted once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, OWN, WORD

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once: optimizers may copy a column's expression into each use, not a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Windows are told apart by a 64-bit hash of their word hashes within the one document. Documents without a
    repeated window, nearly all, end after one distinct count. Else the windows are sorted by hash, those equal to a
    neighbour give their positions, and each adds the words up to the next position, five at most.
    """

    def counted(windows: Column) -> Column:
        in_order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        many = let(let(in_order, places), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(many)

    def over(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))
        return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(windows, counted))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def base_measures(text: Column) -> Column:
    """n_words, word_chars and n_repeat_words (in of_words), n_lines (with a word) and n_dup_lines (in of_lines) and n_symbols as one struct."""
    plain = F.coalesce(text, F.lit(""))

    def over(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).cast("long").alias("n_repeat_words"))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    with_word = F.filter(F.split(plain, "\n"), lambda x: x.rlike(WORD))
    return F.struct(let(words_of(text), over).alias("of_words"), let(with_word, lines).alias("of_lines"), F.regexp_count(plain, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))


@dataclass(frozen=True)
class Rule:
    """passes(text, measures) is true or false, never null."""

    name: str
    passes: Callable[[Column, Column], Column]


def words_in(m: Column) -> Column:
    return m["of_words"]["n_words"]


def matches_at_most(pattern: str, most: float) -> Callable[[Column, Column], Column]:
    """Matches of a pattern per word."""
    return lambda text, m: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)) <= most * words_in(m)


#: The base rules, which the contract fixes, and the further rules of the method.
BASE_RULES = (Rule("words", lambda text, m: words_in(m) >= 10), Rule("repeats", lambda text, m: 100 * m["of_words"]["n_repeat_words"] <= 20 * words_in(m)))
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda text, m: m["n_symbols"] <= 0.1 * words_in(m)),
    Rule("word_length", lambda text, m: m["of_words"]["word_chars"].between(2 * words_in(m), 15 * words_in(m))),
    Rule("lines", lambda text, m: m["of_lines"]["n_dup_lines"] <= 0.5 * m["of_lines"]["n_lines"]),
    Rule("shouting", matches_at_most(r"!!+|\?\?+", 0.1)),
    # A match begins at a word's first letter and takes the rest of the word: so many words have a letter.
    Rule("letters", lambda text, m: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}[^\x20\x09-\x0D]*+")) >= 0.7 * words_in(m)),
)

SHARED = "struct<of_words:struct<n_words:long,word_chars:long,n_repeat_words:long>,of_lines:struct<n_lines:long,n_dup_lines:long>,n_symbols:long>"


def judged(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body over a text and its measures, both bound variables: one expression, however an optimizer moves it."""
    return let(text, lambda t: let(base_measures(t), lambda m: body(t, m)))


def order_rules(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_rows: int) -> list[Rule]:
    """The rules by rejection per cost on at most sample_rows rows; ties by name. It changes the order alone.

    limit(...).collect() stops at the first partitions that hold so many rows, however many there are, and only
    verdicts reach the driver. A rule's cost is its own time on the sample, beside the measures that are there anyway.
    """
    sample = docs.select(F.col(text_col).alias("text")).limit(sample_rows)

    def verdicts(chosen: tuple[Rule, ...]) -> Callable[[Column, Column], Column]:
        return lambda t, m: F.array(F.length(F.coalesce(t, F.lit(""))) * 0, *(F.when(rule.passes(t, m), 0).otherwise(1) for rule in chosen))

    def seconds(*chosen: Rule) -> float:
        began = time.perf_counter()
        sample.select(let(F.col("text"), lambda t: let(F.lit(None).cast(SHARED), lambda m: verdicts(chosen)(t, m)))).collect()
        return time.perf_counter() - began

    rows = [r[0] for r in sample.select(judged(F.col("text"), verdicts(rules))).collect()]
    seconds(*rules)
    nothing = seconds()
    cost = {r.name: max(seconds(r) - nothing, 1e-3) for r in rules}
    rejected = {r.name: sum(row[1 + i] for row in rows) / max(1, len(rows)) for i, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-rejected[r.name] / cost[r.name], cost[r.name], r.name))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Adds failed_rule (string, null if none) and kept; columns of these names in the input are replaced.

    failed_rule is the first rule in the cascade's order that rejects, so it may change with the sample; kept doesn't.
    Null and empty texts have no words and fail "words". Rows that repeat are judged each. No row is lost or added; an
    empty table stays empty.
    """
    docs = docs.drop("failed_rule", "kept")
    order = order_rules(docs, text_col, rules, sample_rows)

    def first(text: Column, m: Column) -> Column:
        found = F.lit(None).cast("string")
        for rule in reversed(order):
            found = F.when(~rule.passes(text, m), F.lit(rule.name)).otherwise(found)
        return found

    return docs.withColumn("failed_rule", judged(F.col(text_col), first)).withColumn("kept", F.col("failed_rule").isNull())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Per row: doc_id, the base measures, base_failed and kept.

    The base measures are given for all rows; those that fail the base skip the cascade, the others run through the
    further rules in its order. A null text counts as empty: no words, which fails the base. Rows that repeat an id and
    rows without one are judged each; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = order_rules(slim, "text", tuple(r for r in rules if r not in BASE_RULES), sample_rows)

    def told(text: Column, m: Column) -> Column:
        n, repeats = words_in(m), m["of_words"]["n_repeat_words"]
        failed, cascade = (n < 10) | (100 * repeats > 20 * n), F.lit(True)
        for rule in reversed(order):
            cascade = F.when(~rule.passes(text, m), F.lit(False)).otherwise(cascade)
        return F.struct(
            n.alias("n_words"), m["of_words"]["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["of_lines"]["n_dup_lines"].alias("n_dup_lines"),
            repeats.alias("n_repeat_words"), failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(cascade).alias("kept"),
        )

    report = f"{OWN}report"
    return slim.select("doc_id", judged(F.col("text"), told).alias(report)).select("doc_id", f"{report}.*")
