"""Columns of hashes, ranks, costs and statistics. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
#: The namespace of this library's name-based identifiers.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def canonical(*parts: Column) -> Column:
    """Parts behind each other with a separator that text doesn't hold; null differs from empty."""
    return F.concat_ws(UNIT, *(F.coalesce(p.cast("string"), F.lit("∅")) for p in parts))


def stable_hash(*parts: Column) -> Column:
    return sha256_text(canonical(*parts))


def stable_id(*parts: Column, namespace: str = NAMESPACE) -> Column:
    """A version-5 UUID of the parts."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(F.concat_ws(UNIT, *parts), "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def context_hash(title: Column, court: Column, day: Column) -> Column:
    """Changes with what an embedding was told about its document."""
    empty = F.lit("")
    return F.md5(F.concat(F.coalesce(title, empty), F.lit(UNIT), F.coalesce(court, empty), F.lit(UNIT), F.coalesce(F.year(day).cast("string"), empty)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rrf_term(rank: Column, k: int = 60) -> Column:
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def nearest_rank(values: Column, fraction: float) -> Column:
    """Of a sorted array the member at round-half-even(fraction * (n - 1))."""
    return F.element_at(values, F.bround(F.lit(fraction) * (F.size(values) - 1)).cast("int") + 1)


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """The exact two-sided test on discordant pairs; terms are built from each other, in logarithms."""
    n, least = only_a + only_b, F.least(only_a, only_b)
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum"))
    step = lambda a, k: F.struct((a["log"] + F.log((n - k + 1) / k)).alias("log"), (a["sum"] + F.exp(a["log"] + F.log((n - k + 1) / k))).alias("sum"))
    terms = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(F.log(F.aggregate(terms, zero, step)["sum"]) - n * F.log(F.lit(2.0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3.5).cast("int") + 40


def estimate_usd(plain: Column, cached: Column, output: Column, prices: tuple[str, str, str]) -> Column:
    """Dollars of a call at prices per million tokens."""
    p = [F.lit(x).cast("decimal(10,4)") for x in prices]
    return (F.round(F.greatest(plain - cached, F.lit(0)) * p[0] + cached * p[1] + output * p[2], 0) / 1000000).cast("decimal(10,6)")


def softmax(logits: Column) -> Column:
    most = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - most))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def display_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def version_tag(name: str, version: Column, digest: Column) -> Column:
    """name-version-digest, the digest by its first twelve characters."""
    return F.concat_ws("-", F.lit(name), version.cast("string"), F.left(digest, F.lit(12)))


def normal_email(value: Column) -> Column:
    return F.lower(F.trim(value))


def ascii_json(value: Column) -> Column:
    """JSON text with every character beyond ASCII escaped, those beyond 16 bits as a pair."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        high = F.shiftright(n - 0x10000, 10) + 0xD800
        return F.when(n < 128, c).when(n < 0x10000, code(n)).otherwise(F.concat(code(high), code((n - 0x10000) % 1024 + 0xDC00)))

    # Texts in ASCII alone, nearly all, stay as they are.
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(F.array_join(F.transform(F.split(value, ""), one), ""))


def stable_json_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of an object in canonical JSON: keys in order, no blanks, ASCII only; a null is written as null."""
    made = F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields))), {"ignoreNullFields": "false"})
    return F.sha2(ascii_json(made), 256)


def lock_key(text: Column) -> Column:
    """A number of 60 bits that stands for a text, for locks that take numbers."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
