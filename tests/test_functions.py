"""Known values of the scalar functions."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import values as V


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize("value, expected", [("N/A", None), (" nan ", None), ("", None), (" None", None), ("a\x00b ", "ab"), ("  x ", "x"), ("nano", "nano")])
def test_clean_value(spark, value, expected):
    assert one(spark, T.clean_value, value) == expected


@pytest.mark.parametrize("value, expected", [("A v B [2020] X 1 Copy", "A v B [2020] X 1"), ("Copy", None), ("Copyright v B", "Copyright v B")])
def test_copy_label(spark, value, expected):
    assert one(spark, T.without_copy_label, value) == expected


def test_citations(spark):
    assert one(spark, T.normal_citation, "Amber v  Birch [2022] XYSC 65 (15 June_2022)") == "AMBER V BIRCH 2022 XYSC 65 15 JUNE 2022"
    assert one(spark, T.normal_citation, "École é") == "ÉCOLE É"
    assert tuple(one(spark, T.neutral_citation, "x [2020]  XYSC 104 y")) == (2020, "XYSC", 104)
    assert one(spark, T.neutral_citation, "no citation") is None
    assert one(spark, T.detect_citation, "see 2020 XYSC 104")["court"] == "XYSC"
    assert one(spark, T.detect_citation, "in 2020 Kumasi 104") is None


@pytest.mark.parametrize("value, expected", [("Mensah v Owusu (J1/2/2020) [2020] XYSC 1", "Mensah v Owusu"), ("A (B v C", "A (B v C"), (" [2020] X 1", None)])
def test_title(spark, value, expected):
    assert one(spark, T.title_of, value) == expected


def test_lists(spark):
    assert one(spark, T.case_number, " A/1\n ;; B  2 ") == "A/1; B 2"
    assert one(spark, T.case_number, " ; ") is None
    assert one(spark, T.judges_of, "Stone-Field, JSC,\n   \n  Rivers, JSC;") == ["Stone-Field, JSC", "Rivers, JSC"]
    assert one(spark, T.party_words, "The Mensah Co v. Owusu and Others") == [["MENSAH"], ["OWUSU"]]


def test_judgment_path(spark):
    good = one(spark, T.judgment_path, " https://x.org/akn/xy/judgment/xysc/1963/1/eng@1963-06-17/ ")
    assert (good["uri"], good["work"], good["year"], str(good["day"])) == ("/akn/xy/judgment/xysc/1963/1/eng@1963-06-17", "/akn/xy/judgment/xysc/1963/1", 1963, "1963-06-17")
    assert one(spark, T.judgment_path, "/akn/xy/judgment/xysc/1963/1/eng@1963-02-30") is None
    assert one(spark, T.judgment_path, "/other") is None


@pytest.mark.parametrize("value, expected", [("17 June 1963", "1963-06-17"), ("7  june 1963", "1963-06-07"), ("1963-6-7", "1963-06-07"), ("June 1963", None), ("31 February 2001", None)])
def test_dates(spark, value, expected):
    found = one(spark, T.judgment_date, value)
    assert (str(found) if found else None) == expected


@pytest.mark.parametrize("quote, passage, expected", [
    ("the appeal ... dismissed", "The  Appeal is hereby DISMISSED", True), ("dismissed … the appeal", "the appeal is dismissed", False),
    ("“the court’s”", "in the court's view", True), ("a—b", "A-B", True), ("not there", "the appeal", False),
])
def test_quote_in(spark, quote, passage, expected):
    assert one(spark, T.quote_in, quote, passage) is expected


def test_references(spark):
    own = F.array(T.neutral_citation(F.lit("A v B [2020] XYSC 7")))
    check = lambda claim, passages="": one(spark, lambda c, p: T.references_supported(c, own, p), claim, passages)
    assert check("as in [2020] XYSC 7") and check("as in [1999] UKHL 4", "see [1999]  UKHL 4") and check("Exhibit P1")
    assert not check("as in [1999] UKHL 4") and not check("at p. 12") and not check("on pages 3")


def test_quality(spark):
    assert one(spark, T.quality_flags, "  ") == ["empty"]
    assert one(spark, T.quality_flags, "fine Ângelo") == []
    assert one(spark, T.quality_flags, "Â§ 4") == ["mojibake"]
    assert one(spark, T.quality_flags, "Summary\nDownload PDF") == ["viewer_boilerplate"]
    assert one(spark, T.without_navigation, "Summary\n\n Pages\nText\nSummary") == "Text\nSummary"


def test_gram_containment(spark):
    assert one(spark, lambda a: F.size(T.char_grams(a)), "short") == 0
    assert one(spark, lambda a: F.size(T.char_grams(a)), "x" * 25) == 1
    assert one(spark, lambda a, b: T.containment(T.tokens(a), T.tokens(b)), "", "abc") == 0.0
    assert one(spark, lambda a, b: T.containment(T.tokens(a), T.tokens(b)), "abc def", "ABC") == 0.5


@pytest.mark.parametrize("premise, claim, expected", [("the appeal is allowed", "appeal allowed", "entailment"), ("the appeal is not allowed", "appeal allowed", "contradiction"), ("the appeal", "costs awarded", "neutral")])
def test_entails(spark, premise, claim, expected):
    assert one(spark, T.entails, premise, claim) == expected


def test_stable_id(spark):
    name = "\x1f".join(("a", "b"))
    assert one(spark, V.stable_id, "a", "b") == str(uuid.uuid5(uuid.UUID(V.NAMESPACE), name))


@pytest.mark.parametrize("a, b, expected", [(0, 0, 1.0), (5, 0, 0.0625), (3, 3, 1.0), (1, 8, 0.0390625), (400, 300, None)])
def test_mcnemar(spark, a, b, expected):
    from math import comb

    exact = expected if expected is not None else min(1.0, 2 * sum(comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
    got = spark.range(1).select(V.mcnemar(F.lit(a), F.lit(b)).alias("p")).first()["p"]
    assert got == pytest.approx(exact, rel=1e-9)


def test_costs(spark):
    usd = spark.range(1).select(V.estimate_usd(F.lit(1000), F.lit(200), F.lit(120), ("0.10", "0.01", "0.50")).alias("x")).first()["x"]
    assert str(usd) == "0.000142"
    assert one(spark, V.estimate_tokens, "x" * 35) == 50


def test_canonical_json_and_folded_text(spark):
    import hashlib
    import json
    import unicodedata

    values = ["plain", 'é "quoted" \\ back\nslash', "🙂 ß ﬁ Ｆ", "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v string")
    made = rows.select("id", V.stable_json_hash({"v": F.col("v"), "id": F.col("id")}).alias("h"), T.folded(F.col("v")).alias("f"), V.lock_key(F.coalesce("v", F.lit("x"))).alias("k")).collect()
    for r in made:
        v = values[r.id]
        assert r.h == hashlib.sha256(json.dumps({"id": r.id, "v": v}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert r.f == (None if v is None else unicodedata.normalize("NFKC", v).casefold())
        assert r.k == int(hashlib.sha256((v if v is not None else "x").encode()).hexdigest()[:15], 16)
