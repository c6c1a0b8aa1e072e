"""Stems and cover density, and import rules, on known cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import english
from tessella.plans import importing


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
    ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("controlling", "control"), ("probate", "probat"), ("rate", "rate"), ("sky", "sky"),
])
def test_stems(word, stem):
    assert english.stem(word) == stem


@pytest.mark.parametrize("hits, n, score", [([(1, 0), (2, 1)], 2, 1.0), ([(1, 0), (5, 1)], 2, 1 / 4), ([(1, 0), (2, 1), (3, 0)], 2, 2.0), ([(4, 0)], 1, 1.0), ([(1, 0), (2, 0)], 2, 0.0)])
def test_cover_density(spark, hits, n, score):
    row = spark.createDataFrame([(hits, n)], "hits array<struct<place:int,term:int>>, n int")
    assert row.select(english.cover_density(F.col("hits"), F.col("n")).alias("s")).first()["s"] == pytest.approx(score)


def test_all_stems_must_match(spark):
    q = spark.createDataFrame([(1, "the courts allowed appeals"), (2, "the of")], "qid long, text string")
    p = spark.createDataFrame([(1, "An appeal was allowed by the court"), (2, "The court sat"), (3, None)], "chunk_id long, content string")
    assert [(r.qid, r.chunk_id) for r in english.ranked_matches(q, p).collect()] == [(1, 1)]


def test_ranking_happens_where_a_passage_is(spark):
    rng = random.Random(4)
    words = "appeal appeals court courts the of costs running run relational relate".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", " -"]) for _ in range(n))
    q = spark.createDataFrame([*((i, text(rng.choice([1, 2, 3, 4]))) for i in range(40)), (50, None), (51, "unheard"), (52, "court"), (52, "court costs")], "qid long, text string")
    p = spark.createDataFrame([*((i, text(rng.choice([0, 1, 5, 30, 80]))) for i in range(60)), (60, "court"), (60, "the costs"), (61, None), (None, "courts running")], "chunk_id long, content string").repartition(3)
    by_joins = sorted((tuple(r) for r in english.ranked_matches(q, p, most_terms=-1).collect()), key=str)
    found = english.ranked_matches(q, p)
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_joins and len(by_joins) > 200
    once = english.ranked_matches(q.where("qid < 52"), p.where("chunk_id < 60"))
    assert sorted((tuple(r) for r in once.collect()), key=str) == [r for r in by_joins if r[0] < 52 and r[1] is not None and r[1] < 60]
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan

def test_lexemes_are_counted_where_the_text_is(spark):
    texts = ["The courts, a COURT; appeals", "court", "", None, "\u212aings and \u0130stanbul's caf\u00e9s\0x9", "the of", *(f"word{i} words {i}" for i in range(40)), "y" * 300]
    rows = [*enumerate(texts), (1, "court costs"), (None, "one court"), (None, "court two")]
    expected = {}
    for key, text in rows:
        for place, s in english.lexemes(text):
            n, first = expected.get((key, s), (0, place))
            expected[key, s] = (n + 1, min(first, place))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = english.counted_lexemes(d, "doc_id", "text").collect()
    assert {(r.doc_id, r.stem): (r.n, r["first"]) for r in found} == expected and len(found) == len(expected)
    once = english.counted_lexemes(d.where("doc_id <> 1"), "doc_id", "text")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan

def test_import_rules(spark):
    rows = [(1, "a", "text one", "p"), (2, "a", "text one", "p"), (3, "b", "x", "p1"), (4, "b", "y", "p2"), (5, None, "z", "p"), (6, "c", "", "p"), (7, "d", "text one", "p9"), (8, "e", None, "p")]
    got = {r.row_number: (r.outcome, r.reason, r.shared_text) for r in importing.import_outcomes(spark.createDataFrame(rows, "row_number long, uri string, text string, print string")).collect()}
    assert got == {
        1: ("accepted", None, True), 2: ("skipped", "duplicate_row", True), 3: ("quarantined", "duplicate_uri_conflict", False), 4: ("quarantined", "duplicate_uri_conflict", False),
        5: ("quarantined", "invalid_uri", False), 6: ("quarantined", "no_text", False), 7: ("accepted", None, True), 8: ("quarantined", "no_text", False),
    }


def test_missing_markers_make_no_difference(spark):
    d = spark.createDataFrame([("N/A", "A v B Copy"), ("", "A v B"), (None, " A v B ")], "x string, citation string")
    assert d.select(importing.fingerprint({"x": F.col("x"), "citation": F.col("citation")}).alias("p")).distinct().count() == 1


def test_shared_files_need_more_than_a_title(spark):
    d = spark.createDataFrame([("a" * 30, "Mensah against Owusu Limited", "Mensah v Owusu [2020] XYSC 1", "Mensah Owusu", s) for s in (True, False)], "record string, file string, citation string, title string, shared boolean")
    assert [r.v for r in d.select(importing.file_verdict(F.col("record"), F.col("file"), F.col("citation"), F.col("title"), F.col("shared")).alias("v")).collect()] == ["mismatch", "verified_title"]
    long = d.limit(1).select(importing.file_verdict(F.lit("x"), F.lit("[2020] XYSC 10"), F.col("citation"), F.lit(""), F.lit(True)).alias("v")).first()["v"]
    assert long == "mismatch"
