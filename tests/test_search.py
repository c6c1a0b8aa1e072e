"""Search, evaluation, fuzzy names and records on small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluation, fuzzy, ranking, records
from tessella.operators import verification as ver
from tessella.plans import search

HELD = "chunk_id long, doc_id long, ordinal long, source_text_hash string, content_hash string, content string, court_code string, year int"
ASKED = "qid long, text string, court_code string, year_from int, year_to int"


@pytest.fixture(scope="module")
def held(spark):
    rows = [
        (10, 1, 0, "a", "1", "The appeals were dismissed by the court", "en", 2001),
        (11, 1, 1, "a", "2", "An appeal was dismissed with costs", "en", 2001),
        (20, 2, 0, "b", "3", "The appeal was dismissed again and again, dismissed for good", "fr", 2010),
        (30, 3, 0, "c", "4", "Nothing of the kind", "en", 2010),
    ]
    return spark.createDataFrame(rows, HELD)


def asked(spark, *rows):
    return spark.createDataFrame([(i, *(r + (None,) * (4 - len(r)))) for i, r in enumerate(rows)], ASKED)


def test_every_word_must_be_there_and_filters_hold(spark, held):
    q = asked(spark, ("appeal dismissed",), ("appeal nonsense",), ("appeal dismissed", "fr"), ("dismissed", None, 2002), ("dismissed", None, None, 2005), ("",))
    found = {(r.qid, r.chunk_id): (r.score, r.rank) for r in search.lexical_channel(q, held, forms=("simple",)).collect()}
    # Two covers, "appeal was dismissed" and nothing shorter later: the second begins at the same word and counts once.
    assert found == {(0, 11): (0.5, 1), (0, 20): (0.5, 2), (2, 20): (0.5, 1), (3, 20): (2.0, 1), (4, 10): (1.0, 1), (4, 11): (1.0, 2)}
    stems = {(r.qid, r.chunk_id) for r in search.lexical_channel(q, held).collect()}
    assert stems == set(found) | {(0, 10)}


@pytest.mark.parametrize("at_once", [2, 100])
def test_nearest_are_those_of_a_plain_product(spark, at_once):
    rng = np.random.default_rng(3)
    v, q = np.round(rng.normal(size=(900, 4)), 1), np.round(rng.normal(size=(5, 4)), 1)
    courts = ["en" if i % 3 else None for i in range(900)]
    rows = spark.createDataFrame([(i, i, str(i), "", x.tolist(), c, 1990 + i % 30, i % 7 > 0) for i, (x, c) in enumerate(zip(v, courts))], "chunk_id long, doc_id long, source_text_hash string, content_hash string, vector array<double>, court_code string, year int, current boolean").repartition(3)
    questions = spark.createDataFrame([(j, x.tolist(), "en" if j == 1 else None, 2000 if j == 2 else None, 2010 if j == 2 else None) for j, x in enumerate(q)], "qid long, vector array<double>, court_code string, year_from int, year_to int")
    made = search.dense_channel(questions, rows, raw=15, limit=15, per_case=1, most_questions=at_once).collect()
    for j in range(5):
        own = [i for i in range(900) if i % 7 and (j != 1 or courts[i] == "en") and (j != 2 or 2000 <= 1990 + i % 30 <= 2010)]
        best = sorted(own, key=lambda i: (-round(float(v[i] @ q[j]), 9), i))[:15]
        assert [r.chunk_id for r in sorted((r for r in made if r.qid == j), key=lambda r: r.rank)] == best


def test_citations_and_case_names_come_first(spark, held):
    judgments = spark.createDataFrame(
        [(1, "a", "en", 2001, "Mensah v. Owusu (J1/1/2001) [2001] XYSC 7", "eligible", None, "/u1"), (2, "b", "fr", 2010, "Addo v. Boateng [2010] XYSC 9", "eligible", None, "/u2"), (3, "c", "en", 2010, "Addo v. Nyarko [2010] XYSC 70", "ineligible", None, "/u3")],
        "doc_id long, source_text_hash string, court_code string, year int, citation string, eligibility string, judgment_date date, uri string",
    )
    q = asked(spark, ("what [2001] xysc 7 held",), ("Addo v Boateng",), ("Addo v Boateng", "en"), ("Addo v Nyarko",), ("dismissed",))
    exact = {(r.qid, r["class"], r.chunk_id) for r in search.exact_blocks(q, judgments, held).collect()}
    assert exact == {(0, 0, 10), (1, 1, 20)}
    lexical = search.lexical_channel(q, held)
    dense = search.dense_channel(search.bag_vectors(q, "text"), search.bag_vectors(held, "content"))
    made = search.search(q, judgments, held, lexical, dense).collect()
    first = {r.qid: (r.chunk_id, r.channel, r.score) for r in made if r.case_rank == 1 and r.in_case == 1}
    assert first[0] == (10, "citation", 1.0) and first[1] == (20, "case_name", 1.0) and first[3][1] == "dense" and first[4][1] == "hybrid"
    assert all(len({r.content_hash for r in made if (r.qid, r.case_rank) == k}) == sum((r.qid, r.case_rank) == k for r in made) <= 3 for k in {(r.qid, r.case_rank) for r in made})


def test_places_over_all_rows(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    made = ranking.numbered(rows, [F.col("k")]).collect()
    assert all(r.place == r.k + 1 for r in made) and len(made) == 1000
    assert ranking.numbered(rows.where("id < 0"), [F.col("k")]).count() == 0


@pytest.mark.parametrize("sent", [0, 100])
def test_containing_with_items_of_any_length(spark, sent):
    texts = {1: "one two three four five six seven eight", 2: "xone two", 3: "a one two three b", 4: "nothing", 5: "one  two three", 6: ""}
    items = {1: "two three four five six seven eig", 2: "one two", 3: "one two three", 4: "two", 5: "wo three four five s", 6: "absent words of more than seven in a row"}
    found = evaluation.containing(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), sent_items=sent)
    assert sorted(tuple(r) for r in found.collect()) == sorted((d, i) for d, t in texts.items() for i, x in items.items() if x in t)


def test_metrics_of_three_questions(spark):
    q = spark.createDataFrame([(1, "words"), (2, "words"), (3, "words")], "qid long, category string")
    ranked = spark.createDataFrame([("lexical", 1, 10, 1, 1), ("lexical", 2, 20, 9, 1), ("dense", 1, 10, 1, 1), ("dense", 2, 21, 2, 2), ("dense", 3, 30, 3, 1)], "config string, qid long, chunk_id long, doc_id long, rank long")
    gold = spark.createDataFrame([(1, 1), (2, 2)], "qid long, doc_id long")
    held = spark.createDataFrame([(10, "the gold text"), (20, "x"), (21, "gold"), (30, "y")], "chunk_id long, content string")
    texts = spark.createDataFrame([(1, "gold text"), (2, "the gold words"), (3, "z")], "qid long, text string")
    records_ = evaluation.retrieval_records(q, ranked, gold, held, texts)
    found = {r.config: (r.questions, r.answerable, r.recall, r.mrr, r.passage_recall) for r in evaluation.retrieval_metrics(records_, ["config"]).collect()}
    assert found == {"lexical": (3, 2, 0.5, 0.5, 0.5), "dense": (3, 2, 1.0, 0.75, 1.0)}


def test_nearest_ranks(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in np.round(rng.normal(size=500) * 1000, 1)] + [0.0, 0.0, -0.5]
    rows = spark.createDataFrame([("a", x) for x in values] + [("b", 7.0), ("c", None)], "k string, x double")
    got = {r.k: (r.p50, r.p95) for r in evaluation.nearest_rank(rows, ["k"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    at = lambda f: sorted(values)[round(f * (len(values) - 1))]
    assert got == {"a": (at(0.5), at(0.95)), "b": (7.0, 7.0)}


def test_fuzzy_names(spark):
    asked_ = spark.createDataFrame([("mensah owusu",), ("",)], "asked string")
    held_ = spark.createDataFrame([(1, "Re Mensah v Owusu and others"), (2, "Mensa Owuso"), (3, "Boateng")], "id long, name string")
    made = {r.id: r.similarity for r in fuzzy.similar_names(asked_, "asked", held_, "name", 0.3).collect()}
    assert set(made) == {1, 2} and made[1] > made[2]


def test_review_steps_and_versions(spark):
    steps = {"create": ("draft", ("",)), "approve": ("approved", ("draft",)), "reopen": ("draft", ("approved",))}
    rows = [(1, "2024-01-0%d" % (i + 1), a, v) for i, (a, v) in enumerate([("approve", 0), ("create", 0), ("approve", 0), ("approve", 1), ("reopen", 2), ("unknown", 3)])]
    events = spark.createDataFrame(rows, "id long, at string, action string, version int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    made = [(r.status, r.version, r.refused) for r in records.review_history(events, steps).orderBy("at").collect()]
    assert made == [("", 0, "illegal_step"), ("draft", 1, None), ("draft", 1, "version_conflict"), ("approved", 2, None), ("draft", 3, None), ("draft", 3, "illegal_step")]


def test_prepared_records(spark):
    text = "A judgment of some length. " * 12
    rows = [(1, "Mensah v. Owusu [2020] XYSC 7 Copy", text, None, None, "en"), (2, "no number", " N/A ", "<p>x", None, None), (3, None, "short\x00", None, None, "en")]
    made = {r.row_number: r for r in records.prepared(spark.createDataFrame(rows, "row_number long, citation string, full_text string, html string, file_text string, language string")).collect()}
    assert (made[1].title, made[1].year, made[1].text_status, made[1].issues, len(made[1].sources)) == ("Mensah v. Owusu", 2020, "available", [], 1)
    assert (made[2].text_status, made[2].issues) == ("conversion_pending", ["no_citation", "no_language"]) and made[3].issues == ["no_citation", "nul_characters", "short_text"]


def test_sources_of_a_case(spark):
    items = [(c, p, 100) for c in (1, 2, 3, 4, 5) for p in (1, 2, 3)]
    row = spark.createDataFrame([(items,)], "items array<struct<case:int,place:int,cost:int>>")
    assert [(x["case"], x["place"]) for x in row.select(ver.choose_sources(F.col("items")).alias("x")).first().x] == [(c, p) for c in (1, 2, 3, 4) for p in (1, 2)]
    assert len(row.select(ver.choose_sources(F.col("items"), budget=350).alias("x")).first().x) == 3
    assert [tuple(x)[:2] for x in row.select(ver.leading_and_closing(F.col("items")).alias("x")).first().x] == [(1, 1), (5, 2), (5, 3)]

def test_fuzzy_join_against_all_runs(spark):
    """Random names against every run of words; null, empty and repeated names."""
    import random
    import re

    rng = random.Random(4)
    made = lambda: " ".join("".join(rng.choice("abx") for _ in range(rng.choice([1, 2, 3, 5]))) for _ in range(rng.choice([0, 1, 2, 4])))
    left, right = [made() for _ in range(60)] + [None, "", "ab", "ab"], [made() for _ in range(80)] + [None, "", "--", "ab ab"]

    def grams(ws):
        return {f"  {w} "[i : i + 3] for w in ws for i in range(len(w) + 1)}

    expected = {}
    for a in set(left):
        wanted = grams(re.findall("[a-z0-9]+", a or ""))
        for k, b in enumerate(right):
            w = re.findall("[a-z0-9]+", b or "")
            best = max((len(wanted & (g := grams(w[i:j]))) / len(wanted | g) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=0)
            if wanted and best >= 0.5:
                expected[(a, k)] = best
    a_, h_ = spark.createDataFrame([(x,) for x in left], "asked string"), spark.createDataFrame(list(enumerate(right)), "id long, name string")
    found = {(r.asked, r.id): r.similarity for r in fuzzy.similar_names(a_, "asked", h_, "name", 0.5).collect()}
    assert found == pytest.approx(expected) and len(expected) > 50


def test_word_similarity_returns_every_link(spark, tmp_path):
    """Each key that shares anything with an asked name, not only the best or the near; copies, a key with two names, nulls."""
    import re

    import duckdb

    from tessella.catalog import ORACLES, QUERIES

    parts = [(1, "blue anvil", "Brand#7"), (2, "cold gear", "Brand#1"), (2, "blue gear", "Brand#1"), (3, "blue anvil", "Brand#7"), (4, None, "Brand#7"), (5, "blue rod", None)]
    parts += [(None, "brown rod", "Brand#3"), (6, "", "Brand#4"), (7, "zz", "Brand#5"), (8, "a long old iron ring", "Brand#6"), (2, "cold gear", "Brand#1")]
    frame = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string")
    frame.write.parquet(f"{tmp_path}/part.parquet")

    def grams(ws):
        return {f"  {w} "[i : i + 3] for w in ws for i in range(len(w) + 1)}

    expected = {}
    for asked in {name[:-1] for _, name, _ in parts if name is not None}:
        wanted = grams(re.findall("[a-z0-9]+", asked))
        for key, name, brand in parts:
            w = re.findall("[a-z0-9]+", f"{name} of {brand}".lower()) if name is not None and brand is not None else []
            best = max((len(wanted & (g := grams(w[i:j]))) / len(wanted | g) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=0)
            if best > 0:
                expected[(asked, key)] = max(best, expected.get((asked, key), 0))
    found = QUERIES["x03_word_similarity"](spark, str(tmp_path)).collect()
    assert len(found) == len(expected) and {(r.asked, r.p_partkey): r.similarity for r in found} == pytest.approx(expected, abs=1e-9)
    assert sum(0 < x < 0.3 for x in expected.values()) > 10 and len(expected) > len({a for a, _ in expected})
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert {x[:2]: x[2] for x in con.execute(ORACLES["x03_word_similarity"]).fetchall()} == pytest.approx(expected, abs=1e-9)
