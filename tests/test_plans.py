"""Passages, search blocks, snapshots, claim checks and events on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.operators import events, ranking, snapshots, verification
from tessella.plans import chunking, search


def spans(text, target=20, most=25, **more):
    made = chunking.chunk(text, target, most, **more)
    assert all(text[p.start : p.end] == text[p.start : p.end].strip() and len(text[p.start : p.end].split()) == p.tokens <= most for p in made)
    assert " ".join(text[p.start : p.end] for p in made).split() == text.split()
    return [(text[p.start : p.end].split()[0], p.tokens, p.section) for p in made]


def test_paragraphs_are_gathered_and_headings_begin():
    text = " ".join(["word"] * 32) + "\n\n" + " ".join(["more"] * 12) + "\n\nFACTS\n" + " ".join(["fact"] * 40) + "."
    assert spans(text, 50, 60) == [("word", 44, None), ("FACTS", 41, "FACTS")]
    assert spans(text, 40, 43) == [("word", 32, None), ("more", 13, "FACTS"), ("fact", 40, "FACTS")]  # the heading joins the stray in front of it
    assert spans(text, 40, 44) == [("word", 44, None), ("FACTS", 41, "FACTS")]


def test_unsplittable_words_become_windows():
    assert [n for _, n, _ in spans(" ".join(f"w{i}" for i in range(130)), 50, 50)] == [50, 50, 30]


def test_long_paragraphs_are_cut_at_sentences_first():
    text = "One two three four. Five six seven. Eight nine ten eleven twelve thirteen fourteen. End here."
    assert [w for w, _, _ in spans(text, 7, 7)] == ["One", "Eight", "End"]


def test_sentences_keep_citations_and_abbreviations():
    text = "As held in Mensah v. Owusu. The rule in [2020] XYSC 7 applies. Mr. Addo agreed."
    tokens = chunking.words(text)
    assert [text[a:].split()[0] for a, _ in tokens[chunking.strengths(text, tokens) == chunking.SENTENCE]] == ["The", "Mr."]


def test_paragraph_numbers():
    text = "\n\n".join(f"[{n}] " + " ".join(["word"] * 5) for n in (12, 13, 14))
    assert [p.refs for p in chunking.chunk(text, 350, 400)] == [["12", "13", "14"]]
    numbered = "7. " + " ".join(["word"] * 40) + "\n\n8. short"
    assert [p.refs for p in chunking.chunk(numbered, 350, 400)] == [["7"]]


def test_other_tokenizers():
    import numpy as np

    letters = lambda text: np.array([(i, i + 1) for i, c in enumerate(text) if c.strip()], np.int64).reshape(-1, 2)
    made = chunking.chunk("abcdefghij", 4, 4, letters)
    assert [(p.start, p.end, p.tokens) for p in made] == [(0, 4, 4), (4, 8, 4), (8, 10, 2)]
    # One token more in front of whatever it is given: passages are halved until they fit.
    more = lambda text: np.concatenate([[[0, 0]], chunking.words(text)]).astype(np.int64)
    made = chunking.chunk(" ".join("abcdefghijklmnopqrst"), 10, 10, more)
    assert all(p.tokens <= 10 for p in made) and len(made) > 2 and made[-1].end == 39


def test_pages_give_bounds(spark):
    pages = spark.createDataFrame([(1, i, " ".join([f"page{i}"] * 40)) for i in range(3)], "doc_id long, page int, text string")
    joined = chunking.join_pages(pages)
    made = chunking.with_page_bounds(chunking.chunk_documents(joined, target=40, most=50, keep=("page_starts",)))
    assert [(r.page_start, r.page_end) for r in made.orderBy("ordinal").collect()] == [(0, 0), (1, 1), (2, 2)]
    one = chunking.with_page_bounds(chunking.chunk_documents(joined, keep=("page_starts",))).collect()
    assert [(r.page_start, r.page_end, r.content.count("page")) for r in one] == [(0, 2, 120)]


@pytest.mark.parametrize("line, expected", [("FACTS", True), ("II. THE LAW:", True), ("A. GROUNDS OF APPEAL", True), ("Facts", False), ("FACTS " + "A" * 60, False), ("HELLO", False), ("", False)])
def test_headings(line, expected):
    assert chunking.is_heading(line) is expected


def test_chunks_handle_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.content) for r in chunking.chunk_documents(docs).collect()] == [(4, "a b")]
    with pytest.raises(ValueError):
        chunking.chunk_documents(docs, target=2, most=1)


def test_pages_join_in_order(spark):
    pages = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "")], "doc_id long, page int, text string")
    made = chunking.join_pages(pages).first()
    assert made["text"] == "a\n\n\n\nc" and [tuple(x) for x in made["page_starts"]] == [(0, 0), (1, 3), (2, 5)]


LIST = "qid long, source_text_hash string, content_hash string, chunk_id long, doc_id long, score double, rank long"


def test_fusion_prefers_what_both_lists_name(spark):
    a = spark.createDataFrame([(1, "s", "a", 10, 1, 2.0, 1), (1, "s", "b", 11, 1, 1.0, 2)], LIST)
    b = spark.createDataFrame([(1, "s", "b", 99, 2, 0.9, 1), (1, "s", "c", 12, 1, 0.8, 2)], LIST)
    f = ranking.fuse(a, b, ["source_text_hash", "content_hash"], ["chunk_id", "doc_id"], 60, by=["qid"]).orderBy(F.desc("rrf"), "seen").collect()
    assert [(r.content_hash, r.chunk_id) for r in f] == [("b", 11), ("a", 10), ("c", 12)]


def test_rerank_moves_the_head_only(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.9), (4, 5.0)], "position long, score double")
    assert [r.position for r in ranking.rerank_head(rows, "position", "score", 3).orderBy("final").collect()] == [2, 3, 1, 4]


def test_crowded_case_is_capped(spark):
    passages = spark.createDataFrame([(i, 1, "one", f"h{i}", "apple " * (i + 1)) for i in range(120)] + [(1000 + i, 2 + i, f"s{i}", "x", "apple") for i in range(12)], "chunk_id long, doc_id long, source_text_hash string, content_hash string, content string")
    q = spark.createDataFrame([(1, "Apple")], "qid long, text string")
    found = search.lexical_channel(q, passages).collect()
    assert sum(r.source_text_hash == "one" for r in found) == 3 and len({r.source_text_hash for r in found}) == 13


def test_snapshots_run_twice_is_a_no_op(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    incoming = spark.createDataFrame([(2, "b"), (3, "c"), (1, "z")], "k long, v string")
    once = snapshots.upsert(stored, incoming, ["k"], [F.col("v")], "v")
    twice = snapshots.upsert(once, incoming, ["k"], [F.col("v")], "v")
    assert sorted(map(tuple, once.collect())) == [(1, "z"), (2, "b"), (3, "c")] == sorted(map(tuple, twice.collect()))
    assert tuple(snapshots.change_counts(stored, once, ["k"], "v").first()) == (1, 1, 1, 0)
    assert tuple(snapshots.change_counts(once, twice, ["k"], "v").first()) == (0, 0, 3, 0)


def test_greedy_choice_passes_over_what_does_not_fit(spark):
    row = spark.range(1).select(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("cost")) for n, c in (("a", 50), ("b", 70), ("c", 40), ("d", 5)))).alias("items"))
    assert [x["name"] for x in row.select(verification.choose_within_budget(F.col("items"), 3, 100).alias("x")).first()["x"]] == ["a", "c", "d"]


def test_each_reason_for_removing_a_claim(spark):
    sources = spark.createDataFrame([(1, "S1", "The appeal is hereby dismissed with costs.", "A v B [2020] XYSC 7"), (1, "S2", "Other text of the court entirely.", "C v D [2021] XYSC 8")], "answer_id long, label string, excerpt string, citation string")
    claims = [
        (1, 1, "It was dismissed", ["[s1]"], "appeal is hereby dismissed"), (1, 2, "x", ["S9"], "appeal is hereby dismissed"), (1, 3, "x", ["S1"], "hereby dismissed"),
        (1, 4, "x", ["S2"], "appeal is hereby dismissed"), (1, 5, "see [1999] UKHL 4", ["S1"], "appeal is hereby dismissed"), (1, 6, "see [2020] XYSC 7", ["S2", "S1"], "appeal ... with costs. "), (1, 7, "x", [], "appeal is hereby dismissed"),
    ]
    got = {r.claim_id: r.reason for r in verification.verify_claims(spark.createDataFrame(claims, "answer_id long, claim_id long, text string, labels array<string>, quote string"), sources, 3).collect()}
    assert got == {1: None, 2: "no_valid_source", 3: "quote_too_short", 4: "quote_not_found", 5: "unsupported_reference", 6: None, 7: "no_valid_source"}


def test_lockout_window(spark):
    rows = [(1, datetime(2024, 1, 1, 10, m)) for m in (0, 1, 2, 3, 4, 19, 20)]
    got = [r.recent for r in events.trailing_count(spark.createDataFrame(rows, "user_id long, ts timestamp"), "user_id", "ts", 15).orderBy("ts").collect()]
    assert got == [1, 2, 3, 4, 5, 2, 2]


def test_illegal_steps_and_last_state(spark):
    log = spark.createDataFrame([(1, 1, "draft"), (1, 2, "approved"), (2, 1, "draft"), (2, 2, "retired"), (2, 3, "approved")], "id long, at int, status string")
    assert {(r.id, r.status, r.version) for r in events.last_state(log, "id", ["at"], "status").collect()} == {(1, "approved", 2), (2, "approved", 3)}
    bad = events.illegal_steps(log, "id", ["at"], "status", [("draft", "approved"), ("draft", "retired")]).collect()
    assert [(r.id, r.at) for r in bad] == [(2, 3)]


def test_dense_channel_answers_any_number_of_questions(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3, 5)]) for i in range(40)]
    passages = spark.createDataFrame([(i, i % 11, f"s{i % 11}", f"c{i}", v) for i, v in rows], "chunk_id long, doc_id long, source_text_hash string, content_hash string, vector array<double>")
    questions = spark.createDataFrame(rows[:23], "qid long, vector array<double>")

    def asked(**most):
        return sorted(map(tuple, search.dense_channel(questions, passages, raw=9, limit=5, **most).select("qid", "chunk_id", "score", "rank").collect()))

    whole = asked()
    assert {q for q, *_ in whole} == set(range(23))
    for most in (5, 22, 23):
        assert asked(most_questions=most) == whole


def test_strays_join_a_neighbour_with_room():
    body = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    text = f"FACTS\n\n{body(50, 'a')}\n\nJUDGMENT\n\nTHE LAW:\n\n{body(60, 'b')}\n\nCOSTS\n\nshort end."
    told = lambda t, **o: [(p.section, t[p.start : p.end].split()[0], p.tokens) for p in chunking.chunk(t, **o)]
    assert told(text, target=100, most=120) == [("FACTS", "FACTS", 52), ("THE LAW", "THE", 65)]
    assert told(text, target=100, most=62) == [("FACTS", "FACTS", 52), ("THE LAW", "THE", 62), ("COSTS", "COSTS", 3)]
    # Without room before it, or with a stray before it, the passage behind takes it in and gives the section.
    assert told(f"JUDGMENT\n\nRULING\n\n{text}", target=100, most=60)[0] == ("FACTS", "JUDGMENT", 54)


def test_only_verified_pages_give_bounds(spark):
    pages = spark.createDataFrame([(d, i, " ".join([f"page{i}"] * 40)) for d in (1, 2, 3) for i in range(3)], "doc_id long, page int, text string")
    status = F.when(F.col("doc_id") == 1, "verified").when(F.col("doc_id") == 2, "pending")
    made = chunking.with_page_bounds(chunking.chunk_documents(chunking.join_pages(pages), target=45, most=60, keep=("page_starts",)), status)
    assert {(r.doc_id, r.page_start, r.page_end) for r in made.collect()} == {(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, None, None), (3, None, None)}


def test_long_documents_are_cut_in_linear_time():
    import time

    line = "FACTS\n\n[12] " + " ".join(f"word{i}" for i in range(60)) + ".\n\n"
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        assert len(chunking.chunk(line * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1
