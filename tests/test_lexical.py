"""Question grammar, posting lists and cover density against a plain reading of each passage."""

import random
import re

import pytest

from tessella.functions.english import STOP_WORDS, stem
from tessella.plans import lexical

VOCABULARY = "appeal appeals dismissed dismissing court courts the of costs run running smith jones".split()


def tokens(text, form):
    held = list(enumerate(re.findall("[a-z0-9]+", text.lower()), 1))
    return held if form == "simple" else [(i, stem(w)) for i, w in held if w not in STOP_WORDS]


def alternatives(text, form):
    """Lists of (wanted, excluded); an atom is a tuple of (place, term)."""
    out, own = [], ([], [])
    for tok in re.findall(r'-?"[^"]*"|\S+', text):
        if tok.lower() == "or":
            out, own = [*out, own], ([], [])
            continue
        held = tokens(tok, form)
        atom = tuple((i - held[0][0], w) for i, w in held)
        side = own[tok.startswith("-")]
        if atom and atom not in side:
            side.append(atom)
    return [x for x in [*out, own] if x[0]]


def begins(atom, held):
    return [i for i in range(1, 200) if all(held.get(i + off) == w for off, w in atom)]


def density(places):
    """All stretches with every atom that hold no shorter one."""
    hits = sorted((p, k) for k, own in enumerate(places) for p in own)
    found = set()
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            if {k for _, k in hits[i : j + 1]} == set(range(len(places))):
                found.add((hits[i][0], hits[j][0]))
                break
    least = [c for c in found if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in found)]
    return sum(1 / (1 + max(0, b - a + 1 - len(places))) for a, b in least)


def plain(question, passage, forms):
    total, hit = 0.0, False
    for form in forms:
        held = dict(tokens(passage, form))
        scores = []
        for wanted, excluded in alternatives(question, form):
            places = [begins(a, held) for a in wanted]
            if all(places) and not any(begins(a, held) for a in excluded):
                scores.append(density(places))
        if scores:
            hit, total = True, total + max(scores)
    return round(total, 9) if hit else None


@pytest.mark.parametrize("forms", [("simple",), ("english",), ("simple", "english")])
def test_matching(spark, forms):
    rng = random.Random(len(forms))
    word = lambda: rng.choice(VOCABULARY)
    passages = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 20, 60])))) for i in range(120)] + [(200, None), (201, "Smith-Jones, of THE court")]
    fixed = ['"court of the appeals"', "smith-jones", 'appeal -"costs run"', "appeal or court", "-appeal", "or", '""', "the of", "the", 'costs or "smith jones" or -run', '"the court', "appeal appeal", "appeal -appeal", "unheard", "", 'court "court of"', "OR appeal OR", None]
    made = [*fixed, *(" ".join(rng.choice(["", "", "-"]) + (f'"{word()} {word()}"' if rng.random() < 0.3 else word()) + rng.choice(["", "", " or"]) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(60))]
    q = spark.createDataFrame(list(enumerate(made)), "qid long, text string")
    p = spark.createDataFrame(passages, "chunk_id long, content string").repartition(3)
    expected = {(i, c): s for i, t in enumerate(made) for c, x in passages if (s := plain(t or "", x or "", forms)) is not None}
    found = {(r.qid, r.chunk_id): r.score for r in lexical.matching(q, p, lambda near: near, forms).collect()}
    assert found == pytest.approx(expected) and len(expected) > 500
    # The same by a join where there are too many words to send, and from an index written before.
    if len(forms) == 2:
        for more in ({"most_terms": 3}, {"index": lexical.written(lexical.positional_index(p), "index")}):
            assert {(r.qid, r.chunk_id): r.score for r in lexical.matching(q, p, lambda near: near, forms, **more).collect()} == found


def test_index_has_all_places(spark):
    p = spark.createDataFrame([("a", "The courts, the court"), ("b", None)], "chunk_id string, content string")
    made = {(r.form, r.term): (r.chunk_id, list(r.places)) for r in lexical.positional_index(p).collect()}
    assert made == {("simple", "the"): ("a", [1, 3]), ("simple", "courts"): ("a", [2]), ("simple", "court"): ("a", [4]), ("english", "court"): ("a", [2, 4])}


def test_no_questions_and_no_passages(spark):
    q, p = spark.createDataFrame([(1, "court")], "qid long, text string"), spark.createDataFrame([(1, "court")], "chunk_id long, content string")
    assert lexical.matching(q.where("false"), p, lambda near: near).count() == 0 == lexical.matching(q, p.where("false"), lambda near: near).count()


def test_posting_lists_stay_in_a_task(spark):
    q = spark.createDataFrame([(1, 'court -"the costs"'), (2, "smith or jones run")], "qid long, text string")
    p = spark.createDataFrame([(i, x) for i, x in enumerate(["The court", "court of the costs", "Jones, run", "SMITH"])], "chunk_id long, content string").repartition(2)
    made = lexical.matching(q, p, lambda near: near, ("simple",), keys=p.select("chunk_id"))
    assert {(r.qid, r.chunk_id): r.score for r in made.collect()} == {(1, 0): 1.0, (2, 2): 1.0, (2, 3): 1.0}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_repeated_ids_match_as_by_joins(spark):
    q = spark.createDataFrame([(1, "court"), (2, "court costs")], "qid long, text string")
    p = spark.createDataFrame([(1, "the court"), (2, "court"), (2, "court"), (3, "court"), (3, "costs"), (None, "court costs")], "chunk_id long, content string")
    by_joins = lexical.matching(q, p, lambda near: near, ("simple",), most_terms=-1)
    found = sorted(map(tuple, lexical.matching(q, p, lambda near: near, ("simple",)).collect()))
    assert found == sorted(map(tuple, by_joins.collect())) == [(1, 1, 1.0), (1, 3, 1.0), (2, 3, 1.0)]


def test_all_words_are_counted_where_a_passage_is(spark):
    q = spark.createDataFrame([(1, "the Court"), (2, "court costs court"), (3, "!"), (4, None), (5, "costs"), (5, "costs"), (6, "smith run")], "qid long, text string")
    p = spark.createDataFrame([(1, "the court, the COSTS"), (2, "court"), (3, "court"), (3, "the costs"), (None, "the court"), (4, None), (5, "")], "chunk_id long, content string").repartition(3)
    by_joins = lexical.with_all_words(q, p, most_terms=-1)
    found = lexical.with_all_words(q, p)
    assert found.schema["hits"].dataType.simpleString() == by_joins.schema["hits"].dataType.simpleString() == "bigint"
    rows = {tuple(r) for r in found.collect()}
    assert rows == {tuple(r) for r in by_joins.collect()} == {(1, 1, 3), (2, 1, 2), (5, 1, 2), (1, 3, 2), (2, 3, 2), (5, 3, 2), (1, None, 2)}
    assert found.count() == len(rows)
    once = lexical.with_all_words(q.where("qid <> 5"), p.where("chunk_id <> 3"))
    assert {tuple(r) for r in once.collect()} == {(1, 1, 3), (2, 1, 2)}
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
