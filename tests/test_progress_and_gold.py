"""Event order, closed-schema lines, gold import and the pair scorer on known answers."""

import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import gold_import, sequences
from tessella.plans import pair_scorer
from tessella.sources import jsonl


def plain(kinds):
    stages, out, reached, sourced, ended = ["a", "b", "c"], {}, 0, False, False
    for i, k in enumerate(kinds):
        stage = stages.index(k) + 1 if k in stages else 0
        final = k in ("answer", "error")
        if not (stage or final or k == "sources"):
            out[i] = "unknown_kind"
        elif final and ended:
            out[i] = "second_final"
        elif ended:
            out[i] = "after_final"
        elif k == "sources" and sourced:
            out[i] = "sources_twice"
        elif stage and sourced:
            out[i] = "stage_after_sources"
        elif stage and stage < reached:
            out[i] = "stage_back"
        elif i == len(kinds) - 1 and not final:
            out[i] = "no_final"
        reached, sourced, ended = max(reached, stage), sourced or k == "sources", ended or final
    return out


def test_every_violation_is_named(spark):
    rng = random.Random(8)
    runs = [["a", "a", "b", "c", "sources", "answer"], ["a", "sources", "error"], ["answer"], ["a"], ["a", None, "answer"]]
    runs += [[rng.choice(["a", "a", "b", "b", "c", "sources", "answer", "error", "other"]) for _ in range(rng.choice([1, 2, 4, 7]))] for _ in range(150)]
    rows = [(r, i, k) for r, own in enumerate(runs) for i, k in enumerate(own)]
    made = sequences.violations(spark.createDataFrame(rows, "run long, seq long, kind string").repartition(4), ["run"], ["seq"], "kind", ["a", "b", "c"]).collect()
    expected = {(r, i): v for r, own in enumerate(runs) for i, v in plain(own).items()}
    assert {(x.run, x.seq): x.violation for x in made} == expected
    assert set(expected.values()) == {"unknown_kind", "second_final", "after_final", "sources_twice", "stage_after_sources", "stage_back", "no_final"}
    assert not {k for k in expected if k[0] < 3}


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("question", T.StringType()), T.StructField("uris", T.ArrayType(T.StringType()))])


def test_bad_lines_are_named_and_numbered(spark, tmp_path):
    lines = ['{"id": 1, "question": "q", "uris": ["a"]}', "", "{broken", "[1]", '"text"', '{"id": "x", "question": "q"}', '{"id": 2, "question": null}', '{"id": 3, "question": "q", "z": 1, "b": 2}', " \t ", '{"id": 4, "question": "ü"}', "null", '{"id": 5, "question": 7, "uris": "no"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(f'{{"id": {i}, "question": "{"w" * 50}"}}' for i in range(3000)) + "\nbad\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        made = jsonl.read_closed(spark, str(tmp_path / "in"), SCHEMA, ("id", "question")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {r.line: r for r in made if r.file.endswith("a.jsonl")}
    assert {k: r.problems for k, r in first.items() if r.problems} == {3: ["not_json"], 4: ["not_an_object"], 5: ["not_an_object"], 6: ["wrong_type:id"], 7: ["missing:question"], 8: ["unknown:b", "unknown:z"], 11: ["not_an_object"], 12: ["wrong_type:uris"]}
    assert first[1].record.uris == ["a"] and first[10].record.question == "ü" and first[1].value is None and first[3].value == "{broken" and first[3].record is None
    second = {r.line: r for r in made if r.file.endswith("b.jsonl")}
    assert all(second[i + 1].record.id == i for i in range(3000)) and second[3001].problems == ["not_json"] and len(second) == 3001


def test_a_second_import_changes_nothing(spark):
    stored = spark.createDataFrame([(1, 3, "approved", "a?", 2000, ["u"]), (2, 1, "draft", "b?", None, ["v"]), (3, 1, "draft", "c?", 5, None)], "id long, version int, status string, question string, year int, gold array<string>")
    history = spark.createDataFrame([(1, 1, "2023", "question", None, "a?")], "id long, version int, at string, field string, old string, new string")
    incoming = spark.createDataFrame([(1, "a?", 2001, ["u", "w"]), (2, "b?", None, ["v"]), (4, "new?", None, []), (4, "new?", None, [])], "id long, question string, year int, gold array<string>")
    fields = ["question", "year", "gold"]
    state, grown, told = gold_import.import_items(stored, history, incoming, "id", fields, "2024")
    assert {r.id: (r.version, r.status, r.question, r.year, r.gold) for r in state.collect()} == {1: (4, "draft", "a?", 2001, ["u", "w"]), 2: (1, "draft", "b?", None, ["v"]), 3: (1, "draft", "c?", 5, None), 4: (1, "draft", "new?", None, [])}
    assert {(r.id, r.version, r.field, r.old, r.new) for r in grown.where("at = '2024'").collect()} == {(1, 4, "year", "2000", "2001"), (1, 4, "gold", '["u"]', '["u","w"]'), (4, 1, "question", None, "new?"), (4, 1, "gold", None, "[]")}
    assert {r.id: r.change for r in told.collect()} == {1: "changed", 2: "unchanged", 4: "new"}
    again = gold_import.import_items(state, grown, incoming, "id", fields, "2025")
    assert sorted(map(str, again[0].collect())) == sorted(map(str, state.collect())) and again[1].count() == grown.count()
    assert {r.change for r in again[2].collect()} == {"unchanged"}


def test_fitted_scorer_tells_answers_from_others(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(60)}"
    pairs = []
    for i in range(300):
        q = [word() for _ in range(4)]
        other = [word() for _ in range(20)]
        pairs.append((" ".join(q), " ".join(other[:8] + q + other[8:]) if i % 2 else " ".join(rng.sample(q, 2) + other), i % 2))
    weights = pair_scorer.fit(spark.createDataFrame(pairs, "question string, passage string, label int"))
    assert np.isfinite(weights).all() and weights[2] > 0
    head = spark.createDataFrame([(i, q, p) for i, (q, p, _) in enumerate(pairs)] + [(999, None, None)], "qid long, text string, content string")
    made = {r.qid: r.rerank for r in pair_scorer.with_scores(head, weights).collect()}
    right = np.mean([(made[i] > 0.5) == bool(label) for i, (*_, label) in enumerate(pairs)])
    assert right > 0.95 and 0 <= made[999] <= 1
    # Its order isn't that of word overlap: what counts is that the words stand together.
    q = "w1 w2 w3"
    two = spark.createDataFrame([(1, q, "w1 w2 w3 x x x x x"), (2, q, "w3 x w1 x w2")], "qid long, text string, content string")
    from tessella.plans import search

    overlap = {r.qid: r.o for r in two.select("qid", search.overlap_score(F.col("text"), F.col("content")).alias("o")).collect()}
    fitted = {r.qid: r.rerank for r in pair_scorer.with_scores(two, weights).collect()}
    assert overlap[2] > overlap[1] and fitted[1] > fitted[2]


def test_sheets_come_back_as_they_were(spark, tmp_path):
    import pytest

    from tessella.sources import sheets

    texts = ['say "it", then\nmore', "", None, "  plain ", "ü,;'", '"', "a\\b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, question string")
    sheets.write_sheet(rows.repartition(3), sheets.QUERY_COLUMNS, str(tmp_path / "s"))
    back = {r.id: r for r in sheets.read_sheet(spark, str(tmp_path / "s"), sheets.QUERY_COLUMNS).collect()}
    assert {int(k): r.question for k, r in back.items()} == {i: (t or "").strip(" ") for i, t in enumerate(texts)} and {r.keyword_query for r in back.values()} == {""}
    with pytest.raises(ValueError, match="keyword_query, notes"):
        sheets.read_sheet(spark, str(tmp_path / "s"), ["id", "category", "question", "filters", "notes"])


def test_named_case_and_opened_source(spark):
    from tessella.operators import verification as ver

    row = spark.sql("select array(named_struct('turn', 1, 'passages', array('a', 'b', 'c', 'd')), named_struct('turn', 2, 'passages', array('e', 'f', 'g')), named_struct('turn', 3, 'passages', array('h'))) as cases")
    assert row.select(ver.offered(F.col("cases"), named=F.lit(True)).alias("x")).first().x == ["a", "c", "d", "e", "f", "h"]
    assert row.select(ver.offered(F.col("cases")).alias("x")).first().x == ["a", "b", "e", "f", "h"]
    rows = spark.createDataFrame([(1, "q", None, ["a"]), (2, "q", 1, None), (3, "q", 1, ["x", "q"]), (4, "q", 1, ["x", "y"]), (5, "q", 1, []), (6, "q", 1, ["x", None])], "id int, quote string, marker int, passages array<string>")
    made = {r.id: tuple(r.x) for r in rows.select("id", ver.opened(F.col("quote"), F.col("marker"), F.col("passages")).alias("x")).collect()}
    assert made == {1: ("q", True), 2: ("q", True), 3: ("q", True), 4: ("x", False), 5: ("q", True), 6: ("x", False)}


def test_run_record_has_settings_metrics_and_questions(spark):
    from tessella.operators import evaluation

    questions = spark.createDataFrame([(1, "a", 3), (2, "a", None)], "id long, category string, rank int")
    metrics = questions.groupBy("category").agg(F.count("rank").alias("found"))
    made = {(r.part, r.key): r.value for r in evaluation.run_record("r", {"b": 1, "a": "x"}, metrics, "category", questions, "id").collect()}
    assert made == {("config", "settings"): '{"a":"x","b":1}', ("metrics", "a"): '{"found":1}', ("question", "1"): '{"category":"a","rank":3}', ("question", "2"): '{"category":"a"}'}
    p = spark.createDataFrame([(1, "h"), (2, "k")], "doc_id long, content_hash string")
    one, other = (evaluation.run_config(x, {"a": 1}).first() for x in (p.repartition(2), p.where("doc_id = 1")))
    assert one == evaluation.run_config(p.orderBy(F.desc("doc_id")), {"a": 1}).first() and one.config_hash != other.config_hash
