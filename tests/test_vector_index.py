"""The inverted file against brute force."""

import numpy as np
import pytest

from tessella.plans import vector_index as V


def made(spark, rows):
    return spark.createDataFrame([(i, v.tolist() if v is not None else None) for i, v in rows], "id long, vector array<double>").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(25, 16))
    v = centers[rng.integers(0, 25, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    v[:1000] = v[0]  # a third of all rows are copies
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def exact(v, q, k):
    return [sorted(range(len(v)), key=lambda i: (-round(float(v[i] @ x), 9), i))[:k] for x in q]


def test_recall_and_exact_way(spark, vectors):
    held = made(spark, list(enumerate(vectors)) + [(9000, None)])
    index = V.build(held, sample_rows=1500, lists=40)
    assert index.measured >= 0.97 and 1 <= index.probes < 40
    assert index.rows.count() == 3000 and index.rows.select("list").distinct().count() > 20
    ids = list(range(1001, 3000, 40))
    asked = made(spark, [(i, vectors[i]) for i in ids]).withColumnRenamed("id", "qid")
    expected = exact(vectors, vectors[ids], 10)
    for most in (7, 1000):
        found = V.nearest(asked, index, 10, most_questions=most).collect()
        own = {i: [r.id for r in sorted((r for r in found if r.qid == i), key=lambda r: r["rank"])] for i in ids}
        assert np.mean([len(set(own[i]) & set(e)) / 10 for i, e in zip(ids, expected)]) >= 0.9
    whole = V.nearest(asked, index, 10, probes=40).collect()
    for i, e in zip(ids, expected):
        assert [r.id for r in sorted((r for r in whole if r.qid == i), key=lambda r: r["rank"])] == e


def test_ties_take_the_smaller_id(spark, vectors):
    index = V.build(made(spark, enumerate(vectors)), sample_rows=500, lists=8)
    asked = made(spark, [(0, vectors[0])]).withColumnRenamed("id", "qid")
    assert [r.id for r in V.nearest(asked, index, 5, probes=8).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_recall_counts_what_is_missing(spark):
    f = spark.createDataFrame([(1, 10), (1, 11), (2, 99)], "qid long, id long")
    e = spark.createDataFrame([(1, 10), (1, 12), (2, 20)], "qid long, id long")
    assert {r.qid: r.recall for r in V.recall_of(f, e).collect()} == {1: 0.5, 2: 0.0}


def test_nothing_to_index(spark):
    assert V.build(made(spark, [(1, np.ones(2))]).where("false")) is None
    index = V.build(made(spark, [(1, np.ones(2)), (2, -np.ones(2))]))
    assert [r.id for r in V.nearest(made(spark, [(5, np.ones(2))]).withColumnRenamed("id", "qid"), index, 1).collect()] == [1]
