"""A fitted scorer of question and passage, in the place of a reranking model: few weights, batches through Arrow, the head only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: One, the share of the question's words found, the share of its neighbouring pairs, the share of the passage's words asked for, the logarithm of its length.
FEATURES = 5


def features(question: str | None, passage: str | None) -> tuple[float, ...]:
    asked, held = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (question, passage))
    wanted, pairs, found = set(asked), set(zip(asked, asked[1:])), set(held)
    return (
        1.0,
        len(wanted & found) / len(wanted) if wanted else 0.0,
        len(pairs & set(zip(held, held[1:]))) / len(pairs) if pairs else 0.0,
        sum(w in wanted for w in held) / len(held) if held else 0.0,
        float(np.log1p(len(held))),
    )


def probability(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))


def fit(pairs: DataFrame, most_pairs: int = 20_000, rounds: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on pairs(question, passage, label 0 or 1), by Newton's steps; the first most_pairs rows by hash are learned."""
    from pyspark.sql import functions as F

    rows = pairs.where("label is not null").orderBy(F.xxhash64("question", "passage"), "question", "passage").limit(most_pairs).select("question", "passage", "label").collect()
    x, y = np.array([features(r["question"], r["passage"]) for r in rows]), np.array([float(r["label"]) for r in rows])
    w = np.zeros(FEATURES)
    for _ in range(rounds):
        p = probability(x, w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES), x.T @ (p - y) + ridge * w)
    return w


def scored(shared, question: str, passage: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                rows = np.array([features(a, b) for a, b in zip(batch.column(question).to_pylist(), batch.column(passage).to_pylist())])
                keep = [n for n in batch.schema.names if n not in (question, passage)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(np.round(probability(rows, shared.value), 9))], [*keep, "rerank"])

    return run


def with_scores(head: DataFrame, weights: np.ndarray, question: str = "text", passage: str = "content") -> DataFrame:
    """rerank, a probability with nine decimals, in the place of a head's question and passage; the weights are broadcast, the head is what a reranker sees."""
    kept = [f for f in head.schema if f.name not in (question, passage)]
    shared = head.sparkSession.sparkContext.broadcast(np.asarray(weights, float))
    return head.mapInArrow(scored(shared, question, passage), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "rerank double"]))
