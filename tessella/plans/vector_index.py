"""An inverted file of vectors: approximate nearest neighbours that read a few lists of an index instead of all rows.

Centroids are fitted on a bounded sample; every row is in the list of its nearest centroid. A question reads the lists
of its nearest centroids. How many are needed for a wanted recall is measured on the sample when the index is made.
search.dense_channel is the exact way beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..session import shared_path

#: Rows and questions of one matrix product.
ROWS, ASKED = 4096, 512


@dataclass(frozen=True)
class Index:
    """rows: id, vector and list, a folder for each list; probes: how many lists a question reads; measured: the recall of the sample."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    measured: float


def closest(vectors: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of each vector by Euclidean distance, nearest first."""
    far = (centroids * centroids).sum(axis=1) - 2 * (vectors @ centroids.T)
    n = min(n, len(centroids))
    some = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable"), axis=1)


def fitted(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Lloyd's centroids of a sample; an empty one moves to the vector that is farthest from its own."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = closest(sample, centroids)[:, 0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        some = counts > 0
        centroids[some] = sums[some] / counts[some, None]
        if not some.all():
            away = ((sample - centroids[own]) ** 2).sum(axis=1)
            centroids[~some] = sample[np.argsort(-away)[: (~some).sum()]]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 500) -> tuple[int, float]:
    """The fewest lists that hold the wanted share of the k largest products among the sample, and that share."""
    rows = sample[np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)]
    sims = rows @ sample.T
    k = min(k, len(sample))
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.empty((len(rows), len(centroids)), np.int64)
    np.put_along_axis(place, closest(rows, centroids, len(centroids)), np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, closest(sample, centroids)[:, 0][best], axis=1), axis=None)
    probes = int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1
    return probes, float((needed < probes).mean())


def listed(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                v = np.array(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(closest(v, centroids)[:, 0].astype(np.int32))], [*batch.schema.names, "list"])

    return run


def build(rows: DataFrame, sample_rows: int = 20_000, lists: int | None = None, recall: float = 0.97, k: int = 10, rounds: int = 8) -> Index | None:
    """rows(id long, vector array<double>) of one width; null vectors are not in the index. None for no rows.

    The sample is the sample_rows rows of smallest hash of the id, so at most those reach the driver; lists is by
    default the root of the number of rows, 8 at least and 4,096 at most. Rows are assigned where they are and written
    by list: a list with very many rows is many files, none is one task's.
    """
    spark, rows = rows.sparkSession, rows.where("id is not null and vector is not null")
    count, space = rows.count(), 1 << 30
    if not count:
        return None
    # Few more than are wanted by a share of the hashes first, so that no task sorts more than those.
    share = min(space, space * (sample_rows + 4 * int(sample_rows**0.5) + 4) // count)
    hashed = rows.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(space)))
    sample = hashed.where(F.col("hash") < share).orderBy("hash", "id").limit(sample_rows).select("vector").toArrow()
    held = np.array(sample["vector"].combine_chunks().flatten(), np.float64).reshape(sample.num_rows, -1)
    wanted = lists or int(min(4096, max(8, count**0.5)))
    centroids = fitted(held, wanted, rounds)
    probes, measured = probes_for(held, centroids, k, recall)
    made = rows.select("id", "vector").mapInArrow(listed(centroids), "id long, vector array<double>, list int")
    path = shared_path(spark, "vector-lists")
    # Rows of a list meet before they are written, a large list in several tasks: few files, and no task with a whole hot list.
    made.hint("rebalance", "list").write.partitionBy("list").parquet(path)
    return Index(spark.read.schema("id long, vector array<double>, list int").parquet(path), centroids, probes, measured)


def list_top(shared, k: int) -> Callable:
    """(qid, id, score): the best k of each question among this task's rows of the lists that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, reads = shared.value
        tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        readers = {int(x): np.flatnonzero((reads == x).any(axis=1)) for x in np.unique(reads)}
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                held = np.array(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1)
                ids, own = batch.column("id").to_numpy(), batch.column("list").to_numpy()
                for x in np.unique(own).tolist():
                    at = np.flatnonzero(own == x)
                    for part in (readers[x][i : i + ASKED] for i in range(0, len(readers.get(x, ())), ASKED)):
                        sims = np.round(vectors[part] @ held[at].T, 9)
                        for j, line in zip(part.tolist(), sims):
                            old = tops.get(j, (np.zeros(0), np.zeros(0, np.int64)))
                            keep = np.flatnonzero(line >= old[0][-1]) if len(old[0]) == k else slice(None)
                            scores, found = np.concatenate([old[0], line[keep]]), np.concatenate([old[1], ids[at][keep]])
                            order = np.lexsort((found, -scores))[:k]
                            tops[j] = scores[order], found[order]
        for j, (scores, found) in tops.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), qids[j])), pa.array(found), pa.array(scores)], ["qid", "id", "score"])

    return run


def nearest(questions: DataFrame, index: Index, k: int = 10, probes: int | None = None, most_questions: int = 2_000) -> DataFrame:
    """(qid, id, score, rank): of each question(qid, vector) the k rows of largest inner product in the lists it reads.

    Any number of questions, most_questions in each pass; a pass reads only the folders of its questions' lists, and its
    tops are written. With probes as the number of lists the answer is exact.
    """
    spark, out = questions.sparkSession, shared_path(questions.sparkSession, "vector-tops")
    schema = "qid long, id long, score double, rank long"
    spark.createDataFrame([], schema).write.parquet(out)
    asked = questions.where("vector is not null").select("qid", "vector").toLocalIterator(prefetchPartitions=True)
    waiting: list = []

    def answer(part: list) -> None:
        vectors = np.array([r["vector"] for r in part], np.float64)
        reads = closest(vectors, index.centroids, probes or index.probes)
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in part], np.int64), vectors, reads))
        rows = index.rows.where(F.col("list").isin([int(x) for x in np.unique(reads)]))
        near = rows.mapInArrow(list_top(shared, k), "qid long, id long, score double")
        ranked(near, [F.desc("score"), F.col("id")], k, by=["qid"]).select("qid", "id", "score", F.col("rank").cast("long")).write.mode("append").parquet(out)
        shared.unpersist()

    for row in asked:
        waiting.append(row)
        if len(waiting) == most_questions:
            answer(waiting)
            waiting = []
    if waiting:
        answer(waiting)
    return spark.read.schema(schema).parquet(out)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, recall): the share of exact(qid, id) that found has."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    return both.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
