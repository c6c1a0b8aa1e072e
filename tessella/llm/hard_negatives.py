"""Hard negatives by exact inner products of whole numbers, several candidates in each multiplication.

Candidates' components are biased so that none is negative, and the same component of several candidates stands in
separated fields of one wide integer. One multiplication by an anchor's component, summed over the components, makes
the sums of all fields at once; they are cut out again and the bias is taken off. Nothing is rounded. The integers are
carried by doubles, exact to 2**53, where two fields fit (there matrix products are fastest), by 64-bit integers where
two fit there, and by integers of any width otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .order import numbered

#: Fields of an integer of any width; anchors and candidates of one product.
FIELDS, ROWS, COLUMNS = 32, 256, 8192
NONE = np.iinfo(np.int64).min


class Packed:
    """Rows of whole numbers as factors of packed products with anchors whose absolute values sum up to at most reach."""

    def __init__(self, values: np.ndarray, low: int, high: int, reach: int) -> None:
        self.bias, self.count = -min(low, 0), len(values)
        self.width = 1 + (reach * (max(high, 0) + self.bias)).bit_length()
        self.kind, self.fields = next(((k, room // self.width) for k, room in ((np.float64, 53), (np.int64, 63)) if room // self.width > 1), (object, FIELDS))
        padded = np.zeros((-(-len(values) // self.fields) * self.fields, values.shape[1]), object if self.kind is object else np.int64)
        padded[: len(values)] = values + self.bias
        fields = padded.reshape(-1, self.fields, values.shape[1])
        self.words = sum(fields[:, f] * (1 << self.width * f) for f in range(self.fields)).astype(self.kind).T

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of each anchor (rows) with each candidate (columns)."""
        sums = anchors.astype(self.kind) @ self.words
        half, mask = 1 << self.width - 1, (1 << self.width) - 1
        sums = sums.astype(object if self.kind is object else np.int64) + sum(half << self.width * f for f in range(self.fields))
        out = np.stack([sums >> self.width * f & mask for f in range(self.fields)], axis=2).reshape(len(anchors), -1)[:, : self.count]
        return (out - half - self.bias * anchors.astype(out.dtype).sum(axis=1)[:, None]).astype(np.int64)


class Best:
    """The first k candidates of each line: higher scores first, ties by smaller id."""

    def __init__(self, lines: int, k: int) -> None:
        self.k = k
        self.scores = np.full((lines, k), NONE)
        self.ids = np.full((lines, k), np.iinfo(np.int64).max)

    def offer(self, lines: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        last, least = self.scores[lines, -1][:, None], self.ids[lines, -1][:, None]
        row, column = np.nonzero(allowed & ((scores > last) | (scores == last) & (ids < least)))
        if not len(row):
            return
        touched = np.unique(row)
        line = np.concatenate([lines[row], np.repeat(lines[touched], self.k)])
        score = np.concatenate([scores[row, column], self.scores[lines[touched]].ravel()])
        found = np.concatenate([ids[column], self.ids[lines[touched]].ravel()])
        order = np.lexsort((found, -(score + 1), line))  # NONE + 1, unlike NONE, can be negated
        line, score, found = line[order], score[order], found[order]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        keep = place < self.k
        self.scores[line[keep], place[keep]], self.ids[line[keep], place[keep]] = score[keep], found[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line, place = np.nonzero(self.scores != NONE)
        return line, self.ids[line, place], self.scores[line, place]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of one width; what is missing at the end is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few candidates at first, so that most of the many that follow fall short of what is held."""
    most = 128
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, most)
            at, most = at + most, min(COLUMNS, 4 * most)


def scored(held: dict, width: int, low: int, high: int) -> Callable:
    """For each slice of anchors and each piece of candidates: the anchors' numbers, ids, labels and products."""
    anchors, reach = held["values"], int(np.abs(held["values"]).sum(axis=1).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in pieces(batches):
            ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            packed = Packed(matrix(batch.column("vector"), width), low, high, reach)
            for at in range(0, len(anchors), ROWS):
                part = np.arange(at, min(at + ROWS, len(anchors)))
                yield part, ids, labels, packed.products(anchors[part])

    return run


def nearest_of_label(shared, width: int, low: int, high: int, k: int):
    """(anchor, id, score): the best other rows of the anchor's own label, among those of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        best = Best(len(held["ids"]), k)
        for part, ids, labels, scores in scored(held, width, low, high)(batches):
            best.offer(part, scores, ids, (labels == held["labels"][part, None]) & (ids != held["ids"][part, None]))
        line, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(held["ids"][line]), pa.array(ids), pa.array(scores)], ["anchor_id", "positive_id", "positive_score"])

    return run


def band_of_others(shared, width: int, low: int, high: int, k: int):
    """(anchor, positive, id, score): the best rows of other labels inside the band of each positive, among those of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        positives = held["positives"].shape[1]
        best = Best(len(held["ids"]) * positives, k)
        for part, ids, labels, scores in scored(held, width, low, high)(batches):
            other = labels != held["labels"][part, None]
            for p in range(positives):
                inside = (scores >= held["least"][part, p, None]) & (scores <= held["most"][part, p, None])
                best.offer(part * positives + p, scores, ids, other & inside)
        line, ids, scores = best.rows()
        a, p = np.divmod(line, positives)
        yield pa.RecordBatch.from_arrays([pa.array(held["ids"][a]), pa.array(held["positives"][a, p]), pa.array(held["scores"][a, p]), pa.array(ids), pa.array(scores)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector) of the rows that take part, one for each id."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(finite, F.transform(x, lambda v: F.floor(scale * v))).alias("vector"))
    return rows.where("id is not null and label is not null and vector is not null").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, slab_bytes: int = 32 << 20) -> DataFrame:
    """Per anchor and positive, its hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are floor(scale * x) of the doubles x, a score is the inner product of two rows of them; higher scores
    come first, ties by smaller id. anchors is a condition on id and label. An anchor's positives are its first other
    rows of the same label. Its negatives for a positive are the first rows of other labels whose score is from
    band[0] to band[1] percent of the positive's. All rows are searched for all anchors.

    Rows without an id, a label or a vector and rows with a null or non-finite component take no part. Of rows that
    repeat an id the one with the smallest label, then vector, takes part. Shorter vectors count as filled up with
    zeros. Anchors without a positive or a negative give no rows, and so does an empty table. Other columns are ignored.
    A score must fit 64 bits, which is checked by bounds before anything is multiplied.

    Anchors are taken in slabs of at most slab_bytes, numbered without a sort in one task; a slab is sent to all tasks
    and meets every row twice, for the positives and, when their scores are known, for the negatives. A task keeps k
    candidates a line, whatever it reads, and returns those; the best of all tasks are found by a rank limit in Spark.
    The number of slabs, and the work of each, grows with the input.
    """
    rows = materialize(whole_numbers(vectors, id_col, vector_col, label_col, scale), "negatives-rows")
    parts = F.transform("vector", lambda v: F.abs(v.cast("double")))
    width, low, high, reach = rows.agg(F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.max(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v))).first()
    low, high, width = low or 0, high or 0, width or 0
    if (reach or 0) * max(-low, high) >= 2**62:
        raise ValueError("scores of these vectors may not fit 64 bits; take a smaller scale")
    asked = numbered(rows.where(anchors), [], ["label", "id"], "negatives-order")
    each = max(1, slab_bytes // (8 * (width + 6 * positives + 2)))
    count, made, spark = asked.count(), [], vectors.sparkSession
    first = lambda by, order, k: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), order.replace("score", "id"))) <= k
    kinds = "anchor_id long, positive_id long, positive_score long"
    for at in range(0, count, each):
        slab = asked.where((F.col("at") >= at) & (F.col("at") < at + each)).select("id", "label", "vector").toArrow()
        held = {"ids": slab["id"].to_numpy(), "labels": slab["label"].to_numpy(), "values": matrix(slab["vector"].combine_chunks(), width)}
        shared = spark.sparkContext.broadcast(held)
        near = rows.mapInArrow(nearest_of_label(shared, width, low, high, positives), kinds)
        near = near.withColumn("kept", first(["anchor_id"], "positive_score", positives)).where("kept").drop("kept").toArrow()
        line = dict(zip(held["ids"].tolist(), range(len(held["ids"]))))
        held |= {n: np.zeros((len(line), positives), np.int64) for n in ("positives", "scores")}
        held |= {"least": np.ones((len(line), positives), np.int64), "most": np.zeros((len(line), positives), np.int64)}  # an empty band
        used = dict.fromkeys(line, 0)
        for a, p, score in zip(*(near[c].to_pylist() for c in ("anchor_id", "positive_id", "positive_score"))):
            i, j = line[a], used[a]
            used[a] += 1
            held["positives"][i, j], held["scores"][i, j], held["least"][i, j], held["most"][i, j] = p, score, -(-band[0] * score // 100), band[1] * score // 100
        shared.unpersist()
        shared = spark.sparkContext.broadcast(held)
        found = rows.mapInArrow(band_of_others(shared, width, low, high, negatives), f"{kinds}, negative_id long, negative_score long")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
        made.append(materialize(found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-found"))
        shared.unpersist()
    discard(rows, asked)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for part in made:
        out = out.union(part)
    return out
