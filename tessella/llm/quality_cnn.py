"""A byte-level convolutional network in numpy that scores documents for quality.

Bytes become small learned vectors, learned filters slide over overlapping chunks that cover the whole document, each
filter's largest answer in a chunk is kept, and the means and maxima over the chunks make one probability. The network
is fitted on the driver on a bounded sample of labelled rows; tasks score whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

CHUNK, OVERLAP = 512, 16
VECTOR, WIDTH, STEP, FILTERS, HIDDEN = 8, 8, 2, 32, 16
#: Code of the filling behind a text's end; bytes keep their own value, 0 included.
FILL = 256


def chunks(text: bytes) -> np.ndarray:
    """(chunks, CHUNK) codes; neighbours share OVERLAP bytes, so each place a filter can lie is in some chunk."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(text) - OVERLAP) // step))
    codes = np.full(n * step + OVERLAP, FILL, np.int16)
    codes[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(codes, CHUNK)[::step]


@dataclass
class Network:
    vectors: np.ndarray  # (257, VECTOR)
    filters: np.ndarray  # (WIDTH * VECTOR, FILTERS)
    shift: np.ndarray
    dense: np.ndarray  # (2 * FILTERS, HIDDEN)
    dense_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
        return cls(f(FILL + 1, VECTOR, scale=0.5), f(WIDTH * VECTOR, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32), f(2 * FILTERS, HIDDEN, scale=0.25), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.25), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * VECTOR): what the filters see."""
        x = self.vectors[codes].reshape(len(codes), CHUNK * VECTOR)
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * VECTOR, axis=1)[:, :: STEP * VECTOR]

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): each filter's largest answer in a chunk."""
        out = []
        for part in (codes[i : i + 64] for i in range(0, len(codes), 64)):
            w = self.windows(part)
            out.append((w.reshape(-1, WIDTH * VECTOR) @ self.filters).reshape(len(part), w.shape[1], FILTERS).max(axis=1))
        return np.maximum(np.concatenate(out) + self.shift, 0)

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS) twice: the place of each filter's largest answer in a chunk, and that answer without shift."""
        w = self.windows(codes)
        answers = (w.reshape(-1, WIDTH * VECTOR) @ self.filters).reshape(len(codes), w.shape[1], FILTERS)
        place = answers.argmax(axis=1)
        return place, np.take_along_axis(answers, place[:, None], axis=1)[:, 0]

    def scores(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One probability for each document; starts: its first chunk."""
        features = self.features(pooled, starts)
        hidden = np.maximum(features @ self.dense + self.dense_shift, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_shift, -30, 30)))

    @staticmethod
    def features(pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(starts, append=len(pooled))[:, None]
        return np.concatenate([np.add.reduceat(pooled, starts) / n, np.maximum.reduceat(pooled, starts)], axis=1)


def fit(samples: list[tuple[bytes, int]], epochs: int = 10, rate: float = 3e-3, seed: int = 7) -> Network:
    """Adam on the cross-entropy, over all chunks of each text, as in scoring. Both labels weigh the same in all."""
    net = Network.new(seed)
    r = np.random.default_rng(seed)
    if len({label for _, label in samples}) < 2:
        # Nothing to tell apart: the only label's probability, or one half without any.
        net.out[:] = 0
        net.out_shift[:] = 0 if not samples else 4 if samples[0][1] else -4
        return net
    share = np.bincount([label for _, label in samples], minlength=2) / len(samples)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(samples))
        for at in range(0, len(order), 32):
            rows = [(chunks(text), label) for text, label in (samples[i] for i in order[at : at + 32])]
            codes, labels = np.concatenate([c for c, _ in rows]), np.array([y for _, y in rows], np.float32)
            starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])[:-1]])
            sizes = np.diff(starts, append=len(codes))
            # In slices, of which only each filter's best place stays, so that a long text takes little more memory.
            found = [net.best(codes[i : i + 64]) for i in range(0, len(codes), 64)]
            best, raw = (np.concatenate(x) for x in zip(*found))
            raw += net.shift
            pooled = np.maximum(raw, 0)
            features = net.features(pooled, starts)
            hidden_raw = features @ net.dense + net.dense_shift
            hidden = np.maximum(hidden_raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_shift, -30, 30)))
            d = ((p - labels) / (2 * share[labels.astype(int)] * len(rows))).astype(np.float32)
            g_out, g_out_shift = hidden.T @ d, d.sum(keepdims=True)
            d_hidden = d[:, None] * net.out * (hidden_raw > 0)
            g_dense, g_dense_shift = features.T @ d_hidden, d_hidden.sum(axis=0)
            d_features = d_hidden @ net.dense.T
            of = np.repeat(np.arange(len(rows)), sizes)
            top = pooled == features[of, FILTERS:]
            d_pooled = d_features[of, :FILTERS] / sizes[of, None] + d_features[of, FILTERS:] * top / np.maximum(1, np.add.reduceat(top, starts)[of])
            d_raw = (d_pooled * (raw > 0)).astype(np.float32)
            # Each filter learns from the one place in a chunk that it answered most.
            g_filters, g_vectors = np.zeros_like(net.filters), np.zeros_like(net.vectors)
            every = np.arange(len(codes))
            for k in range(FILTERS):
                place = best[:, k]
                at_bytes = codes[every[:, None], place[:, None] * STEP + np.arange(WIDTH)]
                g_filters[:, k] = net.vectors[at_bytes].reshape(len(codes), -1).T @ d_raw[:, k]
                np.add.at(g_vectors, at_bytes, d_raw[:, k, None, None] * net.filters[:, k].reshape(1, WIDTH, VECTOR))
            step += 1
            for p_, g, (m, v) in zip(net.parameters(), (g_vectors, g_filters, d_raw.sum(axis=0), g_dense, g_dense_shift, g_out, g_out_shift), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def scored(held, id_col: str, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            pooled, starts, n = [], [], 0
            waiting: list[np.ndarray] = []

            def work() -> None:
                if waiting:
                    pooled.append(net.pooled(np.concatenate(waiting)))
                    waiting.clear()

            room = 0
            for text in texts(batch.column(text_col)):
                c = chunks(text)
                starts.append(n)
                n += len(c)
                waiting.append(c)
                room += len(c)
                if room > 2048:
                    work()
                    room = 0
            work()
            score = net.scores(np.concatenate(pooled), np.array(starts)) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(score.astype(np.float64), pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Rows that learning never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int, label_bytes: int) -> list[tuple[bytes, int]]:
    """At most per_label whole texts of each label, by the hash of their id, fewer if they have over label_bytes bytes."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality").distinct()
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    # At most 2 * per_label ids, so a broadcast of a known size.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # One row of each id and label, so what reaches the driver is bounded however often a row repeats.
    rows = materialize(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "quality-sample")
    place = F.xxhash64("doc_id")
    sizes = rows.select("doc_id", "quality", place.alias("place"), F.octet_length("text").alias("size")).collect()
    taken = F.lit(False)
    for q in (0, 1):
        total, last = 0, None
        for r in sorted((r for r in sizes if r["quality"] == q), key=lambda r: (r["place"], r["doc_id"])):
            total += r["size"]
            if last and total > label_bytes:
                break
            last = r
        if last:
            taken = taken | (F.col("quality") == q) & ((place < last["place"]) | (place == last["place"]) & (F.col("doc_id") <= last["doc_id"]))
    found = rows.where(taken).select("doc_id", "quality", F.encode("text", "UTF-8").alias("text")).collect()
    return [(bytes(x["text"]), x["quality"]) for x in sorted(found, key=lambda x: (x["doc_id"], x["quality"]))]


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1500, label_bytes: int = 16 << 20, keep_from: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted.

    Learning reads at most per_label rows of each label whose id isn't held out, each whole; if they have more than
    label_bytes bytes, fewer rows, but one at least. Scoring reads every byte of every text. Null and empty texts get a score like any other. Labels that are
    null or neither 0 nor 1 are passed over; with one label or none the score is a constant. An id with both labels is
    learned with both, and of texts that share an id the smallest one; rows that repeat are scored each. A null id is
    scored, and not held out unless crc32 of the empty text says so. Scores depend on the bytes alone, but for the last
    digits of single precision; other columns,
    score and predicted among them, are ignored, and an empty table gives no rows.
    """
    net = fit(training_sample(docs, labels, per_label, label_bytes))
    held = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scored(held, "doc_id", "text"), f"doc_id {kind}, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= keep_from, 1).otherwise(0).cast("int").alias("predicted"))
