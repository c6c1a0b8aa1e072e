"""Bloom filters in numpy, kept in shards, whose whole size is bounded by a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 5


class Bloom:
    """A Bloom filter over 64-bit hashes, in numpy."""

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.size = max(64, bits + 7 & ~7)
        self.data = np.zeros(self.size >> 3, np.uint8) if data is None else data

    def probes(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        first, step = hashes >> np.uint64(33), (hashes & np.uint64(0x7FFFFFFF)) | np.uint64(1)
        for i in range(PROBES):
            yield ((first + np.uint64(i) * step) % np.uint64(self.size)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.probes(hashes):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.probes(hashes):
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def power_of_two(n: int) -> int:
    return 1 << max(6, int(n - 1).bit_length())


def folded(bloom: Bloom, items: int, most_bits: int) -> Bloom:
    """The same filter with fewer bits: halves are laid over each other while 12 bits an item are left, or more than most_bits.

    It needs a size that is a power of two: then a place modulo half the size is the place modulo the half.
    """
    data = bloom.data
    while len(data) > 8 and (8 * len(data) > most_bits or 4 * len(data) >= 12 * items):
        data = data[: len(data) // 2] | data[len(data) // 2 :]
    return Bloom(8 * len(data), data)


class Filters:
    """The filters of all shards in one array."""

    def __init__(self, held: dict[int, bytes], shards: int) -> None:
        sizes = np.zeros(shards, np.int64)
        for shard, data in held.items():
            sizes[shard] = len(data)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.bits = np.maximum(8 * sizes, 1).astype(np.uint64)
        self.some = sizes > 0
        self.data = np.frombuffer(b"".join(held[s] for s in sorted(held)) or b"\0", np.uint8)

    def hits(self, shard: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        found = self.some[shard]
        first, step = hashes >> np.uint64(33), (hashes & np.uint64(0x7FFFFFFF)) | np.uint64(1)
        for i in range(PROBES):
            left = np.flatnonzero(found)
            at = ((first[left] + np.uint64(i) * step[left]) % self.bits[shard[left]]).astype(np.int64)
            found[left] = self.data[self.starts[shard[left]] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1
        return found


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """pmod of a signed hash, as Spark has it."""
    return np.mod(hashes, shards)


def filled(shards: int, most_bytes: int) -> Callable:
    """A filter for each shard of the hashes that come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            signed = batch.column(0).to_numpy()
            hashes, shard = signed.view(np.uint64), shard_of(signed, shards)
            for s in np.unique(shard).tolist():
                held.setdefault(s, []).append(hashes[shard == s])
        for s, parts in held.items():
            hashes = np.unique(np.concatenate(parts))
            bloom = Bloom(min(16 * len(hashes), 8 * most_bytes // shards))
            bloom.add(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bloom.data.tobytes()], pa.binary())], ["shard", "bits"])

    return run


def shared_filter(hashes: DataFrame, shards: int, most_bytes: int):
    """A broadcast of the filters of a column of 64-bit hashes; most_bytes bounds it, whatever the input's size."""
    spark = hashes.sparkSession
    name = hashes.columns[0]
    dealt = hashes.repartition(shards, F.pmod(F.col(name), F.lit(shards)))
    rows = dealt.mapInArrow(filled(shards, most_bytes), "shard int, bits binary").collect()
    return spark.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in rows})


def possible(held, shards: int, column: str, inside: bool = True) -> Callable:
    """Keeps the rows whose hash may be in the filters, or those whose hash surely isn't; the column itself goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filters(held.value, shards)
        for batch in batches:
            hashes = batch.column(column).to_numpy()
            hit = known.hits(shard_of(hashes, shards), hashes.view(np.uint64))
            names = [n for n in batch.schema.names if n != column]
            yield batch.select(names).filter(pa.array(hit == inside, pa.bool_()))

    return run
