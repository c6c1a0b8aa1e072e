"""Best-fit packing of documents into fixed-length sequences by bin completion over a histogram of lengths.

Piece lengths are whole numbers up to the capacity, so however many documents there are, the packing problem is a
histogram of at most that many counts. Spark tokenizes, cuts and counts; the driver solves the histogram by bin
completion with branch and bound and gets a plan of fillings, each with a repeat count; tasks then look up where the
n-th piece of each length goes.

Best fit gives the first incumbent. Where it misses the bound of total over capacity, fractional packing (fillings as
columns) gives a sharper bound, and its fillings, rounded down, fix most bins; what remains has few pieces of each length
and goes through bin completion: around the largest piece left all undominated fillings are enumerated, fullest first,
and waste that would cost the incumbent's number of bins ends a branch.
"""

from __future__ import annotations

import base64
import json
import re
import time
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sliced

CAPACITY, END_ID = 1024, 2
Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: equal bins are one group with a count."""
    groups: dict[int, list[list]] = {}  # by room left: [filling, count]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = next((r for r in range(size, capacity) if groups.get(r)), capacity)
            if room == capacity:
                fits = capacity // size  # a new bin takes as many of these as fit
                whole = left // fits
                if whole:
                    groups.setdefault(capacity - fits * size, []).append([(size,) * fits, whole])
                if left % fits:
                    groups.setdefault(capacity - left % fits * size, []).append([(size,) * (left % fits), 1])
                break
            group = groups[room][-1]
            n = min(left, group[1])
            group[1] -= n
            if not group[1]:
                groups[room].pop()
            groups.setdefault(room - size, []).append([(*group[0], size), n])
            left -= n
    return [(tuple(f), n) for same in groups.values() for f, n in same]


def bins(plan: Plan) -> int:
    return sum(n for _, n in plan)


def fillings(sizes: list[int], counts: list[int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """All undominated multisets of sizes (largest first, counts of each) that leave at most most_waste of the room, fullest first.

    A filling is dominated if a piece that it leaves out could take the place of some of its pieces with no less in all:
    those pieces fit wherever that piece would have gone. reach[k] has bit t if the sizes from k on can make a sum of t.
    """
    reach = [1] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        bits, step, left = reach[k + 1], 1, counts[k]
        while left:  # counts in powers of two
            step = min(step, left)
            bits |= bits << sizes[k] * step
            left, step = left - step, 2 * step
        reach[k] = bits & (1 << room + 1) - 1

    def with_sum(k: int, rest: int, taken: list[int]) -> Iterator[list[int]]:
        if not rest:
            yield taken + [0] * (len(sizes) - k)
            return
        # The next size that is taken; from where no sum of the smaller ones is left, none is.
        for j in range(k, len(sizes)):
            if not reach[j] >> rest & 1:
                return
            for n in range(min(counts[j], rest // sizes[j]), 0, -1):
                if reach[j + 1] >> rest - n * sizes[j] & 1:
                    yield from with_sum(j + 1, rest - n * sizes[j], [*taken, *[0] * (j - len(taken)), n])

    def dominated(taken: list[int], waste: int) -> bool:
        sums, pairs = 1, 0  # of any pieces, and of two or more
        for size, n in zip(sizes, taken):
            for _ in range(n):
                pairs |= pairs << size | (sums & ~1) << size
                sums |= sums << size
        for size, n, all_ in zip(sizes, taken, counts):
            # A piece left out that fits beside, or in the place of a smaller one or of several that aren't more.
            if n < all_ and (size <= waste or (sums & ~1) >> max(1, size - waste) & (1 << min(waste, size - 1)) - 1 if waste else False):
                return True
            if n < all_ and pairs >> max(0, size - waste) & (1 << min(waste, size) + 1) - 1:
                return True
        return False

    for waste in range(min(most_waste, room) + 1):
        for taken in with_sum(0, room - waste, []):
            if not dominated(taken, waste):
                yield tuple(size for size, n in zip(sizes, taken) for _ in range(n))


def best_column(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling with any number of each size, by dynamic programming over the room."""
    worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = sizes <= c
        gains = worth[c - sizes[fit]] + values[fit]
        k = int(gains.argmax())
        if gains[k] > worth[c - 1] + 1e-12:
            worth[c], pick[c] = gains[k], np.flatnonzero(fit)[k]
        else:
            worth[c], pick[c] = worth[c - 1], -1
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(worth[capacity]), column


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, seconds: float) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """(fillings with fractional repeats, lower bound of bins): the simplex method, in which a dynamic program finds the next filling.

    The bound holds after any number of steps: no filling is worth more than the best one's value, so the pieces' worth
    over that value bounds the bins.
    """
    m, began = len(sizes), time.monotonic()
    per = capacity // sizes
    columns, inverse, x = np.diag(per.astype(float)), np.diag(1 / per), counts / per
    bound = 0.0
    while True:
        values = inverse.sum(axis=0)
        worth, column = best_column(sizes, values, capacity)
        bound = max(bound, float(values @ counts) / worth)
        if worth <= 1 + 1e-9 or time.monotonic() - began > seconds:
            break
        step = inverse @ column
        rows = np.flatnonzero(step > 1e-9)
        k = int(rows[np.argmin(x[rows] / step[rows])])
        take = x[k] / step[k]
        x -= take * step
        x[k] = take
        inverse[k] /= step[k]
        step[k] = 0
        inverse -= np.outer(step, inverse[k])
        columns[:, k] = column
    made = [(tuple(int(s) for s, n in zip(sizes, columns[:, k].astype(int)) for _ in range(n)), float(x[k])) for k in range(m)]
    return made, bound


def bin_completion(counts: np.ndarray, capacity: int, seconds: float = 20.0) -> Plan:
    return solved(counts, capacity, seconds)[0]


def solved(counts: np.ndarray, capacity: int, seconds: float = 20.0) -> tuple[Plan, int]:
    """(plan, lower bound of its bins). The plan is as short as any if the two agree, or if the search came to its end.

    seconds bounds the time of the two searches; the plan is then the best one found, and the bound tells how far from
    the shortest it can be at most.
    """
    counts = counts.astype(np.int64).copy()
    total, began = int((counts * np.arange(len(counts))).sum()), time.monotonic()
    bound, incumbent = -(-total // capacity), best_fit(counts, capacity)
    if bins(incumbent) <= bound:
        return incumbent, bound
    sizes = np.flatnonzero(counts)
    columns, least = fractional(sizes, counts[sizes].astype(float), capacity, seconds / 2)
    bound = max(bound, int(np.ceil(least - 1e-6)))
    fixed, left = [], counts.copy()
    for pieces, x in sorted(columns, key=lambda c: -c[1]):
        need = np.bincount(pieces, minlength=len(counts))
        n = min(int(x + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            fixed.append((pieces, n))
            left -= n * need
    # So few pieces are searched as they are, too, without fillings fixed before.
    for start, rest in ((fixed, left), *[([], counts)] * (int(counts.sum()) <= SMALL)):
        if bins(incumbent) > bound:
            plan = start + completed(rest, capacity, bins(incumbent) - bins(start), bound - bins(start), began + seconds)
            incumbent = min(incumbent, plan, key=bins)
    return incumbent, bound


SMALL = 300


def completed(counts: np.ndarray, capacity: int, most: int, bound: int, ends: float) -> Plan:
    """The shortest plan of fewer than most bins, by branch and bound; best fit's if none is found by then."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = best_fit(counts, capacity)
    best_bins = min(most, bins(best))
    seen: dict[bytes, int] = {}

    def options(left: np.ndarray, wasted: int) -> Iterator[tuple[int, ...]]:
        held = np.flatnonzero(left)[::-1]
        size, own = int(held[0]), left[held].tolist()
        own[0] -= 1
        allowed = (best_bins - 1) * capacity - total - wasted
        if allowed >= 0:
            for filling in fillings(held.tolist(), own, capacity - size, allowed):
                yield (size, *filling)

    # One frame a bin: the pieces left, the waste so far, the fillings still to try, and the plan.
    stack = [(counts, 0, options(counts, 0) if counts.any() else iter(()), [])]
    while stack and best_bins > max(bound, 0) and time.monotonic() < ends:
        left, wasted, todo, plan = stack[-1]
        pieces = next(todo, None)
        if pieces is None:
            stack.pop()
            continue
        waste = wasted + capacity - sum(pieces)
        if total + waste > (best_bins - 1) * capacity:  # fillings come fullest first: the others waste more
            stack.pop()
            continue
        rest = left - np.bincount(pieces, minlength=len(left))
        made = [*plan, (pieces, 1)]
        if not rest.any():
            if len(made) < best_bins:
                best, best_bins = made, len(made)
            continue
        greedy = best_fit(rest, capacity)
        if len(made) + bins(greedy) < best_bins:
            best, best_bins = made + greedy, len(made) + bins(greedy)
        key = rest.tobytes()
        if seen.get(key, len(made) + 1) <= len(made):  # the same pieces were left by as few bins
            continue
        if len(seen) < 200_000:
            seen[key] = len(made)
        stack.append((rest, waste, options(rest, waste), made))
    return best


def places(plan: Plan, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which number on its pieces go to which sequence, and at which offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    given = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for pieces, n in plan:
        at = 0
        for size in pieces:
            found.setdefault(size, []).append((int(given[size]), sequence, at))
            given[size] += n
            at += size
        sequence += n
    return {size: tuple(np.array(x, np.int64) for x in zip(*runs)) for size, runs in found.items()}


@cache
def tokenizer_at(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str, ranks_path: str) -> tuple:
    """An encoder of the tokenizer's vocabulary that is several times as fast, and the strings of its special tokens."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file).get("added_tokens", [])]
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


#: The fast encoder's pattern goes back over a run of white space step by step and gives up on a very long one.
BLANK_RUN = 100_000


def long_blank(text: str) -> bool:
    return len(text) > BLANK_RUN and any(m.end() - m.start() > BLANK_RUN for m in re.finditer(r"\s+", text))


def token_ids(text: str, path: str, ranks_path: str) -> np.ndarray:
    """The tokenizer's ids without added tokens.

    Texts that hold a special token's string or a very long run of white space go through the tokenizer itself, which
    is loaded only then.
    """
    fast, special = encoder(path, ranks_path)
    if any(s in text for s in special) or long_blank(text):
        return np.array(tokenizer_at(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.list_(pa.int32()))])


def cut(capacity: int, end_id: int, path: str, ranks_path: str, with_ids: bool) -> Callable:
    """Pieces of each document, numbered within the task by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = np.zeros(capacity + 1, np.int64)
        for batch in sliced(batches):
            out: list[list] = [[] for _ in SCHEMA]
            for doc, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(token_ids(text or "", path, ranks_path), np.uint32(end_id)).astype("<u4")
                start, length = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    own = ids[start : start + length]
                    for x, v in zip(out, (doc, piece, start, length, zlib.crc32(own.tobytes()), part, int(numbered[length]), own.astype(np.int32) if with_ids else None)):
                        x.append(v)
                    numbered[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, SCHEMA.types)], schema=SCHEMA)

    return run


def place(held) -> Callable:
    """Adds sequence_id and offset from each piece's length and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length).tolist():
                starts, first, at = held.value[size]
                rows = np.flatnonzero(length == size)
                run_of = np.searchsorted(starts, number[rows], side="right") - 1
                sequence[rows] = first[run_of] + number[rows] - starts[run_of]
                offset[rows] = at[run_of]
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces and pack them into as few sequences of at most capacity tokens as it finds.

    Returns a row per piece: doc_id, piece (from 0), start, length, ids_crc32 (of the little-endian 32-bit ids),
    sequence_id, offset, and ids if with_ids. A document is its ids and end_id; only one longer than the capacity is
    cut, and then its first piece is the shorter one. Every row of the input is packed, so rows that repeat an id are
    packed each. Null and empty texts are the end id alone. Other columns are ignored; an empty table gives no rows.

    tokenizer and ranks are paths of the two forms of one vocabulary, readable on every executor.
    """
    if tokenizer is None or ranks is None:
        import public_tokenizers

        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    # Written once: numbers within a task must not change when a lost executor's work is done again.
    pieces = materialize(slim.mapInArrow(cut(capacity, end_id, tokenizer, ranks, with_ids), PIECES), "pack-pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(places(bin_completion(counts, capacity), capacity))
    # Of each length, a task's pieces are numbered behind those of the tasks before it.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = per_task.select("length", "part", before.alias("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = pieces.join(offsets, ["length", "part"]).select(*kept, (F.col("nth") + F.col("before")).alias("number"))
    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(place(plan), ", ".join(f"{n} {kinds[n]}" for n in kept) + ", sequence_id long, offset long")
