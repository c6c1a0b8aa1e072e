"""Repeated substrings across documents: suffix buckets sorted one at a time with difference-cover ranks.

A substring of LENGTH bytes repeats if an earlier document holds it too. Each place where one can start belongs to the
bucket of its anchor: the k-gram with the smallest hash in it. Equal substrings have equal anchors at equal distances,
so a bucket holds all suffixes that can be equal, and its text is shipped once for the dozen suffixes around an anchor.

1. Tasks send the hashes of their anchors; shards stream them through filters of fixed size, which find those that
   more than one document holds, and count those that very many hold. All tasks get small filters of both.
2. Tasks send the surroundings of anchors that hit. Of equal surroundings within a task only those of its first
   document go; the others are repeats already. Around an anchor that very many documents hold the text differs at
   the edges of what they share: there each substring goes by itself, to the shard of its own hash, so that no bucket
   grows with the input.
3. A shard takes its surroundings in blocks. First the columns of a difference cover are ranked over the whole block,
   from the last to the first; then one suffix column after another is ordered within its buckets by the few bytes
   before its next cover column and the rank there, so ties of any length cost the same. Neighbours that agree in
   LENGTH bytes are equal substrings. As an anchor's surroundings are aligned, suffixes of one bucket start at one column.
4. What repeats goes back as runs of starts to the documents that have any; other documents stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, Filters, filled, folded, power_of_two
from .common import materialize, shards_for, text_bytes, texts
from .kernels import BYTE, U, mix, powers

LENGTH = 50
GRAM = 24
#: Starts of k-grams in a substring, and so the most suffixes around an anchor.
SPAN = LENGTH - GRAM + 1
#: Bytes around an anchor that those suffixes' substrings cover.
AROUND = SPAN - 1 + LENGTH
#: A difference cover modulo 13: each residue is the difference of two of these.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: What a task holds before it sends, in bytes of text; what a shard sorts at a time, in surroundings.
HOLD, BLOCK = 16 << 20, 100_000
#: Texts are hashed in groups of about so many bytes; longer ones are cut into slices of so many starts.
GROUP = 1 << 19
#: An anchor in more documents than this is split up by substrings; so many surroundings are split at a time.
HOT, HOT_PART = 20_000, 10_000
#: Input bytes for each filter shard, each shard of surroundings and each group of documents, and the most of them.
FILTER_SHARD, SHARD, DOCS_GROUP = 32 << 20, 8 << 20, 32 << 20
LAST = np.iinfo(np.int64).max
#: More than a text has bytes.
REACH = 1 << 32
CODEC = "zstd"

RECORD = np.dtype([("hash", "<u8"), ("first", "u1"), ("last", "u1"), ("bytes", "u1", (AROUND,)), ("fill", "u1", (2,))])
PLACE = np.dtype([("doc", "<i8"), ("text", "<u8"), ("base", "<i8"), ("group", "<i4")])
#: A run of starts whose LENGTH bytes a smaller document holds.
MARK = np.dtype([("doc", "<i8"), ("text", "<u8"), ("start", "<i8"), ("stop", "<i8")])


def smallest(hashes: np.ndarray) -> np.ndarray:
    """For each run of SPAN k-grams the place of the smallest hash, the leftmost of equal ones."""
    n = len(hashes) - SPAN + 1
    x = np.concatenate([hashes, np.full(-len(hashes) % SPAN, np.iinfo(np.uint64).max)]).reshape(-1, SPAN)
    column = np.arange(SPAN)
    ahead = np.minimum.accumulate(x, axis=1)
    newer = np.ones(x.shape, bool)
    newer[:, 1:] = x[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(newer, column, 0), axis=1)
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    newer = np.ones(x.shape, bool)
    newer[:, :-1] = x[:, :-1] <= back[:, 1:]
    back_at = np.minimum.accumulate(np.where(newer, column, SPAN)[:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(len(x))[:, None] * SPAN
    ahead_at, back_at, ahead, back = (ahead_at + rows).ravel(), (back_at + rows).ravel(), ahead.ravel(), back.ravel()
    end = slice(SPAN - 1, SPAN - 1 + n)
    return np.where(back[:n] <= ahead[end], back_at[:n], ahead_at[end])


def anchors(group: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bytes, text number, first start, last start, anchor place, anchor hash) of each run of starts with one anchor."""
    data = np.frombuffer(b"".join(group), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none, none, none, none, none.view(np.uint64)
    up, down = powers(2 * GROUP + LENGTH)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    place = smallest(hashes)
    ends = np.cumsum([len(t) for t in group])
    starts = np.arange(len(place))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + LENGTH <= ends[text]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True))
    return data, text[first], first, stop, place[first], hashes[place[first]]


def groups_of(rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row, offset in it, bytes) of slices in groups of about GROUP bytes; slices of a text overlap, so that each start is whole in one."""
    row, offset, group, size = [], [], [], 0
    for i, text in enumerate(rows):
        for at in range(0, max(1, len(text) - LENGTH + 1), GROUP):
            group.append(text[at : at + GROUP + LENGTH - 1])
            row.append(i)
            offset.append(at)
            size += len(group[-1])
            if size >= GROUP:
                yield np.array(row), np.array(offset), group
                row, offset, group, size = [], [], [], 0
    if group:
        yield np.array(row), np.array(offset), group


def split_hash(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard, and 40 of the remaining bits: more shards come with more input, and so more bits in all."""
    return (hashes % U(shards)).astype(np.int64), hashes // U(shards) & U((1 << 40) - 1)


def five_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return mix(out.view("<u8").ravel())


def sent_anchors(shards: int) -> Callable:
    """(shard, once, twice, held): anchors that one document of this part of a task holds, those that more hold, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, owner = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
            docs = np.add.reduceat(new.astype(np.int64), starts)
            shard, value = split_hash(hashes[starts], shards)
            order = np.lexsort((value, shard))
            shard, value, docs = shard[order], value[order], docs[order]
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            parts = list(zip(shard[at].tolist(), np.split(value, at[1:]), np.split(docs, at[1:])))
            columns = [[s for s, _, _ in parts], [five_bytes(v[d == 1]) for _, v, d in parts], [five_bytes(v[d > 1]) for _, v, d in parts], [np.minimum(d[d > 1], 65535).astype("<u2").tobytes() for _, _, d in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["shard", "once", "twice", "held"])

        for batch in batches:
            rows = list(texts(batch.column(0)))
            for row, _, group in groups_of(rows):
                _, text, _, _, _, found = anchors(group)
                if len(found):
                    held.append((found, row[text] + number))
                size += sum(map(len, group))
                if size >= HOLD and held:
                    yield from flush()
                    held, size = [], 0
            number += len(rows)
        if held:
            yield from flush()

    return run


def anchor_filters(shards: int, most_hashes: int, most_bytes: int) -> Callable:
    """(shard, bits, hot) from rows of one shard after another: filters of the anchors of several documents and of those of more than HOT.

    Nothing is gathered: the filters and the counts (two rows of counters, of which the smaller holds) have sizes that
    follow from most_hashes, about how many anchors a shard gets. A count is too small by one at most, for the first
    part that held the anchor once, and may be too large.
    """
    bits, width, most_bits = power_of_two(12 * most_hashes), power_of_two(max(1024, most_hashes // 4)), max(64, 8 * most_bytes // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def done() -> Iterator[pa.RecordBatch]:
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([folded(again, n, most_bits).data.tobytes()], pa.binary()), pa.array([folded(hot, n_hot, most_bits // 8).data.tobytes() if n_hot else b""], pa.binary())], ["shard", "bits", "hot"])

        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                shard, once, twice, docs = (c[i].as_py() for c in batch.columns)
                if shard != own:
                    yield from done()
                    own, seen, again, hot, n, n_hot = shard, Bloom(bits), Bloom(bits), Bloom(1 << 16), 0, 0
                    counts = np.zeros((2, width), np.int64)
                ones, twos = from_five(once), from_five(twice)
                # One that another part has too counts as well: a line may stand in one document of each part, and in very many parts.
                held = np.concatenate([twos, ones[seen.hits(ones)]])
                docs = np.append(np.frombuffer(docs, "<u2").astype(np.int64), np.ones(len(held) - len(twos), np.int64))
                for hashes in (ones, twos):
                    seen.add(hashes)
                repeats = held[~again.hits(held)]
                again.add(repeats)
                n += len(repeats)
                places = [(held >> U(k)).astype(np.int64) & width - 1 for k in (0, 32)]
                for row, at in zip(counts, places):
                    np.add.at(row, at, docs)
                many = held[np.minimum(counts[0][places[0]], counts[1][places[1]]) > HOT]
                many = many[~hot.hits(many)]
                hot.add(many)
                n_hot += len(many)
        yield from done()

    return run


def row_digest(records: np.ndarray) -> np.ndarray:
    words = records.view("<u8").reshape(len(records), -1)
    return mix((mix(words) * (mix(np.arange(1, words.shape[1] + 1, dtype=np.uint64)) | U(1))).sum(axis=1))


def same_records(records: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by content, then document, and where in it a new content begins."""
    digest = row_digest(records)
    order = np.lexsort((doc, digest))
    rows, digest = records.view(np.uint8).reshape(len(records), -1), digest[order]
    new = np.ones(len(records), bool)
    alike = np.flatnonzero(digest[1:] == digest[:-1])
    new[alike + 1] = (rows[order[alike]] != rows[order[alike + 1]]).any(axis=1)
    return order, new


def packed(*arrays: np.ndarray) -> bytes:
    # Column by column: bytes of one kind stand together.
    return pa.Codec(CODEC).compress(b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.dtype != RECORD else a.tobytes() for a in arrays), asbytes=True)


def unpacked(data: bytes, n: int, *kinds: np.dtype) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec(CODEC).decompress(data, n * sum(k.itemsize for k in kinds), asbytes=True), np.uint8)
    out, at = [], 0
    for kind in kinds:
        part = raw[at : at + n * kind.itemsize]
        out.append(part.view(kind) if kind == RECORD else np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


SENT = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def sent_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), SENT.types)], schema=SENT)


def by_key(kind: int, key: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """One packed row for each key."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else []
    return [(kind, int(key[rows[0]]), len(rows), packed(*(a[rows] for a in arrays))) for rows in np.split(order, starts[1:]) if len(rows)]


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start column, stop column) of the runs of set bits."""
    bits = np.zeros((len(mask), SPAN + 2), np.int8)
    bits[:, 1:-1] = mask[:, None] >> np.arange(SPAN, dtype=np.uint32) & np.uint32(1)
    step = np.diff(bits, axis=1)
    row, start = np.nonzero(step > 0)
    return row, start, np.nonzero(step < 0)[1]


def united(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted marks with runs that meet or overlap as one, and which of the marks came first in each."""
    if not len(marks):
        return marks, np.zeros(0, np.int64)
    # How far the runs up to each mark reach, within one text.
    text = np.append(True, (marks["doc"][1:] != marks["doc"][:-1]) | (marks["text"][1:] != marks["text"][:-1]))
    number = np.cumsum(text)
    reach = np.maximum.accumulate(marks["stop"] + number * REACH) - number * REACH
    at = np.flatnonzero(text | np.append(True, marks["start"][1:] > reach[:-1]))
    out = marks[at]
    out["stop"] = np.maximum.reduceat(marks["stop"], at)
    return out, at


def marks_of(places: np.ndarray, mask: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows of kind 1: the runs of starts that the masks tell, those that meet as one, packed for each group of documents."""
    row, start, stop = runs_of(mask)
    marks, group = np.zeros(len(row), MARK), places["group"][row]
    for name in ("doc", "text"):
        marks[name] = places[name][row]
    marks["start"], marks["stop"] = places["base"][row] + start, places["base"][row] + stop
    order = np.lexsort((marks["start"], marks["text"], marks["doc"]))
    marks, at = united(marks[order])
    return by_key(1, group[order][at], marks)


def split_up(records: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each substring as a record of its own, in the bucket of its own hash."""
    columns = np.arange(SPAN)
    row, column = np.nonzero((records["first"][:, None] <= columns) & (columns <= records["last"][:, None]))
    out = np.zeros(len(row), RECORD)
    at = np.arange(AROUND)
    inside = (at >= column[:, None]) & (at < column[:, None] + LENGTH)
    out["bytes"] = np.where(inside, records["bytes"][row], 0)
    out["hash"] = records["hash"][row]
    out["first"] = out["last"] = column
    out["hash"] = row_digest(out)
    return out, places[row]


def known_first(records: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Of equal records those of their first document, and marks for the others."""
    order, new = same_records(records, places["doc"])
    records, places = records[order], places[order]
    least = places["doc"][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    later = places["doc"] > least
    width = records["last"].astype(np.int64) - records["first"] + 1
    mask = ((1 << width) - 1 << records["first"].astype(np.int64)).astype(np.uint32)
    return records[~later], places[~later], marks_of(places[later], mask[later])


def surroundings(filters, shards: int, targets: int) -> Callable:
    """Rows of kind 0 for shards of surroundings, of kind 1 (marks) for groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = (Filters({s: x[k] for s, x in filters.value.items()}, shards) for k in (0, 1))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            records, places, rows = known_first(*(np.concatenate(x) for x in zip(*held)))
            shard, value = split_hash(records["hash"], shards)
            often = hot.hits(shard, mix(value))
            for at in range(0, int(often.sum()), HOT_PART):
                own = np.flatnonzero(often)[at : at + HOT_PART]
                own_records, own_places, own_rows = known_first(*split_up(records[own], places[own]))
                rows += own_rows + by_key(0, (mix(own_records["hash"]) % U(targets)).astype(np.int64), own_records, own_places)
            rows += by_key(0, (mix(records["hash"][~often]) % U(targets)).astype(np.int64), records[~often], places[~often])
            if rows:
                yield sent_rows(rows)

        for batch in batches:
            ids, rows, group_of = batch.column("id").to_pylist(), list(texts(batch.column("text"))), batch.column("group").to_numpy()
            doc, told = np.array([LAST if i is None else i for i in ids], np.int64), {}
            for row, offset, group in groups_of(rows):
                data, text, first, stop, place, hashes = anchors(group)
                size += len(data)
                if len(hashes):
                    shard, value = split_hash(hashes, shards)
                    hit = known.hits(shard, mix(value))
                    text, first, stop, place, hashes = (x[hit] for x in (text, first, stop, place, hashes))
                    at = (place - SPAN + 1)[:, None] + np.arange(AROUND)
                    inside = (at >= first[:, None]) & (at < stop[:, None] + LENGTH)
                    records, places = np.zeros(len(text), RECORD), np.zeros(len(text), PLACE)
                    records["hash"], records["first"], records["last"] = hashes, first - (place - SPAN + 1), stop - (place - SPAN + 1)
                    records["bytes"] = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
                    told = {i: told[i] if i in told else xxhash.xxh3_64_intdigest(rows[i]) for i in row.tolist()}  # slices of one text share it
                    digests = np.array([told[i] for i in row.tolist()], np.uint64)
                    begins = np.cumsum([0, *map(len, group)])[:-1]
                    places["doc"], places["text"], places["base"], places["group"] = doc[row[text]], digests[text], place - SPAN + 1 - begins[text] + offset[text], group_of[row[text]]
                    held.append((records, places))
                if size >= HOLD and held:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def ranks(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """The dense rank of each row by several keys, the last one first."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def number_of(text: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each row as one number that orders like them."""
    out = np.zeros(len(text), np.uint64)
    for column in text.T:
        out = out << U(8) | column
    return out


def cover_ranks(text: np.ndarray) -> dict[int, np.ndarray]:
    """The rank of each row's bytes from a column of the difference cover to the end, among all rows.

    From the last column to the first, each from the bytes up to the next cover column and the rank there.
    """
    width = text.shape[1]
    rank: dict[int, np.ndarray] = {}
    after, behind = width, np.zeros(len(text), np.int64)
    for c in reversed([c for c in range(width) if c % MODULUS in COVER]):
        behind = rank[c] = ranks((behind, number_of(text[:, c:after])))
        after = c
    return rank


def suffix_order(start: int, text: np.ndarray, bucket: np.ndarray, rank: dict[int, np.ndarray]) -> np.ndarray:
    """The rows in order of (bucket, their bytes from start to the end): the bytes before the next cover column, then the rank there."""
    following = min(c for c in rank if c >= start)
    if following == start:
        return np.lexsort((rank[start], bucket))
    return np.lexsort((rank[following], number_of(text[:, start:following]), bucket))


def smallest_holders(records: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(records, SPAN): the smallest document with the same LENGTH bytes at this column of this bucket."""
    out = np.full((len(records), SPAN), LAST, np.int64)
    bucket, text = records["hash"], records["bytes"]
    rank = cover_ranks(text)
    for column in range(SPAN):
        order = suffix_order(column, text, bucket, rank)
        order = order[(records["first"][order] <= column) & (column <= records["last"][order])]
        if not len(order):
            continue
        sub, own = text[order, column : column + LENGTH], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]) | (sub[1:] != sub[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        out[order, column] = np.minimum.reduceat(least[order], starts)[np.cumsum(new) - 1]
    return out


def bucket_marks(records: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bit masks of the columns whose bytes a smaller document holds."""
    order, new = same_records(records, places["doc"])
    records, places = records[order], places[order]
    starts = np.flatnonzero(new)
    distinct, least, which = records[starts], places["doc"][starts], np.cumsum(new) - 1
    # A bucket with one content needs no sorting: its first document holds all of it first.
    columns = np.arange(SPAN)
    inside = (distinct["first"][:, None] <= columns) & (columns <= distinct["last"][:, None])
    holders = np.where(inside, least[:, None], LAST)
    _, inverse, counts = np.unique(distinct["hash"], return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts[inverse] > 1)
    if len(several):
        holders[several] = smallest_holders(distinct[several], least[several])
    mask = np.zeros(len(records), np.uint32)
    mask[order] = ((holders[which] < places["doc"][:, None]).astype(np.uint32) << columns.astype(np.uint32)).sum(axis=1, dtype=np.uint32)
    return mask


def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from surroundings, shard by shard as they come, block by block; marks that come in go on as they are."""
    own, held = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            kind, key, n, data = (c[at].as_py() for c in batch.columns)
            if kind:
                yield sent_rows([(kind, key, n, data)])
                continue
            if key != own:
                yield from shard_marks(held)
                own, held = key, []
            held.append((n, data))
    yield from shard_marks(held)


def shard_marks(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    n = sum(x for x, _ in held)
    rounds = -(-n // (4 * BLOCK))  # what is unpacked at a time
    for r in range(rounds):
        parts = []
        for size, data in held:
            records, places = unpacked(data, size, RECORD, PLACE)
            own = mix(records["hash"] ^ U(0x5DEECE66D)) % U(rounds) == U(r)
            parts.append((records[own], places[own]))
        records, places = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(records["hash"], kind="stable")
        records, places = records[order], places[order]
        at = 0
        while at < len(records):
            # A bucket is never cut: it ends where the hash changes.
            end = min(at + BLOCK, len(records))
            end = int(np.searchsorted(records["hash"], records["hash"][end - 1], side="right"))
            if rows := marks_of(places[at:end], bucket_marks(records[at:end], places[at:end])):
                yield sent_rows(rows)
            at = end


def without_repeats(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, removed runs) if each start of the runs removes LENGTH bytes."""
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def merged_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of documents its marks as one: runs that meet are one run, whichever tasks and shards found them."""
    own, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            marks = np.concatenate(held)
            marks = united(marks[np.lexsort((marks["start"], marks["text"], marks["doc"]))])[0]
            for at in range(0, len(marks), 4 * BLOCK):
                part = marks[at : at + 4 * BLOCK]
                yield sent_rows([(1, own, len(part), packed(part))])

    for batch in batches:
        for i in range(batch.num_rows):
            _, key, n, data = (c[i].as_py() for c in batch.columns)
            if key != own:
                yield from done()
                own, held = key, []
            held.append(unpacked(data, n, MARK)[0])
    yield from done()


def marked_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the documents that have marks."""
    for batch in batches:
        for i in range(batch.num_rows):
            marks = unpacked(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), MARK)[0]
            yield pa.RecordBatch.from_arrays([pa.array(mix(np.unique(marks["doc"]).view(np.uint64)).view(np.int64))], ["hash"])


def with_marks(held, shards: int, inside: bool) -> Callable:
    """Keeps the documents that may have marks, or those that surely have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filters(held.value, shards)
        for batch in batches:
            doc = np.array([LAST if i is None else i for i in batch.column("id").to_pylist()], np.int64)
            hashes = mix(doc.view(np.uint64))
            hit = known.hits(np.mod(hashes.view(np.int64), shards), hashes)
            yield batch.filter(pa.array(hit == inside, pa.bool_()))

    return run


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First the marks of a group, then its documents; a partition is a group."""
    group, blobs, marks = None, [], None
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for r in batch.to_pylist():
            if r["group"] != group:
                group, blobs, marks = r["group"], [], None
            if r["kind"] == 0:
                blobs.append((r["n"], r["data"]))
                continue
            if marks is None:
                marks = np.concatenate([unpacked(d, n, MARK)[0] for n, d in blobs]) if blobs else np.zeros(0, MARK)
                marks = marks[np.argsort(marks["doc"], kind="stable")]
                blobs = []
            text, doc = r["data"] or b"", LAST if r["id"] is None else r["id"]
            i, j = np.searchsorted(marks["doc"], doc), np.searchsorted(marks["doc"], doc, side="right")
            own = marks[i:j]
            if len(own):
                own = own[own["text"] == U(xxhash.xxh3_64_intdigest(text))]
            kept, removed, runs = text, 0, 0
            if len(own):
                kept, removed, runs = without_repeats(text, own["start"], own["stop"])
            for x, v in zip(out, (r["id"], kept, len(text), removed, runs, hashlib.sha256(kept).hexdigest())):
                x.append(v)
        if out[0]:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 64 << 20) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller id.

    Returns per row: doc_id, kept (the bytes left, which need not be whole characters), n_bytes, n_removed, n_spans and
    kept_sha256. Strings are judged on the input's UTF-8 bytes and never cross documents. Null and empty texts have no
    bytes. Rows that repeat an id are one document's: none is smaller than another. A null id is larger than all
    others. Other columns are ignored; an empty table gives no rows. filter_bytes bounds what all tasks get.
    """
    spark, size = docs.sparkSession, text_bytes(docs, text_col)
    shards, targets, groups = (shards_for(size, each) for each in (FILTER_SHARD, SHARD, DOCS_GROUP))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(groups)).cast("int").alias("group"))
    hashes = slim.select("text").mapInArrow(sent_anchors(shards), "shard int, once binary, twice binary, held binary")
    dealt = hashes.repartitionById(shards, "shard")
    # An anchor stands for about SPAN / 2 starts.
    filters = dealt.mapInArrow(anchor_filters(shards, -(-2 * max(size, 1) // (shards * SPAN)), filter_bytes), "shard int, bits binary, hot binary")
    # Bounded by filter_bytes, whatever the input's size.
    held = spark.sparkContext.broadcast({r["shard"]: (bytes(r["bits"]), bytes(r["hot"])) for r in filters.collect()})
    kinds = "kind int, key int, n long, data binary"
    sent = slim.mapInArrow(surroundings(held, shards, targets), kinds)
    # A partition is a shard or a group itself: numbers that were hashed again would fall on some partitions several times.
    found = sent.repartitionById(targets, F.when(F.col("kind") == 0, F.col("key")).otherwise(F.col("key") % targets)).sortWithinPartitions("kind", "key").mapInArrow(sorted_buckets, kinds)
    marks = found.repartitionById(groups, "key").mapInArrow(merged_marks, kinds)
    marks = materialize(marks.select(F.col("key").alias("group"), "n", "data"), "suffix-marks")
    # Only documents with marks meet them; the others are told by a filter of ids of a fixed most size.
    hashed = marks.select("n", "data").mapInArrow(marked_docs, "hash long").repartitionById(groups, F.pmod("hash", F.lit(groups)).cast("int"))
    known = spark.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in hashed.mapInArrow(filled(groups, filter_bytes), "shard int, bits binary").collect()})
    fields = "id long, text string, group int"
    maybe = slim.mapInArrow(with_marks(known, groups, True), fields)
    both = marks.select("group", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "n", "data").unionByName(
        maybe.select("group", F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("n"), F.encode(F.col("text"), "UTF-8").alias("data"))
    )
    told = both.repartitionById(groups, "group").sortWithinPartitions("kind")
    told = told.mapInArrow(cleaned, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    bytes_ = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    zero = F.lit(0).cast("long")
    sure = slim.mapInArrow(with_marks(known, groups, False), fields).select(F.col("id").alias("doc_id"), bytes_.alias("kept"), F.octet_length(bytes_).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(bytes_, 256).alias("kept_sha256"))
    return sure.unionByName(told)
