"""Repeated lines: two Bloom filters find the suspects, only suspects shuffle as text.

Every task sends the 64-bit hashes of its lines, each once, to the shard of the hash. A shard streams them through
two filters of fixed size: one of hashes seen once, one of hashes seen again. The second filters are small and of a
fixed most size, so all tasks get them; a line that hits one is a suspect. A false suspect costs a row, never a
wrong result, as the suspects' whole texts are counted exactly afterwards. Documents that lose no line are written
where they were read; only the others shuffle, to meet the lines that they lose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, Filters, folded, possible, power_of_two, shared_filter
from .common import BLANKS, OWN, discard, materialize, partitions, shards_for, sliced, text_bytes, texts

def key_of(line: str) -> str | None:
    """What makes lines equal: stripped of ASCII white space, A-Z in lower case."""
    return line.strip(BLANKS).encode().lower().decode()


def long_keys(text: bytes, least: int) -> list[str]:
    return [k for line in text.decode().split("\n") if len(line) >= least and len(k := key_of(line)) >= least]


def line_hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode())


def sent_hashes(shards: int, least: int) -> Callable:
    """(shard, once, twice): hashes that a batch holds in one document, and in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [h for text in texts(batch.column(0)) for h in {line_hash(k) for k in long_keys(text, least)}]
            if not found:
                continue
            values, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            shard = (values % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            values, counts, shard = values[order], counts[order], shard[order]
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            parts = list(zip(shard[starts].tolist(), np.split(values, starts[1:]), np.split(counts, starts[1:])))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int32()), pa.array([v[c == 1].tobytes() for _, v, c in parts], pa.binary()), pa.array([v[c > 1].tobytes() for _, v, c in parts], pa.binary())], ["shard", "once", "twice"])

    return run


def whole_hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def twice_filters(shards: int, most_hashes: int, most_bytes: int, unpack: Callable[[bytes], np.ndarray] = whole_hashes) -> Callable:
    """A shard's filter of hashes seen again, from rows (shard, once, twice), one shard's after another's.

    Nothing is gathered: both filters have a size that follows from most_hashes, about how many hashes a shard gets,
    and each row is added as it comes. The second one is folded to what it holds before it is sent.
    """
    first_bits, again_bits, most_bits = power_of_two(12 * most_hashes), power_of_two(8 * most_hashes), max(64, 8 * most_bytes // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, again, n = None, None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([folded(again, n, most_bits).data.tobytes()], pa.binary())], ["shard", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                shard, once, twice = (c[i].as_py() for c in batch.columns)
                if shard != own:
                    yield from done()
                    own, seen, again, n = shard, Bloom(first_bits), Bloom(again_bits), 0
                ones, twos = unpack(once), unpack(twice)
                repeats = np.concatenate([twos, ones[seen.hits(ones)]])
                for hashes in (ones, twos):
                    seen.add(hashes)
                repeats = repeats[~again.hits(repeats)]
                n += len(repeats)
                again.add(repeats)
        yield from done()

    return run


def mark_suspects(filters, shards: int, least: int, id_col: str, text_col: str) -> Callable:
    """Adds each document's suspect keys, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filters(filters.value, shards)
        for batch in sliced(batches):
            where, keys = [], []
            for i, text in enumerate(texts(batch.column(text_col))):
                own = dict.fromkeys(long_keys(text, least))
                keys += own
                where += [i] * len(own)
            out: list[list[str]] = [[] for _ in range(batch.num_rows)]
            if keys:
                hashes = np.array([line_hash(k) for k in keys], np.uint64)
                for j in np.flatnonzero(known.hits((hashes % np.uint64(shards)).astype(np.int64), hashes)).tolist():
                    out[where[j]].append(keys[j])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], [*batch.schema.names, f"{OWN}suspects"])

    return run


def rewrite(text_col: str, drops_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept, lines, dropped = [], [], []
            for text, drops in zip(texts(batch.column(text_col)), batch.column(drops_col).to_pylist()):
                text, gone = text.decode(), set(drops or ())
                all_lines = text.split("\n")
                stay = [x for x in all_lines if key_of(x) not in gone] if gone else all_lines
                kept.append("\n".join(stay))
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(stay))
            names = [n for n in batch.schema.names if n != drops_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "kept_text", "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, filter_bytes: int = 64 << 20, shard_bytes: int = 128 << 20) -> DataFrame:
    """Remove lines that many documents hold, except from the one with the largest id.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least least_chars
    code points found in at least least_docs documents lose all their lines, except all those of the document with the
    largest id that holds them. Returns the input's columns with kept_text, n_lines (before) and n_dropped; columns of
    these names in the input are replaced. A null text is one empty line. Rows that repeat an id are one document. A row
    without an id is no document: it isn't counted and keeps all its lines.

    A shard of the filters gets the hashes of about shard_bytes of text. filter_bytes bounds the second-occurrence
    filters that all tasks get. Past their capacity more lines are confirmed exactly; the result stays the same.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    shards = shards_for(text_bytes(docs, text_col), shard_bytes, 16)
    hashes = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col)).mapInArrow(sent_hashes(shards, least_chars), "shard int, once binary, twice binary")
    dealt = hashes.repartitionById(shards, "shard")
    filters = dealt.mapInArrow(twice_filters(shards, shard_bytes // least_chars, filter_bytes), "shard int, bits binary")
    # Bounded by filter_bytes, whatever the input's size.
    held = spark.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in filters.collect()})

    suspects, drops, own, mark = f"{OWN}suspects", f"{OWN}drops", f"{OWN}id", f"{OWN}hash"
    kind = docs.schema[id_col].dataType.simpleString()
    # The documents as such stay unread here: only id and text pass through Python to find suspects.
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys = slim.mapInArrow(mark_suspects(held, shards, least_chars, "id", "text"), f"id {kind}, text string, {suspects} array<string>").select("id", F.explode(suspects).alias("key"))
    keys = materialize(keys, "line-suspects")
    repeats = keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner")).where(F.col("n") >= least_docs)
    # Written: else the join would take over the aggregation's partitions, where a line of a third of all rows is one task.
    repeats = materialize(repeats, "line-repeats")
    lost = keys.join(repeats, "key").where(F.col("id") != F.col("owner"))
    per_doc = materialize(lost.groupBy(F.col("id").alias(own)).agg(F.collect_set("key").alias(drops)), "line-drops")
    discard(keys, repeats)

    losing = shared_filter(per_doc.select(F.xxhash64(own).alias(mark)), max(16, 2 * partitions(spark)), filter_bytes)
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked, filter_shards = docs.withColumn(mark, F.xxhash64(id_col)), max(16, 2 * partitions(spark))
    sure = marked.mapInArrow(possible(losing, filter_shards, mark, False), fields)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sure = sure.select(*names, text.alias("kept_text"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    maybe = marked.mapInArrow(possible(losing, filter_shards, mark), fields)
    maybe = maybe.join(per_doc, F.col(id_col) == F.col(own), "left").drop(own).mapInArrow(rewrite(text_col, drops), f"{fields}, kept_text string, n_lines bigint, n_dropped bigint")
    return sure.unionByName(maybe)
