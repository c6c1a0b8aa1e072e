"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Rows with the same n-gram set are one node, so copies never meet each other. Only nodes that share a band hash are
candidates, and their whole MinHash signatures, a byte a hash, say first whether they can be near at all: each node is
held against the smallest one of its band hash, and where that fails against the others there, block against block. What
passes connects the groups, so pages that share a template and a band now and then form none. In each group all pairs
are compared on their whole sets, block against block, and only counts and spanning links leave a task: no pair is ever
a row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import possible, shared_filter
from .common import OWN, discard, materialize, partitions, sliced, texts
from .graph import components
from .kernels import U, mix, shingle_sets

#: A group is split into blocks of at least BLOCK nodes, at most SPLITS of them while they stay under MOST_BLOCK nodes
#: and BLOCK_BYTES of n-gram hashes.
BLOCK, SPLITS, MOST_BLOCK, BLOCK_BYTES = 64, 32, 2048, 8 << 20
#: Nodes of one band hash that one task holds against each other by their signatures, and copies of a hub for a hot band.
BAND_BLOCK, SALTS = 8192, 16


def choose_bands(threshold: float, target_recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which a pair at the threshold shares a band with that probability."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= target_recall:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def least_matches(threshold: float, hashes: int, loss: float = 1e-6) -> int:
    """So many of the hashes agree at least for a pair at the threshold, but with a probability of at most loss."""
    below = 0.0
    for k in range(hashes + 1):
        below += comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > loss:
            return k
    return hashes


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(n: int, bands: int, rows: int) -> Callable:
    """(doc_id, node, digest, size, bands, sketch) for texts with words; node is a digest of the whole n-gram set, digest of the text.

    The sketch is the signature with one byte for each hash: equal hashes have equal bytes, so it never tells fewer matches.
    """
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)
    shifts = mix(factors)
    weights = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | U(1)
    salt = mix(np.arange(7, 7 + bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, nodes, mins, digests, sizes = [], [], [], [], []
            for doc, shingles, text in zip(batch.column(0).to_pylist(), shingle_sets(texts(batch.column(1)), n), texts(batch.column(1))):
                if len(shingles):
                    ids.append(doc)
                    nodes.append(node_of(shingles))
                    digests.append(hashlib.sha256(text).digest())
                    sizes.append(len(shingles))
                    # In slices, so that a very long text takes no more memory than a short one.
                    low = None
                    for part in (shingles[i : i + 4096] for i in range(0, len(shingles), 4096)):
                        least = ((part[:, None] ^ shifts) * factors).min(axis=0)
                        low = least if low is None else np.minimum(low, least)
                    mins.append(low)
            if ids:
                least = np.array(mins)
                keys = mix((least.reshape(-1, bands, rows) * weights).sum(axis=2) ^ salt).view(np.int64)
                sketches = [row.tobytes() for row in (mix(least) >> U(56)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(nodes, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "node", "digest", "size", "bands", "sketch"])

    return run


def member_sets(n: int) -> Callable:
    """Replaces text by its n-gram set; rows whose text isn't that of their node go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            names = [x for x in part.schema.names if x != "text"]
            sets = list(shingle_sets(texts(part.column("text")), n))
            right = [node_of(s) == bytes(k) for s, k in zip(sets, part.column("node").to_pylist())]
            made = pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "shingles"])
            yield made.filter(pa.array(right, pa.bool_()))

    return run


#: Cells of one matrix of sets by n-grams.
CELLS = 4 << 20


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of the sets on the left with those on the right, as matrix products."""
    held, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    # N-grams that one set alone holds are in no intersection.
    shared = np.bincount(at, minlength=len(held)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner = column[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    columns = int(shared.sum())
    out = np.zeros((len(left), len(right)), np.int32)
    width = max(1, min(columns, CELLS // (len(left) + len(right))))
    for low in range(0, columns, width):
        i, j = np.searchsorted(at, [low, low + width])
        m = np.zeros((len(left) + len(right), width), np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int32)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs have a Jaccard similarity of the threshold or more, in whole numbers."""
    both = overlaps(left, right)
    a, b = (np.array([len(s) for s in side], np.int64) for side in (left, right))
    over, under = threshold.numerator + threshold.denominator, threshold.numerator
    hit = np.zeros(both.shape, bool)
    for i in range(0, len(a), 256):  # in slices of rows, as the products take eight bytes a cell
        hit[i : i + 256] = both[i : i + 256].astype(np.int64) * over >= (a[i : i + 256, None] + b) * under
    return hit


def spanning(hit: np.ndarray, one: bool) -> list[np.ndarray]:
    """A breadth-first spanning forest of the links: each node's parent, -1 for roots and nodes without a link.

    With one, rows and columns are the same nodes and there is one array; else there is one for the rows and one for
    the columns, and a node's parent is on the other side.
    """
    sides = [hit] if one else [hit, hit.T]
    parents = [np.full(len(s), -1) for s in sides]
    unseen = [np.ones(len(s), bool) for s in sides]
    for root in np.flatnonzero(hit.any(axis=1)).tolist():  # each column with a link is reached from a row
        if not unseen[0][root]:
            continue
        unseen[0][root] = False
        todo = deque([(0, root)])
        while todo:
            side, a = todo.popleft()
            to = 0 if one else 1 - side
            found = np.flatnonzero(sides[side][a] & unseen[to])
            unseen[to][found] = False
            parents[to][found] = a
            todo.extend((to, b) for b in found.tolist())
    return parents


def verified(threshold: Fraction) -> Callable:
    """Per block pair: (node, other, links): links is the number of rows linked to node, other its parent in a spanning forest or null."""

    def pairs(rows: list[dict]) -> Iterator[tuple[bytes, bytes | None, int]]:
        i, j = rows[0]["i"], rows[0]["j"]
        sides: dict[int, dict[bytes, tuple[np.ndarray, int]]] = {i: {}, j: {}}
        for r in rows:  # rows of equal nodes, as repeated rows give, count once
            sides[r["block"]][r["node"]] = (np.frombuffer(r["shingles"], np.uint64), r["copies"])
        left, right = sorted(sides[i]), sorted(sides[j])
        if not left or not right:
            return
        hit = linked([sides[i][k][0] for k in left], [sides[j][k][0] for k in right], threshold)
        copies = [np.array([sides[s][k][1] for k in side], np.int64) for s, side in ((i, left), (j, right))]
        if i == j:
            np.fill_diagonal(hit, False)
        parents = spanning(hit, i == j)
        for a in np.flatnonzero(hit.any(axis=1)).tolist():
            yield left[a], right[parents[0][a]] if parents[0][a] >= 0 else None, int(copies[1][hit[a]].sum())
        if i != j:
            for b in np.flatnonzero(hit.any(axis=0)).tolist():
                yield right[b], left[parents[1][b]], int(copies[0][hit[:, b]].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> list[tuple]:
            return list(pairs(rows)) if len(rows) > 1 else []

        key, rows = None, []
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if (own := (r["group"], r["i"], r["j"])) != key:
                        found += flush(rows)
                        key, rows = own, []
                    rows.append(r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.binary(), pa.binary(), pa.int64()))], ["node", "other", "links"])
        if found := flush(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.binary(), pa.binary(), pa.int64()))], ["node", "other", "links"])

    return run


def matched(least: int) -> Callable:
    """Whether a node's sketch and its hub's agree in so many bytes: (node, hub, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for x in ("sketch", "other"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub"), pa.array((a == b).sum(axis=1) >= least)], ["node", "hub", "near"])

    return run


def forest(sides: list[np.ndarray], least: int) -> Iterator[tuple[int, int, int]]:
    """A breadth-first spanning forest of the sketches that agree in so many bytes: (side, node, parent on the other side).

    One side is held against itself, two against each other. A node that was reached is never compared again, so a group
    of near copies costs as much as it has nodes, and only nodes that are near to none meet all others.
    """
    left = [np.arange(len(s)) for s in sides]  # not reached yet
    while len(left[0]):
        root, left[0] = int(left[0][0]), left[0][1:]
        todo = deque([(0, root)])
        while todo:
            side, at = todo.popleft()
            to = 0 if len(sides) == 1 else 1 - side
            near = np.zeros(len(left[to]), bool)
            for low in range(0, len(near), 4096):
                near[low : low + 4096] = np.count_nonzero(sides[to][left[to][low : low + 4096]] == sides[side][at], axis=1) >= least
            found, left[to] = left[to][near], left[to][~near]
            for other in found.tolist():
                yield to, other, at
                todo.append((to, other))


def band_links(least: int) -> Callable:
    """Per band hash and block pair: (node, hub), hub being the smallest node of the tree that agreeing sketches connect.

    Trees of one group of near copies have the same smallest node in most of its band hashes, so their links are few.
    """

    def pairs(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        _, i, j = rows[0][:3]
        held = [{r[4]: r[5] for r in rows if r[3] == block} for block in dict.fromkeys((i, j))]
        names = [list(side) for side in held]
        if all(names):
            sides = [np.frombuffer(b"".join(side.values()), np.uint8).reshape(len(side), -1) for side in held]
            top_of, trees = {}, {}
            for side, node, parent in forest(sides, least):
                up = (len(sides) - 1 - side, parent)
                top = top_of[side, node] = top_of.setdefault(up, up)
                trees.setdefault(top, [names[top[0]][top[1]]]).append(names[side][node])
            for tree in trees.values():
                hub = min(tree)
                yield from ((node, hub) for node in tree if node != hub)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in sliced(batches):
            for r in zip(*(batch.column(x).to_pylist() for x in ("key", "i", "j", "block", "node", "sketch"))):
                if r[:3] != key:
                    found += pairs(rows) if len(rows) > 1 else ()
                    key, rows = r[:3], []
                rows.append(r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["node", "hub"])
                found = []
        if len(rows) > 1 and (found := list(pairs(rows))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["node", "hub"])

    return run


def candidates(nodes: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) that connect all nodes which share a band hash and whose sketches agree in so many bytes.

    The smallest node of a band hash is its hub. Nodes that agree with their hub are connected by it and meet no other
    one of that hash. The rest, as pages of one template are, meet all nodes of their hash, each pair at most once for a
    hash that both have; a hash of many nodes is cut into blocks.
    """
    keys = materialize(nodes.select("node", F.explode("bands").alias("key")), "near-keys")
    hubs = materialize(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "near-hubs")
    spokes = materialize(keys.join(hubs, "key").where("node <> hub").select("node", "key", "hub", "n"), "near-spokes")
    discard(keys)
    sketches = nodes.select("node", "sketch")
    # A hub may have a third of all nodes: its sketch goes to several tasks.
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    wanted = hubs.select("hub").distinct()
    salted = sketches.join(wanted, sketches["node"] == wanted["hub"]).select("hub", F.col("sketch").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    held = spokes.select("node", "hub").distinct().join(sketches, "node").withColumn("salt", salt).join(salted, ["hub", "salt"]).select("node", "hub", "sketch", "other")
    told = materialize(held.mapInArrow(matched(least), "node binary, hub binary, near boolean"), "near-told")

    rough = spokes.where("n > 2").join(told.where("not near"), ["node", "hub"]).select("key", "hub", "n").distinct()
    rough = materialize(rough.withColumn("splits", F.ceil(F.col("n") / BAND_BLOCK).cast("int")), "near-rough")
    inside = spokes.join(rough.select("key", "splits"), "key").select("key", "splits", "node").union(rough.select("key", "splits", F.col("hub").alias("node")))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int")).join(sketches, "node")
    dealt = inside.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "sketch")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(band_links(least), "node binary, hub binary")
    own = stars(told.where("near").select("node", "hub").union(found))
    edges = materialize(few_edges(own), "near-edges")
    discard(hubs, spokes, told, rough, own)
    return edges


def stars(links: DataFrame) -> DataFrame:
    """(node, least, hubs) of links (node, hub). A node has a few hubs for each band and block at most, so what is gathered for it is bounded."""
    return materialize(links.groupBy("node").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs")), "near-stars")


def few_edges(own: DataFrame) -> DataFrame:
    """The same components with about one edge a node: each node to its smallest hub, and its other hubs to that one; hubs are few."""
    others = own.select(F.explode("hubs").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return own.select(F.col("node").alias("a"), F.col("least").alias("b")).union(others)


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, target_recall: float, hashes: int, filter_bytes: int) -> DataFrame:
    """Per row with an id and a word: doc_id, digest (of the text), class_id, n_links, n_copies, and first, the smallest (doc_id, digest) of its class."""
    bands, rows = choose_bands(threshold, target_recall, hashes)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = materialize(slim.mapInArrow(signatures(n, bands, rows), f"doc_id {kind}, node binary, digest binary, size long, bands array<long>, sketch binary"), "near-signed")
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "near-nodes")

    edges = candidates(nodes, least_matches(threshold, bands * rows))
    groups = components(edges)
    discard(edges)

    sizes = groups.join(nodes.select("node", "size"), "node").groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    splits = F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(SPLITS)), F.ceil(F.col("n") / MOST_BLOCK), F.ceil(8 * F.col("grams") / BLOCK_BYTES)).cast("int")
    sizes = materialize(sizes.select(F.col("label").alias("group"), splits.alias("splits")), "near-sizes")
    members = groups.join(sizes, groups["label"] == sizes["group"]).join(nodes.select("node", "least.doc_id", "copies"), "node")
    members = materialize(members.select("group", "node", F.col("doc_id").alias("least"), "copies", "splits", F.pmod(F.xxhash64("node"), F.col("splits")).cast("int").alias("block")), "near-members")
    discard(groups, sizes)
    # Only texts that may be a member's shuffle: a filter of their ids, of a fixed most size, goes to all tasks first.
    mark, shards = f"{OWN}hash", max(16, 2 * partitions(docs.sparkSession))
    wanted = shared_filter(members.select(F.xxhash64("least").alias(mark)), shards, filter_bytes)
    few = slim.withColumn(mark, F.xxhash64("doc_id")).mapInArrow(possible(wanted, shards, mark), f"doc_id {kind}, text string")
    sets = few.join(members, few["doc_id"] == members["least"]).select("group", "node", "copies", "splits", "block", "text")
    sets = sets.mapInArrow(member_sets(n), "group binary, node binary, copies long, splits int, block int, shingles binary")
    dealt = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).select("group", "node", "copies", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "shingles")
    dealt = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    links = materialize(dealt.mapInArrow(verified(Fraction(str(threshold))), "node binary, other binary, links long"), "near-links")
    discard(members)

    classes = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    first = materialize(classes.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("first")), "near-names")
    per_node = classes.join(first, "label").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node").select("node", "first", "links")
    per_node = nodes.select("node", "least", "copies").join(per_node, "node", "left").select("node", F.coalesce("first", "least").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies"))
    per_node = materialize(per_node, "near-classes")
    discard(nodes, links, classes, first)
    return signed.select("doc_id", "digest", "node").join(per_node, "node").select("doc_id", "digest", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies", "first")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, target_recall: float = 0.9999, hashes: int = 128, filter_bytes: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, class_id, n_links and n_copies.

    Two rows are linked if their sets of word n-grams have a Jaccard similarity of threshold or more; a text of fewer
    than n words has one n-gram, of all its words. A class is what links connect, its id the smallest id in it.
    n_links counts the other rows that a row is linked to, copies too; n_copies counts the rows with its own n-gram
    set, itself included. Words are compared as they are. Null texts and texts without a word are linked to nothing,
    as are rows whose id is null: these have a null class. Rows that repeat an id are rows of their own. Other columns
    are ignored; an empty table gives no rows.

    Bands lose a pair at the threshold with a probability of at most 1 - target_recall, others less, and signatures lose
    one with a probability of at most a millionth. N-grams are compared by 64-bit hashes. Texts that share a band hash
    but no more than a template are told apart by their signatures, at most once for each hash that two of them share,
    and their texts don't meet. The work in a group of near copies grows with the square of its different texts, as the
    number of its links does, but is dealt out block by block, and blocks are bounded in nodes and in bytes; each text
    is copied at most 33 times for it while groups have up to 65,536 texts and 256 MiB of n-gram hashes. filter_bytes
    bounds what all tasks get; past its capacity more texts shuffle.
    """
    found = _classes(docs, id_col, text_col, n, threshold, target_recall, hashes, filter_bytes).select("doc_id", "class_id", "n_links", "n_copies")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    alone = slim.where(F.col("doc_id").isNull() | ~has_word).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(alone)


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, target_recall: float = 0.9999, hashes: int = 128, filter_bytes: int = 64 << 20) -> DataFrame:
    """The input without near copies: of each class the row with the smallest id stays, with all its columns.

    Of rows of a class that share the smallest id, the one whose text has the smallest SHA-256 stays, and of those that
    repeat id and text one. Rows without a word or an id are no near copies of anything: all of them stay, as they are.
    """
    rows = materialize(_classes(docs, id_col, text_col, n, threshold, target_recall, hashes, filter_bytes).select("doc_id", "digest", (F.struct("doc_id", "digest") == F.col("first")).alias("stays")), "near-rows")
    digest, mark, shards = f"{OWN}digest", f"{OWN}hash", max(16, 2 * partitions(docs.sparkSession))
    losers = rows.where("not stays").select(F.col("doc_id").alias(id_col), F.col("digest").alias(digest)).distinct()
    again = rows.where("stays").groupBy(F.col("doc_id").alias(id_col), F.col("digest").alias(digest)).count().where("count > 1").drop("count")
    # Rows that the filter doesn't know stay where they are; only the others shuffle, for the exact answer.
    touched = materialize(losers.withColumn("lost", F.lit(True)).unionByName(again.withColumn("lost", F.lit(False))), "near-touched")
    known = shared_filter(touched.select(F.xxhash64(id_col).alias(mark)), shards, filter_bytes)
    marked, fields = docs.withColumn(mark, F.xxhash64(id_col)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sure = marked.mapInArrow(possible(known, shards, mark, False), fields)
    maybe = marked.mapInArrow(possible(known, shards, mark), fields).withColumn(digest, F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256)))
    told = maybe.join(touched.withColumnRenamed("lost", f"{OWN}lost"), [id_col, digest], "left").where(f"{OWN}lost is null or not {OWN}lost")
    once = told.where(f"{OWN}lost is null").unionByName(told.where(f"{OWN}lost is not null").dropDuplicates([id_col, digest]))
    return sure.unionByName(once.select(*docs.columns))
