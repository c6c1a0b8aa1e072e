"""SimHash near duplicates: a binary trie over the fingerprints, joined with itself.

Distinct fingerprints, sorted, are a binary trie: a node is a range of them with a common prefix, its children lie on
both sides of the place where the next bit turns to one. Two nodes are traversed together: each step takes one bit of
both, adds one to the pair's differing bits where children of unlike bits meet, and drops pairs over the budget. The
trie is cut into blocks of neighbouring fingerprints; first each block is joined with itself, from the deepest nodes
up, then pairs of blocks whose prefixes are near enough. Links only matter for what they connect, so pairs of nodes
that wholly belong to one component already are dropped too, and only spanning links leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sliced, texts
from .graph import components
from .kernels import slices
from .order import numbered

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Ranges of so many fingerprints are compared one by one; so many pairs of nodes are expanded at once.
FEW, FRONT = 8, 1 << 15


def fingerprint(text: bytes, n: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text, read slice by slice."""
    ones, total, last = np.zeros(64, np.int64), 0, []

    def add(words: list[bytes], count: int) -> int:
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = ends - [len(w) + 1 for w in words]
        found = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[count - 1 :] - 1).tolist())), np.uint64, len(words) - count + 1)
        for at in range(0, len(found), 8192):
            ones[:] += np.unpackbits(found[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        return len(found)

    for part in slices(text.translate(LOWER)):
        words = last + part.split()
        if len(words) >= n:
            total += add(words, n)
        last = words[-(n - 1) :] if len(words) >= n else words
    if not total and last:
        total = add(last, len(last))
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = np.array([fingerprint(t, n, seed) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return run


class Trie:
    """Ranges of sorted distinct fingerprints, and the components that links have made of them; one or several ranges stand in one array."""

    def __init__(self, keys: np.ndarray, label: np.ndarray, most: int) -> None:
        self.keys, self.label, self.most = keys, label, most
        self.ones: dict[int, np.ndarray] = {}
        self.refresh()

    def refresh(self) -> None:
        """Places where the component changes, summed up: a range whose sum doesn't grow is of one component."""
        self.turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def middle(self, bit: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if bit not in self.ones:
            self.ones[bit] = np.concatenate([[0], np.cumsum(self.keys >> np.uint64(63 - bit) & np.uint64(1))]).astype(np.int64)
        ones = self.ones[bit]
        return high - (ones[high] - ones[low])

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each component's label is its smallest place."""
        a, b = self.label[a], self.label[b]
        if not (a != b).any():
            return
        over = np.arange(len(self.keys))
        while (unlike := a != b).any():
            a, b = a[unlike], b[unlike]
            np.minimum.at(over, np.maximum(a, b), np.minimum(a, b))
            while (further := over[over] != over).any():
                over[further] = over[over[further]]
            a, b = over[a], over[b]
        self.label = over[self.label]
        self.refresh()

    def compare(self, pairs: np.ndarray) -> None:
        """All fingerprints of small ranges; pairs has the columns a_low, a_high, b_low, b_high and the differing bits so far."""
        for at in range(0, len(pairs), 1 << 14):
            part = pairs[at : at + (1 << 14)]
            left, right = (part[:, c, None] + np.arange(FEW) for c in (0, 2))
            last = len(self.keys) - 1
            unlike = np.bitwise_count(self.keys[np.minimum(left, last)][:, :, None] ^ self.keys[np.minimum(right, last)][:, None, :])
            p, i, j = np.nonzero(unlike <= self.most)
            a, b = left[p, i], right[p, j]
            real = (a < part[p, 1]) & (b < part[p, 3])
            self.unite(a[real], b[real])

    def join(self, pairs: np.ndarray, bit: int) -> None:
        """Traverses pairs of nodes together, from the given bit on."""
        todo = [(bit, pairs)]
        while todo:
            bit, pairs = todo.pop()
            if len(pairs) > FRONT:
                todo.append((bit, pairs[FRONT:]))
                pairs = pairs[:FRONT]
            a, A, b, B = pairs[:, :4].T
            done = (self.turns[A - 1] == self.turns[a]) & (self.turns[B - 1] == self.turns[b]) & (self.label[a] == self.label[b])
            pairs = pairs[~done]
            small = (pairs[:, 1] - pairs[:, 0] <= FEW) & (pairs[:, 3] - pairs[:, 2] <= FEW)
            self.compare(pairs[small])
            pairs = pairs[~small]
            if not len(pairs):
                continue
            a, A, b, B, unlike = pairs.T
            m, M = self.middle(bit, a, A), self.middle(bit, b, B)
            children = [(a, m, b, M, unlike), (m, A, M, B, unlike), (a, m, M, B, unlike + 1), (m, A, b, M, unlike + 1)]
            nodes = np.concatenate([np.stack(c, axis=1) for c in children])
            nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= self.most)]
            if len(nodes):
                todo.append((bit + 1, nodes))

    def within(self) -> None:
        """Joins the only range with itself: the two children of each node, the deepest nodes first."""
        if len(self.keys) < 2:
            return
        # Neighbours part at the first bit in which they differ; there their common node has its two children.
        parts = np.array([64 - int(x).bit_length() for x in self.keys[1:] ^ self.keys[:-1]])
        for bit in range(63, -1, -1):
            here = np.flatnonzero(parts == bit)
            if len(here):
                ends = np.concatenate([[-1], np.flatnonzero(parts < bit), [len(parts)]])
                k = np.searchsorted(ends, here)
                self.join(np.stack([ends[k - 1] + 1, here + 1, here + 1, ends[k] + 1, np.ones(len(here), np.int64)], axis=1), bit + 1)


SIGN = np.uint64(1 << 63)


def unsigned(column: np.ndarray) -> np.ndarray:
    """Keys that Spark has sorted as signed numbers, as unsigned ones in the same order; distances stay."""
    return np.asarray(column, np.int64).view(np.uint64) ^ SIGN


def joined_blocks(most: int):
    """A block's keys with, for each, the place of the smallest key of its component in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            trie = Trie(unsigned(batch.column("keys")[0].values.to_numpy()), np.arange(len(batch.column("keys")[0])), most)
            trie.within()
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("keys"), pa.array([trie.label.astype(np.int32)], pa.list_(pa.int32()))], ["block", "keys", "roots"])

    return run


def joined_pairs(most: int):
    """Spanning links (a, b) between a block's components and those of the blocks that follow it: rows are sorted, the block itself comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in sliced(batches, 1):
            to, part, block = (batch.column(c)[0].as_py() for c in ("to", "part", "block"))
            keys, roots = unsigned(batch.column("keys")[0].values.to_numpy()), batch.column("roots")[0].values.to_numpy().astype(np.int64)
            if block == to:
                held, own = (to, part), (keys, roots)
                continue
            assert held == (to, part)
            n = len(own[0])
            trie = Trie(np.concatenate([own[0], keys]), before := np.concatenate([own[1], roots + n]), most)
            trie.join(np.array([[0, n, n, n + len(keys), 0]]), 0)
            own = (own[0], trie.label[:n])  # a component's label is its smallest place, so it lies in the first block if any of it does
            moved = np.flatnonzero((before == np.arange(len(before))) & (trie.label != before))
            if len(moved):
                signed = (trie.keys ^ SIGN).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[trie.label[moved]])], ["a", "b"])

    return run


def near_blocks(blocks: DataFrame, count: int, most: int) -> DataFrame:
    """(a, b) with a < b: blocks whose common prefixes leave room for a link.

    Both meet at the nodes of one level of the trie, each block at the nodes it covers and at those that differ from
    them in at most so many bits; then the longer prefixes that the blocks have in common decide.
    """
    level = min(12, max(0, math.ceil(math.log2(max(count, 1)))))
    bits = lambda c: F.length(F.bin(c))
    ends = blocks.select("block", F.element_at("keys", 1).alias("low"), F.element_at("keys", -1).alias("high"))
    ends = ends.select("block", "low", F.when(F.col("low") == F.col("high"), 64).otherwise(64 - bits(F.col("low").bitwiseXOR(F.col("high")))).alias("common"), "high")
    if not level:
        return ends.select(F.col("block").alias("a"), F.col("block").alias("b")).where("a < b")
    node = lambda c: F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-(1 << 63))), 64 - level)
    covered = materialize(ends.withColumn("node", F.explode(F.sequence(node("low"), node("high")))), "simhash-nodes")
    masks = [m for m in range(1 << level) if m.bit_count() <= most]
    left = covered.select(F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("common").alias("a_common"), F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda m: m.bitwiseXOR(F.col("node")))).alias("node"))
    right = covered.select(F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("common").alias("b_common"), "node")
    shorter = F.least("a_common", "b_common").cast("int")
    unlike = F.when(shorter == 0, 0).otherwise(F.bit_count(F.expr("shiftrightunsigned(a_low ^ b_low, cast(64 - least(a_common, b_common) as int))")))
    found = materialize(left.join(right, "node").where("a < b").where(unlike <= most).select("a", "b").distinct(), "simhash-pairs")
    discard(covered)
    return found


def classes(prints: DataFrame, most: int, block: int, together: int) -> DataFrame:
    """(key, label) of distinct keys (fp long): label is a key of the component."""
    placed = numbered(prints, [], ["fp"], "simhash-order")
    # A partition for each block: small ones put together would be joined in one task.
    dealt = placed.select("fp", F.floor(F.col("at") / block).alias("block")).repartition(max(1, -(-placed.count() // block)), "block")
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list("fp")).alias("keys"))
    blocks = materialize(blocks.mapInArrow(joined_blocks(most), "block long, keys array<long>, roots array<int>"), "simhash-blocks")
    discard(placed)
    count = blocks.count()
    pairs = near_blocks(blocks, count, most)
    # Each pair goes to one of its two blocks, by turns; a block with many others takes them in parts.
    turned = pairs.select(F.when((F.col("a") + F.col("b")) % 2 == 0, F.struct(F.col("a").alias("to"), F.col("b").alias("block"))).otherwise(F.struct(F.col("b").alias("to"), F.col("a").alias("block"))).alias("x")).select("x.*")
    parts = turned.groupBy("to").agg(F.ceil(F.count("*") / together).alias("parts"))
    turned = turned.join(parts, "to").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")))
    asked = turned.select("to", "part", "block").union(turned.select("to", "part", F.col("to").alias("block")).distinct())
    sent = asked.join(blocks, "block").repartition("to", "part").sortWithinPartitions("to", "part", F.col("block") != F.col("to"), "block").select("to", "part", "block", "keys", "roots")
    links = materialize(sent.mapInArrow(joined_pairs(most), "a long, b long"), "simhash-links")
    over = components(links)
    held = blocks.select(F.explode(F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("keys", F.get("roots", i)).alias("root")))).alias("x")).select("x.*")
    made = materialize(held.join(over, held["root"] == over["node"], "left").select("key", F.coalesce("label", "root").alias("label")), "simhash-classes")
    discard(blocks, links, over, pairs)
    return made


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, most: int = 4, seed: int = 42, block: int = 32768, together: int = 8) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lowercase hex digits) and component_id.

    Words are runs of characters other than ASCII white space, A-Z in lower case; a text's n-word shingles, repeats
    too, are hashed by XXH64 with the seed, and a bit of the fingerprint is 1 if it is in more than half the hashes. A
    text of fewer words has one shingle, of all of them; a null text or one without a word has fingerprint zero, which
    links like any other. Rows link where fingerprints differ in at most most bits; component_id is the smallest id
    that links reach, null where all ids reached are null. Repeated rows and ids are rows of their own; other columns
    are ignored; an empty table gives no rows.

    Exact, with no cap: all pairs of fingerprints within the budget are found or known to be connected. Equal texts are
    one fingerprint. A block has at most block fingerprints (12 bytes each), and a task holds two. Each block meets
    those whose prefix is near: 163 of 256 with 4 bits of 8, so what is sent grows with the fourth power of the
    logarithm of the number of blocks; larger blocks send less. Time grows in the same way.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(slim.mapInArrow(fingerprints(n, seed), f"doc_id {kind}, fp long"), "simhash-prints")
    # Zero and the like may be a third of all rows: each task counts it once before anything is sent.
    prints = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = classes(prints.select("fp"), most, block, together)
    own = materialize(found.join(prints, found["key"] == prints["fp"]).select("fp", "label", "least"), "simhash-least")
    names = own.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(own.join(names, "label").select("fp", "component_id"), "simhash-names")
    discard(found, prints, own)
    return signed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
