"""Exact duplicates: partitions by length and content hash, each one a Patricia trie of whole byte strings.

First each task inserts the texts it reads into a trie of its own, so a text that a third of all rows repeat leaves
every task once. What remains is dealt out by length and content hash, and a second trie per task compares whole byte
strings: equal means equal bytes, never equal hashes. A terminal node holds one owner and a count, never the ids of
its group: rows carry the number of their node, and nodes are looked up by joins of small rows. A trie that outgrows
its budget sends its heaviest subtree, and all that comes for it later, to the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shards_for, texts

LABEL, CHILDREN, OWNER = 0, 1, 2
#: What a node takes beside its label, in bytes, about.
NODE = 300


def common_length(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of label equal those of key from at on; they differ somewhere."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie. A terminal node's owner is a list [number of the node, best row, count]."""

    def __init__(self, first: int = 0) -> None:
        self.root: list = [b"", {}, None]
        self.bytes, self.next = 0, first

    def insert(self, key: bytes, best: tuple, count: int = 1) -> int:
        """The number of the key's node; its owner is the largest best, its count the sum of counts."""
        node, at = self.root, 0
        while at < len(key):
            child = node[CHILDREN].get(key[at])
            if child is None:
                child = node[CHILDREN][key[at]] = [key[at:], {}, None]
                self.bytes += len(key) - at + NODE
                node, at = child, len(key)
                break
            label = child[LABEL]
            if not key.startswith(label, at):
                shared = common_length(label, key, at)
                middle = [label[:shared], {label[shared]: child}, None]
                child[LABEL] = label[shared:]
                node[CHILDREN][key[at]] = middle
                self.bytes += NODE
                child = middle
            node, at = child, at + len(child[LABEL])
        if node[OWNER] is None:
            node[OWNER] = [self.next, best, count]
            self.next += 1
        else:
            own = node[OWNER]
            own[1], own[2] = max(own[1], best), own[2] + count
        return node[OWNER][0]

    def walk(self, node: list | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Each string with its owner."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node[OWNER] is not None:
                yield prefix, node[OWNER]
            stack += [(child, prefix + child[LABEL]) for child in node[CHILDREN].values()]

    def cut(self) -> tuple[bytes, list] | None:
        """Take out the largest subtree below the first fork: its prefix and top node; None if there is no fork."""
        node, prefix = self.root, b""
        while len(node[CHILDREN]) == 1 and node[OWNER] is None:
            node = next(iter(node[CHILDREN].values()))
            prefix += node[LABEL]
        if not node[CHILDREN] or node is self.root and len(node[CHILDREN]) == 1 and node[OWNER] is None:
            return None
        weights = {first: self.weight(child) for first, child in node[CHILDREN].items()}
        first = max(weights, key=weights.get)
        self.bytes -= weights[first]
        child = node[CHILDREN].pop(first)
        return prefix + child[LABEL], child

    @staticmethod
    def weight(node: list) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x[LABEL]) + NODE
            stack += x[CHILDREN].values()
        return total


# Rows of one table. A node is (part, node); a row is (part, row) and best is the largest (id, part, row) by these rules.
#   MEMBER  doc_id and row, the node of its text in the task that read it
#   TEXT    a node of such a task: its text, best row and count
#   LINK    from such a node to the node of a later trie
#   GROUP   a node of a later trie: best row, count, digest
#   SPILLED as TEXT, sent to the next round
MEMBER, TEXT, LINK, GROUP, SPILLED = range(5)
ROWS = pa.schema(
    [(n, t) for n, t in (("kind", pa.int32()), ("part", pa.int64()), ("node", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("to_part", pa.int64()), ("to_node", pa.int64()))]
    + [(n, t) for n, t in (("best_known", pa.bool_()), ("best_id", pa.int64()), ("best_part", pa.int64()), ("best_row", pa.int64()), ("n", pa.int64()), ("n_bytes", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("sha256", pa.string()))]
)
KINDS = "kind int, part long, node long, doc_id long, row long, to_part long, to_node long, best_known boolean, best_id long, best_part long, best_row long, n long, n_bytes long, hash long, text binary, sha256 string"


class Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.size = 0

    def add(self, kind: int, **values) -> None:
        self.rows.append({"kind": kind, **values})
        self.size += 64 + len(values.get("text") or b"")

    def flush(self, least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=ROWS)
            self.rows, self.size = [], 0

    def add_text(self, kind: int, part: int, key: bytes, owner: list) -> None:
        node, (known, best_id, best_part, best_row), n = owner
        self.add(kind, part=part, node=node, best_known=known, best_id=best_id, best_part=best_part, best_row=best_row, n=n, n_bytes=len(key), hash=xxhash.xxh3_64_intdigest(key) - 2**63, text=key)


def local_owners(normalise: Callable[[bytes], bytes], budget: int) -> Callable:
    """Rows MEMBER and TEXT from (doc_id, text, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, row, part = PatriciaTrie(), Out(), 0, 0

        def texts_out() -> Iterator[pa.RecordBatch]:
            for key, owner in trie.walk():
                out.add_text(TEXT, part, key, owner)
                yield from out.flush()

        for batch in batches:
            for doc, text, part in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                # Of equal ids the first row of the first task is the best; a row with an id is better than one without.
                node = trie.insert(normalise(text), (doc is not None, doc or 0, -part, -row))
                out.add(MEMBER, part=part, node=node, doc_id=doc, row=row)
                row += 1
                if trie.bytes > budget:
                    yield from texts_out()
                    trie = PatriciaTrie(trie.next)
            yield from out.flush()
        yield from texts_out()
        yield from out.flush(0)

    return run


def final_owners(budget: int, round_: int) -> Callable:
    """Rows LINK and GROUP, and SPILLED for the next round, from rows TEXT or SPILLED. The parts of these tasks are negative, those of the first tasks are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, part, spilled = PatriciaTrie(), Out(), None, ()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    part = -(r.pop("task") << 20 | round_) if part is None else part
                    r.pop("task", None)
                    key = r["text"]
                    if spilled and key.startswith(spilled):
                        out.add(**(r | {"kind": SPILLED}))
                        continue
                    node = trie.insert(key, (r["best_known"], r["best_id"], r["best_part"], r["best_row"]), r["n"])
                    out.add(LINK, part=r["part"], node=r["node"], to_part=part, to_node=node)
                    if trie.bytes > budget and (gone := trie.cut()):
                        # The nodes of the subtree go on as texts of this task: its links stay right.
                        spilled += (gone[0],)
                        for key, owner in trie.walk(gone[1], gone[0]):
                            out.add_text(SPILLED, part, key, owner)
                            yield from out.flush()
                yield from out.flush()
        for key, (node, (known, best_id, best_part, best_row), n) in trie.walk():
            out.add(GROUP, part=part, node=node, best_known=known, best_id=best_id, best_part=best_part, best_row=best_row, n=n, sha256=hashlib.sha256(key).hexdigest())
            yield from out.flush()
        yield from out.flush(0)

    return run


def ascii_lower(text: bytes) -> bytes:
    """bytes.lower() changes A-Z only."""
    return text.lower()


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[bytes], bytes] = ascii_lower, local_bytes: int = 48 << 20, trie_bytes: int = 192 << 20) -> DataFrame:
    """Which row stays of each group of equal texts.

    Returns one row per input row: doc_id, keep_id (the largest id of the group), group_size, kept, text_sha256.
    A null text counts as empty, so all null and empty texts form one group. One row of each group is kept: of rows that
    share the largest id one of them, and where all ids of a group are null, keep_id is null and one row is kept.
    Other columns are ignored; an empty table gives no rows. local_bytes and trie_bytes bound a task's memory; past
    trie_bytes subtrees go through further rounds.
    """
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.spark_partition_id().alias("part"))
    # Written once: the numbers of rows and nodes must not change when a lost executor's work is done again.
    local = materialize(slim.mapInArrow(local_owners(normalise, local_bytes), KINDS), "exact-local")
    todo, links, round_ = local.where(F.col("kind") == TEXT), None, 0
    while True:
        keys = ("n_bytes", F.xxhash64("hash", F.lit(round_)))
        if round_:
            # Spilled texts are dealt out otherwise, over so many tasks that their tries keep to the budget.
            size = todo.agg(F.sum(F.col("n_bytes") + NODE)).first()[0]
            dealt = todo.repartition(shards_for(size, max(1, trie_bytes // 2), 1), *keys)
        else:
            dealt = todo.repartition(*keys)
        dealt = dealt.withColumn("task", F.spark_partition_id().cast("long") + 1)
        made = materialize(dealt.mapInArrow(final_owners(trie_bytes, round_), KINDS), "exact-groups")
        links = made if links is None else links.unionByName(made)
        todo, round_ = made.where(F.col("kind") == SPILLED), round_ + 1
        if todo.isEmpty():
            break
    per_node = chained(links, round_)
    members = local.where(F.col("kind") == MEMBER).select("doc_id", "part", "node", "row")
    best = (F.col("best_part") == -F.col("part")) & (F.col("best_row") == -F.col("row"))
    return members.join(per_node, ["part", "node"]).select("doc_id", F.when(F.col("best_known"), F.col("best_id")).alias("keep_id"), F.col("n").alias("group_size"), best.alias("kept"), F.col("sha256").alias("text_sha256"))


def chained(rows: DataFrame, rounds: int) -> DataFrame:
    """(part, node, best_*, n, sha256) of each node of the first tasks: its link, as often as its text was spilled the next one."""
    links = rows.where(F.col("kind") == LINK).select("part", "node", "to_part", "to_node")
    groups = rows.where(F.col("kind") == GROUP).select(F.col("part").alias("to_part"), F.col("node").alias("to_node"), "best_known", "best_id", "best_part", "best_row", "n", "sha256")
    found, open_ = None, links
    for _ in range(rounds):
        done = open_.join(groups, ["to_part", "to_node"]).drop("to_part", "to_node")
        found = done if found is None else found.unionByName(done)
        onward = links.select(F.col("part").alias("to_part"), F.col("node").alias("to_node"), F.col("to_part").alias("next_part"), F.col("to_node").alias("next_node"))
        open_ = open_.join(onward, ["to_part", "to_node"]).select("part", "node", F.col("next_part").alias("to_part"), F.col("next_node").alias("to_node"))
    return found
