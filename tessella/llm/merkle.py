"""A Merkle manifest of a table: every row a leaf, a tree for each group of rows, one tree over the groups' roots.

Trees are built in aligned blocks of leaves. A block keeps each of its levels as one string of hex digests, all of one
width: a parent is the hash of a substring (its run), and the siblings of a node are the substrings on both sides of it
in its run. The blocks' roots are the leaves of the next round of blocks, so heights multiply and a round is one
shuffle of what is left. Proofs come down the same way: a block adds its own segments to the proof of its root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, discard, materialize
from .order import numbered

#: Hex digits of a digest.
WIDE = 64
SEGMENTS = "array<struct<left: string, right: string>>"


def h(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' bytes, one after the other."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def field(value: Column) -> Column:
    """A value in a leaf: its length in UTF-8 bytes, a colon and its text; a null is a dash, which no length begins with."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(text).cast("string").cast("binary"), F.lit(":").cast("binary"), text.cast("binary")))


def leaf_of(*values: Column) -> Column:
    return h(*(field(v) for v in values))


def height(size: Column, arity: int) -> Column:
    """How many levels of parents a tree of so many leaves has; one leaf has none."""
    return F.size(F.filter(powers(arity, 62), lambda p: p < size))


def powers(arity: int, bits: int) -> Column:
    return F.expr(f"array({', '.join(f'{arity**k}L' for k in range(bits) if arity**k < 1 << bits)})")


def cut(level: Column, first: Column, nodes: Column) -> Column:
    """So many digests of a level from the first (from 0); what is past its end is left out."""
    return F.substring(level, (first * WIDE + 1).cast("int"), (nodes * WIDE).cast("int"))


def parents(level: Column, arity: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (WIDE * arity)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(cut(level, i * arity, F.lit(arity)), 256)), "")


def blocks_of(nodes: DataFrame, keep: list[str], arity: int, depth: int, name: str) -> DataFrame:
    """(group, block, size, n, levels, kept) of nodes (group, at, size, hash, *keep); levels[0] has the block's own nodes, each next one their parents."""
    wide = arity**depth
    dealt = nodes.groupBy("group", F.floor(F.col("at") / wide).alias("block"), "size").agg(F.array_sort(F.collect_list(F.struct("at", "hash", *keep))).alias("held"))
    steps = F.slice(F.array(*(F.lit(i) for i in range(depth))), F.lit(1), F.least(F.lit(depth), height(F.col("size"), arity)))
    own = F.array(F.array_join(F.transform("held", lambda x: x["hash"]), ""))
    levels = F.aggregate(steps, own, lambda made, _: F.concat(made, F.array(parents(F.element_at(made, -1), arity))))
    kept = F.transform("held", lambda x: F.struct(*(x[c].alias(c) for c in keep))) if keep else F.lit(None).cast("string")
    return materialize(dealt.select("group", "block", "size", F.size("held").alias("n"), levels.alias("levels"), kept.alias("kept")), name)


def segments(levels: Column, i: Column, arity: int) -> Column:
    """The siblings of node i of a block, level by level: what stands left and right of it in its run."""
    def beside(level: Column, k: Column) -> Column:
        node = F.floor(i / F.get(powers(arity, 31), k))
        place = F.pmod(node, F.lit(arity))
        return F.struct(cut(level, node - place, place).alias("left"), cut(level, node + 1, arity - 1 - place).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def grown(nodes: DataFrame, keep: list[str], arity: int, depth: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all rounds, and (group, hash) of each group's root."""
    wide, rounds, tops = arity**depth, [], []
    while True:
        blocks = blocks_of(nodes, keep if not rounds else [], arity, depth, f"{name}-{len(rounds)}")
        rounds.append(blocks)
        tops.append(blocks.where(F.col("size") <= wide).select("group", F.element_at("levels", -1).alias("hash")))
        nodes = blocks.where(F.col("size") > wide).select("group", F.col("block").alias("at"), F.ceil(F.col("size") / wide).alias("size"), F.element_at("levels", -1).alias("hash"))
        if nodes.isEmpty():
            return rounds, reduce(DataFrame.unionByName, tops)


def told(rounds: list[DataFrame], over: DataFrame, arity: int, depth: int) -> DataFrame:
    """(group, i, kept, leaf, subroot, proof) of the first round's nodes; over has group, subroot and the proof of a group's root."""
    wide, known = arity**depth, None
    for k, blocks in reversed(list(enumerate(rounds))):
        # A group's last block takes up the proof of the group's root, any other that of its own root one round higher.
        ends = over.join(blocks.where(F.col("size") <= wide).select(F.col("group").alias("__of")), F.col("group").eqNullSafe(F.col("__of"))).select("group", F.lit(0).cast("long").alias("up"), "subroot", "proof")
        above = (ends if known is None else ends.unionByName(known)).select(F.col("group").alias("__of"), "up", "subroot", "proof")
        met = blocks.join(above, F.col("group").eqNullSafe(F.col("__of")) & (F.col("block") == F.col("up")))
        rows = met.select("group", "block", "subroot", "levels", F.col("proof").alias("__rest"), F.posexplode("kept" if not k else F.sequence(F.lit(0), F.col("n") - 1)).alias("i", "kept"))
        proof = F.concat(segments(F.col("levels"), F.col("i"), arity), "__rest").alias("proof")
        if k:
            known = rows.select("group", (F.col("block") * wide + F.col("i")).alias("up"), "subroot", proof)
        else:
            return rows.select("group", "kept", cut(F.get("levels", F.lit(0)), F.col("i"), F.lit(1)).alias("leaf"), "subroot", proof)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings of a proof, level by level from the leaf's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, group_col: str, id_col: str, leaf_col: str, keep: tuple[str, ...] = (), arity: int = 2, depth: int = 6) -> DataFrame:
    """Per row: group_col, id_col, the columns of keep, leaf, subroot, root, and proof (array of left and right siblings).

    leaf_col holds lowercase hex digests. In a group leaves ascend by id (null first), rows of one id by leaf, so
    repeated rows are leaves of their own. While a level has several nodes, each run of arity nodes is hashed into one,
    the last run with as many as are left, one too. A group of one leaf has that leaf as its subroot. The subroots in
    the order of their groups (null first, strings by bytes) give the root in the same way. proof goes from the leaf's
    level over subroot up to root; fold(leaf, proof) is root. No rows give no rows. Other columns are ignored.

    Only digests and ids move, never texts: one sort by ranges, one shuffle into blocks of arity ** depth leaves and a
    join of as many rows as there are blocks; a group with most of the rows is just many blocks. What reaches the
    driver is the root. Tables in the shared folder that the result doesn't read are deleted.
    """
    own = {id_col: f"{OWN}id", **{c: f"{OWN}keep_{c}" for c in keep}}
    slim = rows.select(F.col(group_col).alias("group"), F.col(leaf_col).alias("hash"), *(F.col(c).alias(n) for c, n in own.items()))
    written = materialize(slim, "merkle-leaves")
    placed = numbered(written, ["group"], [own[id_col], "hash"], "merkle-order")
    rounds, tops = grown(placed, list(own.values()), arity, depth, "merkle-blocks")
    discard(written, placed)
    tops = materialize(tops, "merkle-tops")
    groups = numbered(tops, [], ["group"], "merkle-groups").select(F.lit(0).alias("group"), "at", "size", "hash", F.col("group").alias("name"))
    upper, root = grown(groups, ["name"], arity, depth, "merkle-upper")
    root = (root.first() or {"hash": None})["hash"]
    none = upper[0].select("group").distinct().select("group", F.lit(None).cast("string").alias("subroot"), F.expr(f"cast(array() as {SEGMENTS})").alias("proof"))
    over = told(upper, none, arity, depth).select(F.col("kept.name").alias("group"), F.col("leaf").alias("subroot"), "proof")
    found = told(rounds, over, arity, depth)
    return found.select(F.col("group").alias(group_col), *(F.col(f"kept.{n}").alias(c) for c, n in own.items()), F.col("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof")


def changed(manifested: DataFrame, leaf: Column) -> DataFrame:
    """The rows of a manifest with folded_root, what their proof makes of the given leaf, and verified, whether that is the root."""
    return manifested.withColumn("folded_root", fold(leaf, F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))
