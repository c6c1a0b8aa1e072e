"""The Merkle manifest, hard negatives and SimHash components against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import hard_negatives, merkle, queries, simhash
from tessella.llm.order import numbered

from ..compare import assert_same, connection
from .helpers import LONG, frame, texts, words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_hard_negatives"])
def test_twin(spark, name):
    from tessella.llm.oracles import ORACLES

    assert_same(queries.QUERIES[name](spark, FOLDER), connection(FOLDER), ORACLES[name])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def proofs(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of the nodes and each one's siblings, left and right, level by level."""
    found = [[] for _ in nodes]
    spots = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(spots):
            first = at - at % arity
            found[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + arity])))
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        spots = [at // arity for at in spots]
    return nodes[0], found


@pytest.mark.parametrize(("arity", "depth"), [(2, 1), (2, 2), (2, 6), (3, 2), (5, 1)])
def test_manifest(spark, arity, depth):
    rng = random.Random(arity)
    rows = [(None, None, sha("n"))] + [(rng.choice([None, "b", "ä", "a", "hot", "hot", "hot"]), i, sha(str(i))) for i in range(90)] + [("one", 5, sha("z")), ("a", 7, sha("x")), ("a", 7, sha("x")), ("a", None, sha("y"))]
    held = spark.createDataFrame([(*r, "c", 1) for r in rows], "g string, i long, leaf string, root string, size int").repartition(5)
    made = merkle.manifest(held, "g", "i", "leaf", arity=arity, depth=depth).collect()
    groups = defaultdict(list)
    for g, i, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: proofs([x[2] for x in sorted(groups[g])], arity) for g in names}
    root, upper = proofs([inner[g][0] for g in names], arity)
    expected = Counter()
    for g, over in zip(names, upper):
        for (some, i, leaf), own in zip(sorted(groups[g]), inner[g][1]):
            expected[(g, i if some else None, leaf, inner[g][0], root, tuple(own + over))] += 1
    assert Counter((r.g, r.i, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in made) == expected


def test_manifest_of_awkward_rows(spark, tmp_path, monkeypatch):
    docs = frame(spark).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id"))).withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") == 2, (1 << 63) - 1).otherwise(F.col("n_chars")))
    docs = docs.union(docs.where("doc_id = 7"))
    monkeypatch.setattr(queries, "table", lambda s, d, t: docs)
    made = queries.op11_merkle_manifest(spark, "").collect()
    expected = Counter()
    for r in docs.collect():
        told = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text))
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
        expected[(r.doc_id, sha(told), not changed)] += 1
    assert Counter((r.doc_id, r.leaf, r.verified) for r in made) == expected
    assert all((r.folded_root == r.root) == r.verified for r in made) and len({r.root for r in made}) == 1
    assert not all(r.verified for r in made)


def test_one_leaf_and_none(spark):
    one = spark.createDataFrame([("g", 1, sha("x"))], "g string, i long, leaf string")
    made = merkle.manifest(one, "g", "i", "leaf").collect()
    assert [(r.leaf, r.subroot, r.root, r.proof) for r in made] == [(sha("x"), sha("x"), sha("x"), [])]
    assert merkle.manifest(one.where("false"), "g", "i", "leaf").count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i * 7 % 100) for i in range(100)], "g string, v long").repartition(6)
    made = numbered(rows, ["g"], ["v"], "test").collect()
    for g in (None, "a"):
        held = sorted(r.v for r in made if r.g == g)
        assert [(r.v, r.size) for r in sorted((r for r in made if r.g == g), key=lambda r: r.at)] == [(v, len(held)) for v in held]
        assert sorted(r.at for r in made if r.g == g) == list(range(len(held)))


def plain_negatives(rows, anchor, positives, negatives, low, high, scale=256):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        made = (label, [math.floor(scale * x) for x in v])
        held[i] = min(held.get(i, made), made)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for a, (label, v) in held.items():
        if not anchor(a):
            continue
        scores = sorted((-dot(v, w), i, other == label) for i, (other, w) in held.items() if i != a)
        for p, pid, same in [s for s in scores if s[2]][:positives]:
            inside = [s for s in scores if not s[2] and low * -p <= 100 * -s[0] <= high * -p]
            for rank, (n, nid, _) in enumerate(inside[:negatives], 1):
                out[(a, pid, rank, nid, -p, -n)] += 1
    return out


@pytest.mark.parametrize(("scale", "wide", "slab"), [(256, 1.0, 32 << 20), (256, 1.0, 3000), (1 << 12, 1.0, 32 << 20), (1, 1e8, 32 << 20)])
def test_negatives(spark, scale, wide, slab):
    """All three carriers, several slabs, ties, repeated ids and rows that take no part."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 12)) * wide
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + rng.normal(size=12) * 0.4 * wide], int(i % 4)) for i in range(400)]
    rows += [(i, rows[0][1], 1) for i in range(400, 460)] + [(i, [0.0] * 12, 2) for i in range(460, 470)]
    rows += [(500, None, 1), (501, [None] + [0.1] * 11, 1), (502, [float("nan")] + [0.1] * 11, 1), (503, [float("inf")] + [0.1] * 11, 1), (504, rows[1][1], None), (None, rows[1][1], 1), (10, rows[3][1], 0), (10, rows[3][1], 0), (505, rows[2][1][:5], 3), (506, [], 3)]
    held = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, anchor_id string, score int").repartition(7)
    made = hard_negatives.mine(held, F.col("id") % 10 == 0, scale=scale, slab_bytes=slab)
    expected = plain_negatives(rows, lambda i: i % 10 == 0, 5, 10, 30, 90, scale)
    assert Counter(tuple(r) for r in made.collect()) == expected and len(expected) > 100
    assert hard_negatives.mine(held.where("false"), F.col("id") % 10 == 0).count() == 0


def test_packed_products():
    rng = np.random.default_rng(5)
    for top, kind in ((100, np.float64), (3000, np.int64), (1 << 28, object)):
        a, b = rng.integers(-top, top, (7, 30)), rng.integers(-top, top, (41, 30))
        packed = hard_negatives.Packed(b, int(b.min()), int(b.max()), int(np.abs(a).sum(axis=1).max()))
        assert packed.kind is kind and packed.fields > 1
        assert (packed.products(a) == a @ b.T).all()
    assert (hard_negatives.Packed(np.full((3, 2), -5), -5, -5, 0).products(np.zeros((1, 2), np.int64)) == 0).all()


def plain_print(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints: list[int], most: int) -> list[int]:
    keys = np.array(prints, np.uint64)
    label = list(range(len(keys)))
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys[i] ^ keys[: i + 1]) <= most).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints():
    rows = texts()
    for t in (*rows.values(), " ".join(f"w{i}" for i in range(200_000)), "x" * 3_000_000 + " a b", "ABC  Def\tGHI\x0bj É"):
        assert simhash.fingerprint((t or "").encode()) == plain_print(t)


@pytest.mark.parametrize("block", [32768, 16, 3])
def test_simhash(spark, block):
    rows = texts()
    for i in range(60, 90):
        rows[i] = " ".join(f"near{k}" if k != i * 5 else f"moved{i}" for k in range(400))
    ids = sorted(rows)
    prints = [plain_print(rows[i]) for i in ids]
    label = plain_components(prints, 4)
    expected = Counter((i, f"{p:016x}", ids[a]) for i, p, a in zip(ids, prints, label))
    docs = frame(spark, list(rows.items())).repartition(5)
    made = simhash.simhash_components(docs, block=block, together=2)
    assert Counter(tuple(r) for r in made.collect()) == expected and len({a for *_, a in expected}) > 10
    if block == 16:
        assert simhash.simhash_components(docs.where("false")).count() == 0
        nameless = simhash.simhash_components(frame(spark, [(1, "a")]).selectExpr("cast(null as long) as doc_id", "text").union(frame(spark, [(1, "a b"), (2, "a b"), (2, "a b")]).select("doc_id", "text")))
        assert sorted((r.doc_id, r.component_id) for r in nameless.collect() if r.doc_id is not None) == [(1, 1), (2, 1), (2, 1)]
        assert [r.component_id for r in nameless.collect() if r.doc_id is None] == [None]


@pytest.mark.parametrize(("n", "most"), [(1, 4), (2, 4), (700, 4), (700, 0), (400, 12)])
def test_trie_finds_all_components(n, most):
    rng = random.Random(n + most)
    keys = set()
    while len(keys) < n:
        base = rng.choice(sorted(keys)) if keys and rng.random() < 0.6 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 4, 5])):
            base ^= 1 << b
        keys.add(base)
    held = np.array(sorted(keys), np.uint64)
    trie = simhash.Trie(held, np.arange(n), most)
    trie.within()
    assert trie.label.tolist() == plain_components(held.tolist(), most)
    # Halves joined each for itself, then with each other.
    half = n // 2
    if half:
        sides = []
        for part in (held[:half], held[half:]):
            own = simhash.Trie(part, np.arange(len(part)), most)
            own.within()
            sides.append(own.label)
        both = simhash.Trie(held, np.concatenate([sides[0], sides[1] + half]), most)
        both.join(np.array([[0, half, half, n, 0]]), 0)
        assert both.label.tolist() == trie.label.tolist()


def test_dense_ball_of_fingerprints_is_cheap():
    """60,000 fingerprints around one: their pairs are dropped once they are of one component."""
    rng = np.random.default_rng(9)
    keys = np.uint64(0x123456789ABCDEF)
    flips = sum((np.uint64(1) << rng.integers(0, 64, 60_000).astype(np.uint64)) * (rng.random(60_000) < 0.7).astype(np.uint64) for _ in range(3))
    trie = simhash.Trie(np.unique(flips ^ keys), np.arange(len(np.unique(flips ^ keys))), 4)
    seen = 0
    compare = trie.compare

    def counted(pairs):
        nonlocal seen
        seen += len(pairs)
        compare(pairs)

    trie.compare = counted
    trie.within()
    assert seen < 60 * len(trie.keys)


def test_long_text_is_read_in_slices():
    assert simhash.fingerprint((LONG + " ").encode() * 40) == plain_print((LONG + " ") * 40)
