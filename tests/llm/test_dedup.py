"""Exact, substring, line and near duplicates against plain versions."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bloom, exact_dedup, kernels, line_dedup, near_dup, suffix_dedup

from .helpers import frame, near_classes, shingles, texts


def got(frame_, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame_.collect())


def test_exact(spark):
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[(t or "").encode().lower()].append(i)
    expected = Counter((i, max(g), len(g), i == max(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g)
    assert got(exact_dedup.exact_owners(frame(spark).repartition(5)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected
    assert exact_dedup.exact_owners(frame(spark, empty=True)).count() == 0


def test_exact_repeated_rows_and_null_ids(spark):
    d = frame(spark, [(1, "a"), (1, "A"), (None or 2, "b")]).union(frame(spark, [(1, "z")]).selectExpr("cast(null as long)", "'A'", *frame(spark).columns[2:]))
    out = exact_dedup.exact_owners(d).collect()
    assert sum(r.kept for r in out) == 2 and len(out) == 4 and [r.kept for r in out if r.doc_id is None] == [False]
    alone = exact_dedup.exact_owners(d.where("doc_id is null").union(d.where("doc_id is null"))).collect()
    assert sorted(r.kept for r in alone) == [False, True] and {(r.keep_id, r.group_size) for r in alone} == {(None, 2)}
    assert {r.keep_id for r in out if r.doc_id != 2} == {1}


@pytest.mark.parametrize("budgets", [{}, {"trie_bytes": 20_000, "local_bytes": 5000}])
def test_exact_in_any_memory(spark, budgets):
    rng = np.random.default_rng(1)
    keys = ["".join(rng.choice(list("ab"), size=int(n))) for n in rng.integers(0, 12, 300)] + ["", "x" * 5000, "x" * 5000 + "y", None]
    rows = dict(enumerate(keys))
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[t or ""].append(i)
    out = got(exact_dedup.exact_owners(frame(spark, list(rows.items())).repartition(3), **budgets), "doc_id", "keep_id", "group_size", "kept")
    assert out == Counter((i, max(g), len(g), i == max(g)) for g in groups.values() for i in g)


def test_trie_holds_one_owner_of_a_key():
    trie = exact_dedup.PatriciaTrie()
    numbers = [trie.insert(k, (True, i, 0, -i)) for i, k in enumerate([b"abc", b"abd", b"abc", b"", b"ab", b"abc"])]
    assert numbers[0] == numbers[2] == numbers[5] and len(set(numbers)) == 4
    held = {k: (o[1][1], o[2]) for k, o in trie.walk()}
    assert held == {b"abc": (5, 3), b"abd": (1, 1), b"": (3, 1), b"ab": (4, 1)}
    prefix, node = trie.cut()
    assert {k for k, _ in trie.walk(node, prefix)} | {k for k, _ in trie.walk()} == set(held) and all(k.startswith(prefix) for k, _ in trie.walk(node, prefix))


def plain_repeats(rows: dict) -> dict:
    seen, out = {}, {}
    for i in sorted(rows):
        b = (rows[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeated_substrings(spark):
    rows = texts()
    out = suffix_dedup.remove_repeats(frame(spark).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == plain_repeats(rows) and len(out) == len(rows)
    assert suffix_dedup.remove_repeats(frame(spark, empty=True)).count() == 0


def test_repeated_substrings_at_random(spark):
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abé "), size=int(n))) for n in rng.integers(1, 120, 25)]
    rows = {i: "".join(parts[k] for k in rng.integers(0, 25, 6)) for i in range(60)}
    out = suffix_dedup.remove_repeats(frame(spark, list(rows.items()))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == plain_repeats(rows)


def test_repeated_ids_are_one_document(spark):
    from .helpers import PASSAGE

    out = suffix_dedup.remove_repeats(frame(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)])).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in out) == [(1, False), (1, False), (2, True)]


def test_suffix_orders():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, (300, suffix_dedup.AROUND)).astype(np.uint8)
    text[100:200] = text[:100]
    bucket, rank = rng.integers(0, 3, 300).astype(np.uint64), suffix_dedup.cover_ranks(text)
    for column in range(suffix_dedup.SPAN):
        keys = [(int(bucket[i]), text[i, column:].tobytes()) for i in suffix_dedup.suffix_order(column, text, bucket, rank)]
        assert keys == sorted(keys)


@pytest.mark.parametrize("hot, part", [(3, 7), (10**9, 7)])
def test_hot_passages_are_split_up(hot, part, monkeypatch):
    """The stages one after another, as tasks of another process would not see the changed bounds."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_PART", part)
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdef "), size=130))
    rows = {i: "".join(rng.choice(list("abcdef "), size=int(rng.integers(0, 90)))) + passage + "".join(rng.choice(list("abcdef "), size=60)) for i in range(40)}
    rows |= {50: rows[3], 51: None, 52: passage[:60], 53: passage[40:]}
    batch = pa.RecordBatch.from_pydict({"id": list(rows), "text": list(rows.values()), "group": [i % 3 for i in rows]}, pa.schema([("id", pa.int64()), ("text", pa.string()), ("group", pa.int32())]))
    parts = [batch.slice(0, 20), batch.slice(20)]
    held: dict = {}
    sent = [b for p in parts for b in suffix_dedup.sent_anchors(2)(iter([p.select(["text"])]))]
    for s in (0, 1):
        own = [b.filter(pa.array([x == s for x in b.column(0).to_pylist()])) for b in sent]
        for b in suffix_dedup.anchor_filters(2, 10_000, 1 << 20)(iter(own)):
            held |= {r["shard"]: (r["bits"], r["hot"]) for r in b.to_pylist()}
    assert any(h for _, h in held.values()) == (hot == 3)

    class Shared:
        value = held

    rows_ = [r for p in parts for b in suffix_dedup.surroundings(Shared, 2, 4)(iter([p])) for r in b.to_pylist()]
    made = [b for k in range(4) for b in suffix_dedup.sorted_buckets(iter([pa.RecordBatch.from_pylist([r for r in rows_ if not r["kind"] and r["key"] == k], suffix_dedup.SENT)]))]
    marks = [r for r in rows_ if r["kind"]] + [r for b in made for r in b.to_pylist()]
    marks = [r for k in range(3) for b in suffix_dedup.merged_marks(iter([pa.RecordBatch.from_pylist([r for r in marks if r["key"] == k], suffix_dedup.SENT)])) for r in b.to_pylist()]
    assert len(marks) <= 3
    starts: dict = defaultdict(set)
    for r in marks:
        for m in suffix_dedup.unpacked(r["data"], r["n"], suffix_dedup.MARK)[0]:
            starts[int(m["doc"])] |= set(range(int(m["start"]), int(m["stop"])))
    seen: dict = {}
    for i in sorted(rows):
        t = (rows[i] or "").encode()
        assert starts[i] == {k for k in range(len(t) - 49) if seen.setdefault(t[k : k + 50], i) < i}


def test_long_documents_and_null_ids(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh "), size=1_300_000))
    rows = [(1, long[600_000:600_300]), (2, long), (3, long[:520_000] + "##" + long[524_200:524_400]), (None, long[1_200_000:]), (None, "")]
    out = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    found = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in out}
    assert found == {(1, 300): (0, 0), (2, 1_300_000): (300, 1), (3, 520_202): (520_200, 2), (None, 100_000): (100_000, 1), (None, 0): (0, 0)}


def test_lines(spark):
    rows = texts()
    holders = defaultdict(set)
    for i, t in rows.items():
        for line in (t or "").split("\n"):
            if len(k := line_dedup.key_of(line)) >= 40:
                holders[k].add(i)
    owner = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = line_dedup.drop_repeated_lines(frame(spark).repartition(4)).collect()
    for r in out:
        lines = (rows[r.doc_id] or "").split("\n")
        kept = [x for x in lines if owner.get(line_dedup.key_of(x), r.doc_id) == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert len(out) == len(rows) and sum(r.n_dropped for r in out) > 5
    assert line_dedup.drop_repeated_lines(frame(spark, empty=True)).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_lines_do_not_depend_on_the_filter(spark, most):
    rows = [(i, "\n".join(f"line number {k} that is long enough to be counted as such" for k in range(i % 7, i % 7 + 40))) for i in range(30)]
    whole = got(line_dedup.drop_repeated_lines(frame(spark, rows)), "doc_id", "kept_text")
    assert got(line_dedup.drop_repeated_lines(frame(spark, rows), filter_bytes=most), "doc_id", "kept_text") == whole


def test_lines_count_documents_and_not_rows(spark):
    line = "a line of text that is certainly longer than forty characters"
    few = [(1, line), (1, line), (1, line), (2, line), (3, line)]
    assert {r.n_dropped for r in line_dedup.drop_repeated_lines(frame(spark, few)).collect()} == {0}
    many = frame(spark, [*few, (4, line), (5, line), (5, line)])
    many = many.union(many.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    out = line_dedup.drop_repeated_lines(many).collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept_text) for r in out) == sorted([(0, 0, line)] * 3 + [(1, 1, "")] * 3 + [(i, 1, "") for i in (2, 3, 4)] + [(5, 0, line)] * 2)


def test_filters_fold_to_what_they_hold():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**64, 500, dtype=np.uint64)
    whole = bloom.Bloom(1 << 20)
    whole.add(hashes)
    small = bloom.folded(whole, 500, 1 << 30)
    assert small.size == 8192 and small.hits(hashes).all() and small.hits(rng.integers(0, 2**64, 10_000, dtype=np.uint64)).mean() < 0.02
    assert bloom.folded(whole, 500, 1024).size == 1024 and bloom.folded(whole, 500, 1024).hits(hashes).all()


def test_near_copies(spark):
    rows = texts()
    out = near_dup.jaccard_classes(frame(spark).repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == near_classes(rows) and len(out) == len(rows)


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = {i: t for i, t in texts().items() if 20 <= i < 40} | {50: None}
    kept = near_dup.one_of_each_class(frame(spark, list(rows.items())))
    classes = near_classes(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if classes[i][0] == i)
    assert kept.columns == frame(spark).columns


def test_rows_without_words_and_repeated_rows(spark):
    near = texts()
    pair = [(None, "x y"), (None, "x y"), (4, ""), (4, "")]
    out = near_dup.one_of_each_class(frame(spark, pair)).collect()
    assert len(out) == 4
    copies = [(7, near[22]), (7, near[22]), (7, near[30]), (8, near[22]), (8, near[23]), (9, "a text of its own with several words"), (9, "another text that has the same id")]
    out = near_dup.one_of_each_class(frame(spark, pair + copies).repartition(3)).collect()
    told = Counter((r.doc_id, r.text) for r in out)
    assert told == Counter({(None, "x y"): 2, (4, ""): 2, (7, near[22]): 1, (7, near[30]): 1, (9, copies[5][1]): 1, (9, copies[6][1]): 1})
    links = near_dup.jaccard_classes(frame(spark, pair + copies)).collect()
    assert len(links) == 11 and all(r.class_id is None and r.n_links == 0 for r in links if r.doc_id is None)


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    numbers: dict = {}
    sets = [np.array([numbers.setdefault(g, len(numbers)) for g in shingles(rows[i])], np.int64) for i in ids]
    links: Counter = Counter()
    for a, own in enumerate(sets):
        held = np.zeros(len(numbers), bool)
        held[own] = True
        for b in range(a):
            if 0.8 * len(own) <= len(sets[b]) * 1.0001 and 0.8 * len(sets[b]) <= len(own) * 1.0001:
                n = int(held[sets[b]].sum())
                links.update((ids[a], ids[b]) if n and n >= 0.8 * (len(own) + len(sets[b]) - n) - 1e-12 else ())
    found = {r.doc_id: r.n_links for r in near_dup.jaccard_classes(docs).collect()}
    assert sum(links.values()) > 200 and all(found[i] <= links[i] for i in rows)
    assert sum(found.values()) >= 0.999 * sum(links.values())


def test_long_texts_are_hashed_in_slices():
    text = b"word " * 300_000 + b"x" * 1_500_000 + b"\n" + b"tail of some words"
    whole, counts = kernels.word_hashes([text])
    own = {w: (kernels.long_word(w) if len(w) > kernels.GROUP else kernels.word_hashes([w])[0])[0] for w in set(text.split())}
    assert counts.tolist() == [len(whole)] == [300_005] and (whole == np.array([own[w] for w in text.split()])).all()
    assert kernels.long_word(b"tail")[0] == own[b"tail"] and len(next(kernels.shingle_sets([text], 5))) == 6


@pytest.mark.parametrize("block", [64, 3])
def test_near_copies_in_chains_and_bridged_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = {}
    # Only neighbours of a chain are linked; each text is a window over the chain's words.
    for c in range(20):
        for k in range(4 + c % 4):
            rows[len(rows)] = " ".join(f"chain{c}x{w}" for w in range(4 * k, 4 * k + 44))
    # Two clusters of texts in which one word differs, and one text between them that links them.
    for c in range(6):
        for start in (0, 6, 12):
            for k in range(1 if start == 6 else 4):
                rows[len(rows)] = " ".join(f"bridge{c}x{w}" if k == 0 or w != start + 83 else f"other{c}x{k}" for w in range(start, start + 84))
    out = near_dup.jaccard_classes(frame(spark, list(rows.items())).repartition(3)).collect()
    expected = near_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == expected
    assert len({c for c, _ in expected.values()}) == 26 and max(n for _, n in expected.values()) > 3


@pytest.mark.parametrize("one", [True, False])
def test_spanning_forests_keep_all_that_links_connect(one):
    rng = np.random.default_rng(4)
    for n in [2, 4, 12, 30] * 10:
        hit = rng.random((n, n)) < 1.2 / n
        if one:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        parents = near_dup.spanning(hit, one)
        to = 0 if one else n
        links = [(a, b + to) for a, b in np.argwhere(hit).tolist()]
        edges = [(k * n + a, int(p) + (to if k == 0 else 0)) for k, side in enumerate(parents) for a, p in enumerate(side) if p >= 0]
        assert {tuple(sorted(e)) for e in edges} <= {tuple(sorted(e)) for e in links}

        def groups(pairs, size=n + to):
            label = list(range(size))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(i for i in range(size) if label[i] == x) for x in label}

        assert groups(edges) == groups(links) and len(edges) == n + to - len(groups(links))


def template_pages(n: int, shared: int = 60, own: int = 66) -> list[tuple[int, str]]:
    """Pages whose sets of five words have a similarity of about 0.3 through the template that they share."""
    head = " ".join(f"template{k}" for k in range(shared))
    return [(i, head + " " + " ".join(f"own{i}x{k}" for k in range(own))) for i in range(n)]


@pytest.mark.parametrize("block", [8192, 40])
def test_pages_of_a_template_are_no_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BAND_BLOCK", block)
    pages = template_pages(600)
    near = [(1000 + i, pages[i][1].replace("template3 ", f"other{i} ")) for i in range(20)]
    held = frame(spark, pages + near).repartition(3).select("doc_id", "text")
    bands, rows = near_dup.choose_bands(0.8, 0.9999, 128)
    signed = held.mapInArrow(near_dup.signatures(5, bands, rows), "doc_id long, node binary, digest binary, size long, bands array<long>, sketch binary").collect()
    least = near_dup.least_matches(0.8, bands * rows)
    nodes = {bytes(r.node): r.doc_id for r in signed}
    edges = near_dup.candidates(spark.createDataFrame([(r.node, r.bands, r.sketch) for r in signed], "node binary, bands array<long>, sketch binary"), least).collect()
    assert max(Counter(k for r in signed for k in r.bands).values()) > 10
    assert {tuple(sorted((nodes[bytes(e.a)], nodes[bytes(e.b)]))) for e in edges} == {(i, 1000 + i) for i in range(20)}
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.jaccard_classes(held).collect()}
    assert found == {i: (i % 1000, int(i % 1000 < 20)) for i, _ in pages + near}


@pytest.mark.parametrize("sides", [1, 2])
def test_forests_of_sketches_connect_what_all_pairs_do(sides):
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 40):
        base = rng.integers(0, 255, (n // 5 + 1, 50), np.uint8)
        held = [base[rng.integers(0, len(base), n)].copy() for _ in range(sides)]
        for side in held:
            side[rng.random(side.shape) < 0.2] = 255
        edges = [((k, a), (sides - 1 - k, p)) for k, a, p in near_dup.forest(held, 33)]
        plain = [((0, a), (sides - 1, b)) for a in range(n) for b in range(n) if (sides == 2 or a < b) and (held[0][a] == held[-1][b]).sum() >= 33]
        assert {frozenset(e) for e in edges} <= {frozenset(e) for e in plain}

        def groups(pairs):
            label = {x: x for pair in plain for x in pair}
            for a, b in pairs:
                label = {x: label[a] if y == label[b] else y for x, y in label.items()}
            return {frozenset(x for x in label if label[x] == y) for y in label.values()}

        assert groups(edges) == groups(plain) and len(edges) == sum(len(g) - 1 for g in groups(plain))


def test_signatures_say_no_to_hardly_any_link():
    least = near_dup.least_matches(0.8, 125)
    rng = np.random.default_rng(1)
    assert 70 < least < 85 and (rng.binomial(125, 0.8, 100_000) >= least).mean() > 0.9999
    assert near_dup.least_matches(1.0, 10) == 10 and near_dup.least_matches(0.5, 1) == 0


def test_no_near_copies_at_all(spark):
    assert near_dup.jaccard_classes(frame(spark, empty=True)).count() == 0
    out = near_dup.jaccard_classes(frame(spark, [(1, "a b c d e f"), (2, None), (3, "x y")])).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in out} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}


def test_overlaps_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)]
    assert (near_dup.overlaps(sets, sets[:4]) == [[len(np.intersect1d(a, b)) for b in sets[:4]] for a in sets]).all()
    assert near_dup.linked([sets[0]], [sets[0]], Fraction(4, 5))[0, 0]


def test_bands_reach_the_recall():
    bands, rows = near_dup.choose_bands(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        near_dup.choose_bands(0.1, 0.9999, 2)


def test_shingle_sets_equal_when_words_do():
    rows = [t for t in texts().values()]
    sets = list(kernels.shingle_sets([(t or "").encode() for t in rows], 5))
    for a, s in zip(rows, sets):
        assert len(s) == len(shingles(a))
        for b, o in zip(rows, sets):
            assert len(np.intersect1d(s, o)) == len(shingles(a) & shingles(b))


def test_an_anchor_in_one_document_of_each_part_becomes_hot(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    rng = np.random.default_rng(4)
    common, few = (int(x) for x in rng.integers(1, 1 << 40, 2))
    parts = [np.array([common, *([few] if k < 40 else []), *rng.integers(1, 1 << 40, 30).tolist()], np.uint64) for k in range(120)]
    rows = [([0], [suffix_dedup.five_bytes(p)], [suffix_dedup.five_bytes(np.zeros(0, np.uint64))], [b""]) for p in parts]
    batches = [pa.RecordBatch.from_arrays([pa.array(r[0], pa.int32()), *(pa.array(c, pa.binary()) for c in r[1:])], ["shard", "once", "twice", "held"]) for r in rows]
    (made,) = suffix_dedup.anchor_filters(1, 10_000, 1 << 20)(iter(batches))
    hot, again = made["hot"][0].as_py(), made["bits"][0].as_py()
    hot, again = (bloom.Bloom(8 * len(x), np.frombuffer(x, np.uint8)) for x in (hot, again))
    ask = lambda f, x: bool(f.hits(suffix_dedup.from_five(suffix_dedup.five_bytes(np.array([x], np.uint64))))[0])
    assert ask(hot, common) and not ask(hot, few) and ask(again, common) and ask(again, few)
