"""The pipeline stage by stage against plain versions, and the registered queries against their SQL."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import oracles, packing, queries
from tessella.llm.line_dedup import key_of

from ..compare import assert_same, connection
from .helpers import frame, near_classes, words
from .test_shaping import targets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = frame(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = stage(spark, docs, "")
        assert docs.columns == frame(spark).columns
        after = docs.collect()
        ids = {i for i, _ in before}
        assert {r.doc_id for r in after} <= ids
        if name == "quality_rules":
            assert all(len(words(r.text)) >= 10 for r in after) and {22, 30, 12} <= {r.doc_id for r in after}
        if name == "line_dedup":
            assert {r.doc_id for r in after} == ids and all(r.n_chars == len(r.text) for r in after)
            held = [r.doc_id for r in after for x in r.text.split("\n") if key_of(x).startswith("this line of more")]
            assert len(set(held)) <= 1
        if name == "jaccard_join":
            classes = near_classes(dict(before))
            assert {r.doc_id for r in after} == {i for i in ids if classes[i][0] == i}
        if name == "mixing":
            # Against filling up step by step: each source near its target, no document more than twice, none that wasn't there.
            n = {r: len(words(r[1])) for r in before}
            source = {(r.doc_id, r.text): r.source for r in after}
            held = {r.doc_id: r.source for r in kept}
            sizes: dict = {}
            for (i, t), size in n.items():
                sizes[held[i]] = sizes.get(held[i], 0) + size
            times = Counter((r.doc_id, r.text) for r in after)
            assert set(times) <= before and max(times.values()) <= 2 and all(source[k] == held[k[0]] for k in times)
            for s_, target in targets(sizes).items():
                taken = sum(n[k] * c for k, c in times.items() if held[k[0]] == s_)
                most = max(size for (i, _), size in n.items() if held[i] == s_)
                assert target - most <= taken <= target + 1e-6
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    by_doc = Counter(r.doc_id for r in docs.collect())
    # A document that the mix takes twice is packed twice; the pieces of each time are whole and fit.
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert {i: sum(r.doc_id == i and r.piece == 0 for r in packed) for i in by_doc} == dict(by_doc)
    once = {r.doc_id: r.text for r in docs.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in once.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = [r for r in packed if r.doc_id == i]
        assert sum(r.length for r in own) == len(ids) * by_doc[i]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) == packing.solved(np.bincount([r.length for r in packed], minlength=1025), 1024)[1]


def test_empty_table_goes_through(spark):
    docs = frame(spark, empty=True)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_twin(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), connection(FOLDER), oracles.ORACLES[name])


def test_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *queries.QUERIES} <= set(entry.queries()) and len(queries.QUERIES) == 13
