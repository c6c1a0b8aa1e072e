"""Pages, rules, chats, packing, mixing and the byte network."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import chat_format, html_extract, mixing, packing, quality_cnn, quality_rules

from .helpers import LONG, frame, texts, words

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<main><article><h1>A  title</h1><p>First &amp; <b>bold</b>er text&nbsp;here.<br>Next</p><div class="advert">Buy this now</div><p>&#83;econd paragraph.</p><aside>Aside</aside><form><input>Mail</form><p>End.</p></article>
<section id="comments"><p>I liked this article very much, thank you for all of it.</p></section></main><!-- c --><footer>&copy; 2024 Site</footer></body></html>"""
PLAIN = "<div><a href=1>Home</a> <a href=2>About us</a></div>" + "<div><p>" + "Long text of the page. " * 8 + "</p><p>Short.</p><p>" + "More text follows here. " * 8 + "</p></div><div class=sidebar>" + "other words " * 30 + "</div><div>&copy; 2024 all rights reserved</div>"


def test_article_text():
    assert html_extract.main_text(PAGE) == "A title First & bolder text here. Next Second paragraph. End."
    assert html_extract.main_text(PLAIN) == ("Long text of the page. " * 8 + "Short. " + "More text follows here. " * 8).strip()


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<article><nav>never closed<p>x</article>", ""), ("<article><p>x</p></article><nav>open", "x"), ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2")])
def test_odd_pages(page, text):
    assert html_extract.main_text(page) == text


def test_articles_are_a_bonus_and_no_picker():
    body = "Long text of the page. " * 40
    assert html_extract.main_text(f"<div><p>{body}</p><p>Short.</p></div><div><hr><hr></div><article><p>Read this too.</p></article>") == body + "Short."
    links = "<ul>" + "".join(f"<li><a href={k}>Another page of this site</a></li>" for k in range(9)) + "</ul>"
    for name in ("article", "main"):
        assert html_extract.main_text(f"<p>Near it.</p><{name}><p>{body}</p><aside>a</aside><form>b</form><p>End.</p>{links}</{name}>") == body + "End."
    assert html_extract.main_text(f"<main>{links}</main>") == ""


def test_broken_markup_costs_no_more():
    import time

    began = time.perf_counter()
    for page in ("<a '" * 250_000, '<a b="' * 150_000, "<" * 1_000_000, "<!" * 500_000, "<script>" * 100_000, '<a b="<a b=" ' * 80_000 + ">"):
        assert isinstance(html_extract.main_text(page), str)
    assert time.perf_counter() - began < 10
    assert html_extract.main_text("<p title=it's>Don't stop here, whatever the quote says.</p>") == "Don't stop here, whatever the quote says."


def test_forms_that_wrap_a_page_and_words_in_class_names():
    text = "The text of the page, which a form wraps. " * 9
    assert html_extract.main_text(f"<form><div class=menu-bar>Home</div><p>{text}</p><input></form><div>x</div>") == text.strip()
    assert html_extract.main_text(f"<article><p>{text}</p><div class='related-work'>Earlier work is told here in some words.</div><div class='ad-box'>Buy it.</div></article>") == f"{text}Earlier work is told here in some words."


SMALL = re.compile("All rights reserved.", re.I)


def other_lines(page: str):
    """(text, weight, inside an article) of each line by the standard library's parser, for well-formed pages."""
    from html.parser import HTMLParser

    class Lines(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.text, self.linked, self.stack, self.raw, self.links, self.inside = [], "", 0, [], 0, 0, 0

        def end(self):
            text = " ".join(self.text.split())
            small = SMALL.match(text) and not self.inside or text.startswith("©")
            self.out.append((text, 0 if small else max(0, len(text) - 2 * self.linked), self.inside))
            self.text, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "br", "meta") and tag != "br":
                return
            if tag == "a":
                self.links += 1
                return
            self.end()
            if tag in ("nav", "head", "footer", "header", "aside", "script", "style", "form") or dict(attrs).get("class") == "ad":
                self.stack.append(tag)
            elif self.stack and tag == self.stack[-1]:
                self.stack.append(tag)
            self.inside += tag in ("article", "main")

        def handle_endtag(self, tag):
            if tag == "b":
                return
            if tag == "a":
                self.links -= 1
                return
            self.end()
            if self.stack and tag == self.stack[-1]:
                self.stack.pop()
            self.inside -= tag in ("article", "main")

        def handle_data(self, data):
            if not self.stack:
                self.text += data
                self.linked += len(data.strip()) if self.links else 0

    p = Lines()
    p.feed(page)
    p.close()
    p.end()
    return p.out


def other_text(page: str) -> str:
    lines = [(t, w + 80 if w and a else w, a) for t, w, a in other_lines(page)]
    sums = [sum(w for _, w, a in lines[i : i + 3] if a == lines[i][2]) for i in range(len(lines))]
    runs, kept = [], []
    for i, s in enumerate(sums):
        if s and i and sums[i - 1] and lines[i][2] == lines[i - 1][2]:
            runs[-1].append(i)
        elif s:
            runs.append([i])
    least = min(80, max(1, max(sums, default=0) // 3))
    runs = [r for r in runs if any(sums[i] >= least and lines[i][1] for i in r)]
    weights = [sum(lines[i][1] for i in r) for r in runs]
    for r, w in zip(runs, weights):
        kept += [lines[i][0] for i in r if lines[i][1]] if 5 * w >= max(weights) else []
    return " ".join(kept)


def test_pages_as_another_reader_sees_them(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    made = [html_extract.main_text(p) for p in pages]
    same = sum(a == other_text(p) for a, p in zip(made, pages))
    assert same == len(pages), same
    # The distribution of text tells an article without its tag; but for a line of small print in it.
    for a, p in zip(made, pages):
        b = html_extract.main_text(re.sub(r"<(/?)article", r"<\1div", p))
        assert SMALL.sub("", a).split() == SMALL.sub("", b).split()


def test_pages_as_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old", 9), (2, None, None, None, None), (3, "u", "<p>" + "word " * 50_000, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    out = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    assert out[2].text == "" and out[2].n_chars == 0 and out[3].n_chars == 5 * 50_000 - 1 and out[1].n_chars == len(out[1].text)
    assert html_extract.extract_text(pages.where("page_id < 0")).count() == 0


def measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, covered = defaultdict(list), set()
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_measures(spark):
    rows = texts() | {90: "a b c d e f " * 9, 91: "| # <x> " * 9, 92: "a b c d e a b c d e a b c d e", 93: "x\x0by z   w"}
    out = quality_rules.quality_report(frame(spark, list(rows.items()))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out} == {i: measures(t) for i, t in rows.items()}
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)


def test_cascade_keeps_the_same_in_any_order(spark):
    d = frame(spark)
    a = {(r.doc_id, r.kept) for r in quality_rules.apply_rules(d).collect()}
    b = {(r.doc_id, r.kept) for r in quality_rules.apply_rules(d, rules=quality_rules.RULES[::-1], sample_rows=1).collect()}
    assert a == b == {(r.doc_id, r.kept) for r in quality_rules.quality_report(d).collect()}
    assert quality_rules.apply_rules(frame(spark, empty=True)).count() == 0


def test_report_of_an_empty_table_and_repeated_rows(spark):
    assert quality_rules.quality_report(frame(spark, empty=True)).count() == 0
    out = quality_rules.quality_report(frame(spark, [(None, "a b c"), (None, "a b c"), (1, None)])).collect()
    assert len(out) == 3 and all(r.base_failed and not r.kept for r in out)


def test_rules_stay_native(spark):
    plan = quality_rules.quality_report(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def chat(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v) if v is not None else None) for i, v in enumerate(values)], "conv_id long, value string")


def test_layouts(spark):
    rows = chat(spark, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "x", "output": "o"}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"other": 1}, None, {"response": "r", "prompt": "p"})
    out = {r.conv_id: None if r.turns is None else [tuple(t) for t in r.turns] for r in chat_format.canonical_turns(rows, "value").collect()}
    pr = [("user", "p"), ("assistant", "r")]
    assert out == {0: [("user", "a"), ("assistant", "")], 1: pr, 2: [("user", "i"), ("assistant", "o")], 3: [("user", "i"), ("user", "x"), ("assistant", "o")], 4: [("user", "h"), ("assistant", "g")], 5: None, 6: None, 7: pr}


def test_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "|b", "<\\\\|x<||", "", "é🙂\n\n<|im_start|>", "\\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a\nb\\n\\e\x00", "assistant", "", "<|im_end|>", "assistant", "user"], nasty))] + [(2, 1, None, None), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (None, 0, "user", "null key")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_turns(chat_format.canonical_turns(chat_format.turns_from_rows(d), "value"))
    out = {r.conv_id: r for r in made.select("conv_id", "turns", "formatted", "loss_spans", chat_format.read_back(F.col("formatted")).alias("back")).collect()}
    for r in out.values():
        assert r.back == r.turns and r.formatted.count("<|im_start|>") == len(r.turns) == r.formatted.count("<|im_end|>")
        masked = [r.formatted[s.begin : s.begin + s.length] for s in r.loss_spans]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in masked] == [t.text for t in r.turns if t.role == "assistant"]
    assert [tuple(t) for t in out[2].turns] == [("", ""), ("assistant", "tie"), ("assistant", "tie")]
    assert [t.text for t in out[1].turns] == nasty
    assert chat_format.turns_from_rows(d.where("turn < 0")).count() == 0


def test_texts_of_any_length_and_many_turns(spark):
    d = spark.range(1).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("a<|b "), 4_200_000).alias("text"))
    d = d.unionByName(spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    as_json = d.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))).alias("value")).where("conv_id = 0")
    as_json = as_json.withColumn("value", F.regexp_replace("value", '"turn":0,', ""))
    for chats in (chat_format.turns_from_rows(d), as_json):
        made = chat_format.format_turns(chat_format.canonical_turns(chats, "value"))
        back = chat_format.read_back(F.col("formatted"))
        out = {r.conv_id: r for r in made.select("conv_id", (back == F.col("turns")).alias("same"), F.size("turns").alias("n"), F.length(F.col("turns")[0]["text"]).alias("long"), "loss_spans", F.when(F.col("conv_id") == 1, F.col("formatted")).alias("formatted")).collect()}
        assert out[0].same and out[0].n == 1 and out[0].long == 21_000_000 and out[0].loss_spans[0].length == 25_200_000
        if 1 in out:
            assert out[1].same and out[1].n == 1000
            assert [out[1].formatted[s.begin : s.begin + s.length] for s in out[1].loss_spans] == [f"text {i}" for i in range(1, 1000, 2)]


def test_structs_are_taken_as_they_are(spark):
    rows = spark.sql("select 1 as conv_id, named_struct('response', 'r', 'prompt', cast(null as string)) as value union all select 2, null")
    out = {r.conv_id: r.turns for r in chat_format.canonical_turns(rows, "value").collect()}
    assert [tuple(t) for t in out[1]] == [("user", ""), ("assistant", "r")] and out[2] is None
    talk = spark.sql("select array(named_struct('from', 'gpt', 'value', 'g'), named_struct('from', 'other', 'value', null)) as conversations").selectExpr("struct(conversations) as value")
    assert [tuple(t) for t in chat_format.canonical_turns(talk, "value").first().turns] == [("assistant", "g"), ("other", "")]
    assert chat_format.canonical_turns(spark.sql("select named_struct('x', 1) as value"), "value").first().turns is None


def check_packed(rows, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.piece == 0 or r.length == 1024
        assert len(own) == -(-len(ids) // 1024)
    return len(used)


def test_packing(spark):
    docs = list((texts() | {60: "a <|endoftext|> b", 61: LONG[:3000], 62: LONG[:1500]}).items())
    n = check_packed(packing.pack_documents(frame(spark, docs).repartition(5)).collect(), docs)
    lengths = [r.length for r in packing.pack_documents(frame(spark, docs)).collect()]
    assert -(-sum(lengths) // 1024) <= n <= packing.bins(packing.best_fit(np.bincount(lengths, minlength=1025), 1024))
    assert packing.pack_documents(frame(spark, empty=True)).count() == 0
    odd = packing.pack_documents(frame(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted(r.length for r in odd) == [1, 3, 3, 3] and [r.doc_id for r in odd].count(1) == 2 and len({(r.sequence_id, r.offset) for r in odd}) == 4
    with_ids = packing.pack_documents(frame(spark, [(1, "two words")]), with_ids=True).first()
    assert len(with_ids.ids) == with_ids.length and with_ids.ids[-1] == 2


@pytest.mark.parametrize("sizes, best", [([6, 6, 4, 4], 2), ([5, 5, 5, 5, 3, 3, 4], 3), ([10] * 3, 3), ([7, 6, 5, 4, 3, 3, 2], 3), ([], 0), ([1] * 25, 3)])
def test_bin_completion(sizes, best):
    plan = packing.bin_completion(np.bincount(sizes, minlength=11), 10)
    assert packing.bins(plan) == best and sorted(x for f, n in plan for x in f * n) == sorted(sizes) and all(sum(f) <= 10 for f, _ in plan)


def test_bin_completion_beats_best_fit():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(100, 600, 50), minlength=1025)
    assert packing.bins(packing.bin_completion(counts, 1024)) < packing.bins(packing.best_fit(counts, 1024))


@pytest.mark.parametrize("sizes, n", [(range(340, 345), 10_001), ([205, 260, 342, 401, 513], 5000)])
def test_few_lengths_are_packed_to_the_bound(sizes, n):
    counts = np.bincount(np.random.default_rng(0).choice(list(sizes), n), minlength=1025)
    plan, bound = packing.solved(counts, 1024)
    held = np.zeros(1025, np.int64)
    for filling, k in plan:
        assert sum(filling) <= 1024
        np.add.at(held, list(filling), k)
    assert (held == counts).all() and packing.bins(plan) == bound < packing.bins(packing.best_fit(counts, 1024))


def fewest(sizes: list[int], capacity: int) -> int:
    """By trying every bin for every piece."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


def test_bin_completion_is_as_short_as_any():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = sorted(rng.integers(8, 60, 11).tolist(), reverse=True)
        plan, bound = packing.solved(np.bincount(sizes, minlength=101), 100)
        assert packing.bins(plan) == fewest(sizes, 100) >= bound and sorted(x for f, n in plan for x in f * n) == sorted(sizes)


def test_fillings_are_all_that_nothing_dominates():
    sizes, counts, room = [50, 40, 33, 30, 20, 13, 7], [1, 2, 1, 2, 1, 2, 3], 83
    every = [()]
    for s, n in zip(sizes, counts):
        every = [f + (s,) * k for f in every for k in range(n + 1)]
    every = [f for f in every if sum(f) <= room]

    def dominated(f):
        left = {s: n - f.count(s) for s, n in zip(sizes, counts)}
        parts = {tuple(x for i, x in enumerate(f) if bits >> i & 1) for bits in range(2 ** len(f))}
        return any(n and any(sum(p) <= s <= sum(p) + room - sum(f) and (sum(p) < s or len(p) > 1) for p in parts) for s, n in left.items())

    found = list(packing.fillings(sizes, counts, room, room))
    assert sorted(found) == sorted(f for f in every if not dominated(f)) and len(set(found)) == len(found)
    assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


def targets(sizes: dict, share=1.5, most=2.0) -> dict:
    """Filling up step by step, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 23))) for i in range(400)] + [(400, None), (401, ""), (7, "repeated id")]
    d = frame(spark, rows).withColumn("source", F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 97 == 1, "small").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    out = mixing.mix_sources(d).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert len(out) == len(rows) and all(r.source_size == size[r.source] for r in out)
    for s, t in targets(size).items():
        assert target[s] == pytest.approx(t) and t - 23 <= taken[s] <= t + 1e-6
    again = mixing.mix_sources(d.repartition(7)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in again) == sorted((r.doc_id, r.size, r.taken) for r in out)
    copies = mixing.mixed_documents(d)
    assert copies.columns == d.columns and copies.count() == sum(r.copies for r in out)
    assert mixing.mix_sources(frame(spark, empty=True)).count() == 0


def test_network_learns_and_reads_whole_texts(spark):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice(["the", "court", "held", "that", "appeal"], 40)) for _ in range(150)]
    bad = [" ".join(x + "###" for x in rng.choice(["the", "court", "held", "that", "appeal"], 40)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(x for pair in zip(good, bad) for x in pair)] + [(900, None), (901, ""), (902, good[0] * 40 + bad[0] * 40)]
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(300)] + [(900, None, 0), (901, 7, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_cnn.score_quality(frame(spark, rows), labels).collect()}
    assert len(out) == len(rows)
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for i, r in out.items() if r.held_out and i < 300]
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held) >= 0.95 * len(held)
    assert out[900].score == out[901].score and out[902].score < out[0].score
    assert quality_cnn.score_quality(frame(spark, empty=True), labels).count() == 0
    assert {r.score for r in quality_cnn.score_quality(frame(spark, rows[:3]), labels.where("doc_id < 0")).collect()} == {0.5}


def test_learning_reads_whole_texts(spark):
    rng = np.random.default_rng(8)
    same = " ".join(f"word{k % 50}" for k in range(2600))
    assert len(same) > 16_384
    tails = [lambda: " ".join(rng.choice(["zx$%", "#@!q", "&&^j"], 500)), lambda: " ".join(rng.choice(["kind", "morning", "letter"], 400))]
    rows = [(i, same + " " + tails[i % 2]()) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    out = quality_cnn.score_quality(frame(spark, rows), labels).collect()
    by = [[r.score for r in out if r.held_out and r.doc_id % 2 == q] for q in (0, 1)]
    assert min(map(len, by)) > 10 and min(by[1]) > max(by[0]) + 0.5
    few = quality_cnn.training_sample(frame(spark, rows), labels, 1500, 100_000)
    assert all(text.decode() in {t for _, t in rows} for text, _ in few) and {q for _, q in few} == {0, 1} and all(sum(len(t) for t, y in few if y == q) <= 100_000 for q in (0, 1))


def plain_score(net, text: bytes) -> float:
    """The forward pass, one filter, place and chunk after another."""
    answers = []
    for begin in range(0, max(1, len(text) - quality_cnn.OVERLAP), quality_cnn.CHUNK - quality_cnn.OVERLAP):
        codes = list(text[begin : begin + quality_cnn.CHUNK])
        codes += [quality_cnn.FILL] * (quality_cnn.CHUNK - len(codes))
        best = []
        for k in range(quality_cnn.FILTERS):
            filter_ = net.filters[:, k].reshape(quality_cnn.WIDTH, quality_cnn.VECTOR).astype(float)
            places = range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STEP)
            best.append(max(0.0, float(net.shift[k]) + max(sum(float(net.vectors[codes[p + w]].astype(float) @ filter_[w]) for w in range(quality_cnn.WIDTH)) for p in places)))
        answers.append(best)
    features = np.array([sum(a[k] for a in answers) / len(answers) for k in range(quality_cnn.FILTERS)] + [max(a[k] for a in answers) for k in range(quality_cnn.FILTERS)])
    hidden = np.maximum(features @ net.dense + net.dense_shift, 0)
    return float(1 / (1 + np.exp(-(hidden @ net.out + net.out_shift[0]))))


def test_scores_equal_a_plain_forward_pass():
    net = quality_cnn.Network.new(3)
    made = [b"", "é short".encode(), b"a text that goes on " * 60, bytes(range(256)) * 3]
    parts = [quality_cnn.chunks(t) for t in made]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    found = net.scores(net.pooled(np.concatenate(parts)), starts)
    assert found == pytest.approx([plain_score(net, t) for t in made], abs=1e-5)


def test_scores_of_odd_rows(spark):
    rows = [(i, "good words here " * 9 if i % 2 else "b@d #### stuff " * 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    odd = frame(spark, [*rows, (7, "good words here " * 9), (7, "another text"), (None, "x"), (None, "x")]).withColumn("score", F.lit("text")).withColumn("predicted", F.lit(9.5)).withColumn("held_out", F.lit(None).cast("string"))
    out = quality_cnn.score_quality(odd, labels).collect()
    assert len(out) == 64 and all(isinstance(r.score, float) and r.predicted in (0, 1) and isinstance(r.held_out, bool) for r in out)
    again = quality_cnn.score_quality(odd.repartition(3), labels).collect()
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.score)
    assert [key(r)[1] for r in sorted(again, key=key)] == pytest.approx([key(r)[1] for r in sorted(out, key=key)], abs=1e-5)


def test_chunks_cover_every_byte():
    for n in (0, 1, 15, 16, 17, 511, 512, 513, 5000):
        c = quality_cnn.chunks(bytes([7]) * n)
        assert (c != quality_cnn.FILL).sum() >= n and c.shape[1] == quality_cnn.CHUNK


@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_packing_reads_very_long_white_space(blank):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = Tokenizer.from_file(paths[0])
    for n in (90_000, 100_001, 1_000_000):
        text = f"a{blank * n}b"
        assert packing.token_ids(text, *paths).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(packing.token_ids(blank * 5_000_000, *paths)) > 1000


def test_packing_of_20_million_blanks_runs_in_tasks(spark):
    docs = spark.sql("select cast(id as long) as doc_id, concat('a', repeat(element_at(array(' ', '\n', '\t'), cast(id + 1 as int)), 20000000), 'b') as text from range(3)")
    made = packing.pack_documents(docs).groupBy("doc_id").sum("length").collect()
    assert len(made) == 3 and all(r[1] > 5_000_000 for r in made)


def test_chat_of_many_turns_takes_linear_time(spark, monkeypatch):
    import time

    from tessella.llm import queries

    rows = spark.range(40_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text <| of turn ', id) as text")
    monkeypatch.setattr(queries, "table", lambda s, d, t: rows)
    began = time.perf_counter()
    made = {r.conv_id: r for r in queries.op6_chat_format(spark, "").collect()}
    assert time.perf_counter() - began < 60
    texts = "".join(f"text <| of turn {i}" for i in range(1, 40_000, 2))
    assert made[1].n_turns == 40_000 and made[1].loss_sha256 == hashlib.sha256(texts.encode()).hexdigest()


LONG_LINE = "This paragraph of the article is long enough to be text by any measure, and says something too. "


@pytest.mark.parametrize("snippet, kept", [
    ("<p title='the hidden truth'>Here it stands.</p>", "Here it stands."),
    ("<section id='search-algorithms'><p>Binary search is quick.</p></section>", "Binary search is quick."),
    ("<h2 id='social-contract'>The contract</h2>", "The contract"),
    ("<p>The <a class='share-price' href='x'>price</a> of it fell.</p>", "The price of it fell."),
    ("<p>A <span class='notice'>word</span> inside.</p>", "A word inside."),
    ("<h2 id='comments'>Comments on the draft</h2>", "Comments on the draft"),
    ("<p data-hidden='1' class='unhidden'>Seen.</p>", "Seen."),
    ("<p hidden>Not seen.</p>", ""),
    ("<p aria-hidden='TRUE'>Not seen.</p><p style='color:red; display : none'>Nor this.</p>", ""),
    ("<div class='ad-box'>Buy it now.</div><div id='comments'><p>Nice one.</p></div><div class='cookieBanner'>We use them.</div><div aria-label='Search'>Go</div>", ""),
])
def test_attribute_words_inside_an_article(snippet, kept):
    page = f"<body><article><p>{LONG_LINE}</p>{snippet}<p>{LONG_LINE}</p></article></body>"
    assert html_extract.main_text(page) == " ".join(x for x in (LONG_LINE.strip(), kept, LONG_LINE.strip()) if x)


def test_attribute_words_outside_an_article():
    law = "Copyright law in the nineteenth century was a matter of some dispute among printers and their authors in many towns."
    links = "<li><a href=x>One</a> or two</li>" * 5
    page = f"<div><p>{LONG_LINE}</p><p>{law}</p><p>{LONG_LINE}</p></div><div class='search-of-our-shop'><ul>{links}</ul><div>Short words.</div></div><div>Copyright 2024 Site</div>"
    assert html_extract.main_text(page) == f"{LONG_LINE.strip()} {law} {LONG_LINE.strip()}"
    assert html_extract.main_text(f"<div class='search-theory'><p>{LONG_LINE * 2}</p><div>x</div><p>{LONG_LINE * 2}</p></div>").count("This paragraph") == 4
