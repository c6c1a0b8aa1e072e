"""Evaluation of retrieval and of answers: records per question, and measures over records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


BLANK = re.compile(r"\s+", re.ASCII)
#: Items of so many bytes in all, and so many of them, are sent to where the texts are.
SENT_BYTES, SENT_ITEMS = 32 << 20, 100_000


def held_items(shared, kinds: tuple[pa.DataType, pa.DataType], names: tuple[str, str]) -> Callable:
    """(text_id, item_id) of the texts of a task that hold an item: looked up by the first of five inner words, or by an inner word, and then compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fives: dict[str, dict[tuple, list]] = {}
        ones: dict[str, list] = {}
        tiny = []
        for key, item in shared.value:
            w = BLANK.split(item)
            if len(w) >= 7:
                fives.setdefault(w[1], {}).setdefault(tuple(w[1:6]), []).append((key, item))
            elif len(w) >= 3:
                ones.setdefault(max(w[1:-1], key=len), []).append((key, item))
            else:
                tiny.append((key, item))
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                found = []
                for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    w = BLANK.split(text)
                    near = {c for word in ones.keys() & set(w) for c in ones[word]}.union(tiny)
                    for i, word in enumerate(w):
                        if word in fives:
                            near.update(fives[word].get(tuple(w[i : i + 5]), ()))
                    found += ((number, key) for key, item in near if item in text)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], list(names))

    return run


def containing(texts: DataFrame, items: DataFrame, text_id: str = "doc_id", item_id: str = "item_id", sent_bytes: int = SENT_BYTES, sent_items: int = SENT_ITEMS) -> DataFrame:
    """(text_id, item_id) of the texts (text_id, text) that hold an item's text (item_id, text) as it is.

    A word within an item has white space on both sides in a text that holds the item, so it is a word of that text: an
    item of seven words or more is looked up by five of them, a shorter one by its longest inner word, and the whole
    text then decides. Items of one or two words have no inner word; only these are compared with every text.

    Items are measured first: up to sent_bytes and sent_items they go to where the texts are, and no word of a text
    leaves its task. More of them meet the texts' words in a join.
    """
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if size["n"] <= sent_items and size["b"] <= sent_bytes:
        held = [tuple(r) for r in items.where("text is not null").select(item_id, "text").collect()]
        fields = [texts.schema[text_id], items.schema[item_id]]
        kinds = tuple(to_arrow_type(f.dataType) for f in fields)
        made = held_items(texts.sparkSession.sparkContext.broadcast(held), kinds, (text_id, item_id))
        return texts.select(text_id, "text").mapInArrow(made, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    return containing_by_join(texts, items, text_id, item_id)


def containing_by_join(texts: DataFrame, items: DataFrame, text_id: str, item_id: str) -> DataFrame:
    blank = r"\s+"
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    five = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))
    items = items.select(F.col(item_id), F.col("text").alias("item"), F.split("text", blank).alias("w"))
    inner = F.array_sort(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    # Both sides carry the kind of key, so that a window never meets a word.
    key = F.when(F.size("w") >= 7, F.struct(F.lit(5).alias("n"), five(F.col("w"), F.lit(1)).alias("h"))).when(F.size("w") >= 3, F.struct(F.lit(1).alias("n"), F.xxhash64(inner[0]["x"]).alias("h")))
    keyed = items.withColumn("key", key)
    held = texts.select(F.col(text_id), F.col("text"))
    windows = lambda w: F.when(F.size(w) >= 5, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: five(w, i)))).otherwise(F.array().cast("array<long>"))
    pairs = F.explode(let(F.split("text", blank), lambda w: F.concat(F.transform(windows(w), lambda h: F.struct(F.lit(5).alias("n"), h.alias("h"))), F.transform(F.array_distinct(w), lambda x: F.struct(F.lit(1).alias("n"), F.xxhash64(x).alias("h"))))))
    near = held.select(text_id, pairs.alias("key")).join(keyed.where("key is not null").select(item_id, "key", "item"), "key").select(text_id, item_id, "item").distinct()
    hit = near.join(held, text_id).where(F.col("text").contains(F.col("item"))).select(text_id, item_id)
    tiny = held.join(items.where(F.size("w") < 3), F.col("text").contains(F.col("item"))).select(text_id, item_id)
    return hit.unionByName(tiny)


def retrieval_records(questions: DataFrame, ranked: DataFrame, gold: DataFrame, passages: DataFrame, gold_texts: DataFrame, within: int = 20) -> DataFrame:
    """One record per question and configuration: category, answerable, rank (of the first gold document), passage_rank.

    questions(qid, category), ranked(config, qid, chunk_id, doc_id, rank), gold(qid, doc_id), passages(chunk_id,
    content), gold_texts(qid, text). A passage is gold if it holds the gold text or is part of it; only the first
    `within` passages of a question are looked at for that. A question without gold documents expects no answer.
    """
    configs = ranked.select("config").distinct()
    hits = ranked.join(gold.distinct(), ["qid", "doc_id"]).groupBy("config", "qid").agg(F.min("rank").alias("rank"))
    head = ranked.where(F.col("rank") <= within).join(passages.select("chunk_id", "content"), "chunk_id").join(gold_texts, "qid")
    part = F.col("content").contains(F.col("text")) | F.col("text").contains(F.col("content"))
    shown = head.where(part).groupBy("config", "qid").agg(F.min("rank").alias("passage_rank"))
    known = gold.select("qid").distinct().withColumn("answerable", F.lit(True))
    # Configurations are a handful of names.
    asked = questions.select("qid", "category").join(known, "qid", "left").crossJoin(F.broadcast(configs))
    made = asked.join(hits, ["config", "qid"], "left").join(shown, ["config", "qid"], "left")
    return made.withColumn("answerable", F.coalesce("answerable", F.lit(False)))


def within(rank: Column, most: int) -> Column:
    return F.when(rank <= most, 1.0).otherwise(0.0)


def reciprocal(rank: Column, most: int) -> Column:
    return F.when(rank <= most, 1.0 / rank).otherwise(0.0)


def retrieval_metrics(records: DataFrame, by: list[str], recall_at: int = 20, mrr_at: int = 10) -> DataFrame:
    """questions, answerable, recall, mrr and, where records have passage_rank, passage_recall, of each group.

    The means are over answerable questions: records(answerable, rank).
    """
    asked, rank = F.col("answerable"), F.col("rank")
    more = [F.avg(F.when(asked, within(F.col("passage_rank"), recall_at))).alias("passage_recall")] if "passage_rank" in records.columns else []
    return records.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if(asked).alias("answerable"), F.avg(F.when(asked, within(rank, recall_at))).alias("recall"), F.avg(F.when(asked, reciprocal(rank, mrr_at))).alias("mrr"), *more
    )


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, half to even, of each group; nulls don't count.

    Equal values are counted first and coarse buckets of them are summed, so that what is ordered within one group is
    buckets, and then only the values of the buckets in which a rank falls.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # The bucket of a number: its leading bits, in order.
    bucket = F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.signum("v") * (F.floor(F.log2(F.abs(F.col("v").cast("double"))) * 64) + 80_000))
    counts = counts.withColumn("b", bucket)
    sums = counts.groupBy(*by, "b").agg(F.sum("n").alias("n"))
    total = sums.groupBy(*by).agg(F.sum("n").alias("total"))
    below = F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn("below", F.coalesce(below, F.lit(0)))
    at = total.select(*by, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.bround(F.lit(share) * (F.col("total") - 1)) + 1).cast("long").alias("at")) for name, share in shares.items()))).alias("x")).select(*by, "x.*")
    inside = at.join(placed, by).where((F.col("at") > F.col("below")) & (F.col("at") <= F.col("below") + F.col("n"))).select(*by, "name", "at", "b", "below")
    values = inside.join(counts.select(*by, "b", "v", F.col("n").alias("m")), [*by, "b"])
    running = F.sum("m").over(Window.partitionBy(*by, "name").orderBy("v")) + F.col("below")
    first = values.withColumn("up_to", running).where(F.col("up_to") >= F.col("at")).groupBy(*by, "name").agg(F.min("v").alias("v"))
    return first.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))


def answer_metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """What a set of answers is worth, of each group; rates are rounded to four digits and null where nothing counts.

    records(expect_no_answer, abstained, reason, gold_cited, cited, valid_ids, cited_ids, claims, removed, words).
    """
    none, away = F.col("expect_no_answer"), F.col("abstained")
    rate = lambda yes, of: F.round(F.try_divide(F.count_if(yes & of).cast("double"), F.count_if(of)), 4)
    share = lambda a, b: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b)), 4)
    answered = ~none & ~away
    return records.groupBy(*by).agg(
        F.count("*").alias("questions"),
        rate(~away, ~none).alias("answered_rate"),
        rate(away, none).alias("abstention_rate"),
        rate(F.col("gold_cited") > 0, answered).alias("gold_cited_rate"),
        share(F.when(answered, F.col("gold_cited")), F.when(answered, F.col("cited"))).alias("evidence_precision"),
        share("valid_ids", "cited_ids").alias("id_validity"),
        share("claims", F.col("claims") + F.col("removed")).alias("support_rate"),
        F.round(F.avg(F.when(~away, F.col("words"))), 4).alias("mean_words"),
        F.round(F.avg(F.when(~away, F.col("claims"))), 4).alias("mean_claims"),
    )


def removal_reasons(records: DataFrame, by: list[str]) -> DataFrame:
    """How often each reason stands in the records of each group."""
    return records.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def paired_sides(questions: DataFrame, by: str, ours: DataFrame, theirs: DataFrame, gold: DataFrame, most: int = 20) -> DataFrame:
    """Two systems on the same questions(qid, by): how many each one answers within the first `most`, and how many it alone.

    ours and theirs are (qid, doc_id, rank).
    """
    hit = lambda ranked, name: ranked.join(gold, ["qid", "doc_id"]).groupBy("qid").agg((F.min("rank") <= most).alias(name))
    j = questions.join(hit(ours, "a"), "qid", "left").join(hit(theirs, "b"), "qid", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return j.groupBy(by).agg(F.count("*").alias("questions"), F.count_if(a).alias("ours"), F.count_if(b).alias("theirs"), F.count_if(a & ~b).alias("only_ours"), F.count_if(b & ~a).alias("only_theirs"))


def run_config(passages: DataFrame, settings: dict) -> DataFrame:
    """One row, config and config_hash: a run's settings and a fingerprint of what it searched, as JSON with its keys in order.

    The fingerprint is the number of passages(doc_id, content_hash) and the sum of their digests, which needs no order:
    tasks add up what they read, and one row for each shuffles.
    """
    line = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), "content_hash"))
    held = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
    told = json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    config = F.concat(F.lit('{"corpus":{"digest":"'), "digest", F.lit('","passages":'), F.col("n").cast("string"), F.lit('},"settings":'), F.lit(told), F.lit("}"))
    return held.select(config.alias("config")).withColumn("config_hash", F.sha2("config", 256))


def run_record(run_id: str, settings: dict, metrics: DataFrame, by: str, questions: DataFrame, key: str) -> DataFrame:
    """A run as rows (run_id, part, key, value), value in JSON: its settings, the metrics of each group, and each question's result.

    Questions are rows of their own, so a run may have any number of them; nulls are left out.
    """
    packed = lambda rows, part, name: rows.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("key"), F.to_json(F.struct(*sorted(c for c in rows.columns if c != name))).alias("value"))
    told = metrics.sparkSession.createDataFrame([("config", "settings", json.dumps(settings, sort_keys=True, separators=(",", ":")))], "part string, key string, value string")
    rows = told.unionByName(packed(metrics, "metrics", by)).unionByName(packed(questions, "question", key))
    return rows.select(F.lit(run_id).alias("run_id"), "part", "key", "value")
