"""The search plan, for many questions at once: two channels, fusion, reranking, grouping into cases.

A question is a row, never a loop on the driver. The dense channel keeps a running top of each question in a task, so
what shuffles is bounded by tasks times questions times the pool; the lexical one shuffles matching passages only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_citation, looks_like_case_name, names_every_party, neutral_citation, normal_citation, party_words
from ..operators.ranking import cap_per_group, first_of_each, fuse, ranked, rerank_head
from ..session import shared_path
from .lexical import ENGLISH, SIMPLE, matching, words

DIMENSION = 256
POOL, PER_CASE, RAW, RERANK = 450, 3, 600, 30


@cache
def bucket_of(word: str) -> int:
    return hashlib.sha256(word.encode()).digest()[-1]


def bag_matrix(texts: list[str | None]) -> np.ndarray:
    """One row of length one for each text: hashed word counts of DIMENSION buckets; zeros for a text without words."""
    held = [[bucket_of(w) for w in re.findall("[a-z0-9]+", (text or "").lower())] for text in texts]
    rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
    flat = np.fromiter((b for x in held for b in x), np.int64, len(rows))
    v = np.bincount(rows * DIMENSION + flat, minlength=len(held) * DIMENSION).reshape(-1, DIMENSION).astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def bag_batches(column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = bag_matrix(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    return run


def bag_vectors(rows: DataFrame, column: str) -> DataFrame:
    """Adds vector, the offline stand-in for an embedding model: hashed word counts of DIMENSION buckets, of length one.

    A word's bucket is its SHA-256 modulo DIMENSION, which is its last byte; a text without words has a zero vector.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(bag_batches(column), f"{fields}, vector array<double>")


#: What a question may ask of a passage's judgment; a null or an absent column asks nothing.
FILTERS = ("court_code", "year_from", "year_to")


def owned(rows: DataFrame) -> DataFrame:
    """court_code and year of passages or judgments under names of their own, as questions have the first one too."""
    return rows.withColumnsRenamed({"court_code": "own_court", "year": "own_year"})


def allowed(questions: DataFrame) -> Column:
    """Whether a row that questions were joined with passes their filters."""
    tests = {"court_code": F.col("own_court") == F.col("court_code"), "year_from": F.col("own_year") >= F.col("year_from"), "year_to": F.col("own_year") <= F.col("year_to")}
    passes = F.lit(True)
    for name in (n for n in FILTERS if n in questions.columns):
        passes = passes & (F.col(name).isNull() | F.coalesce(tests[name], F.lit(False)))
    return passes


IDS = ("chunk_id", "doc_id", "source_text_hash", "content_hash")


def index_passages(passages: DataFrame) -> DataFrame:
    """The passages written once for a run: both channels, fusion and reranking read the columns they need."""
    path = shared_path(passages.sparkSession, "passages")
    passages.write.parquet(path)
    return passages.sparkSession.read.schema(passages.schema).parquet(path)


def top_passages(scored: DataFrame, limit: int, per_case: int) -> DataFrame:
    """Equal passages of one source text once, at most per_case of each, the best limit of a question with their rank."""
    best = [F.desc("score"), F.col("doc_id"), F.col("chunk_id")]
    once = first_of_each(scored, ["qid", "source_text_hash", "content_hash"], best)
    return ranked(cap_per_group(once, ["qid", "source_text_hash"], best, per_case), best, limit, by=["qid"])


def lexical_channel(questions: DataFrame, passages: DataFrame, limit: int = POOL, per_case: int = PER_CASE, forms: tuple[str, ...] = (SIMPLE, ENGLISH), index: DataFrame | None = None) -> DataFrame:
    """questions(qid, text, filters); passages(chunk_id, doc_id, hashes, content, court_code, year).

    Words, phrases, alternatives and exclusions as plans.lexical has them; index may be a positional index of the
    passages. Gives qid, chunk_id, the hashes, doc_id, score and rank. What a passage is filtered by meets the passages
    of each question's rarest word; everything else about it only the scored rows.
    """
    filters = [c for c in FILTERS if c in questions.columns]
    about = owned(passages.select("chunk_id", *(c for c in ("court_code", "year") if c in passages.columns)))

    def passing(near: DataFrame) -> DataFrame:
        if not filters:
            return near
        told = near.join(questions.select("qid", *filters), "qid").join(about, "chunk_id")
        return told.where(allowed(questions)).select(*near.columns)

    return top_passages(matching(questions, passages, passing, forms, index=index).join(passages.select(*IDS), "chunk_id"), limit, per_case)


#: Passages and questions of one matrix product.
ROWS, ASKED = 2048, 512


def block_top(held, raw: int, embed: Callable[[list], np.ndarray] | None) -> Callable:
    """The raw nearest of each question in this task: matrix products of bounded size, and a running top of each question.

    The second column holds vectors, or what embed makes them of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vectors, asked = held.value
        tops: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qids]
        waiting, floor = np.zeros(len(qids), np.int64), np.full(len(qids), -np.inf)

        def cut(j: int) -> None:
            sims, ids = (np.concatenate(x) for x in zip(*tops[j]))
            at = np.lexsort((ids, -sims))[:raw]
            tops[j], waiting[j] = [(sims[at], ids[at])], len(at)
            if len(at) == raw:
                floor[j] = sims[at[-1]]

        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                given = batch.column(1)
                v = embed(given.to_pylist()) if embed else np.array(given.flatten(), np.float64).reshape(batch.num_rows, -1)
                ids = batch.column("chunk_id").to_numpy()
                if asked:
                    court, year = np.array(batch.column("court_code").to_pylist(), object), np.array(batch.column("year").to_numpy(zero_copy_only=False), np.float64)
                    tests = {"court_code": lambda x: court == x, "year_from": lambda x: year >= x, "year_to": lambda x: year <= x}
                for low in range(0, len(qids), ASKED):
                    sims = np.round(v @ vectors[low : low + ASKED].T, 9).T
                    for name, wanted in asked.items():
                        for j, x in enumerate(wanted[low : low + ASKED]):
                            if x is not None:
                                sims[j, ~tests[name](x)] = -np.inf
                    for j in range(len(sims)):
                        at = np.flatnonzero((sims[j] >= floor[low + j]) & (sims[j] > -np.inf))
                        if len(at):
                            tops[low + j].append((sims[j][at], ids[at]))
                            waiting[low + j] += len(at)
                            if waiting[low + j] > 4 * raw:
                                cut(low + j)
        for j, qid in enumerate(qids):
            if tops[j]:
                cut(j)
                sims, ids = tops[j][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qid)), pa.array(ids), pa.array(sims)], ["qid", "chunk_id", "score"])

    return run


def dense_channel(questions: DataFrame, passages: DataFrame, raw: int = RAW, limit: int = POOL, per_case: int = PER_CASE, most_questions: int = 2_000, embed: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """questions(qid, vector, filters) and passages(chunk_id, doc_id, hashes, vector, court_code, year).

    With embed, a function from a list of texts to a matrix, passages have content instead of vector: vectors are then
    made where they are compared and never leave the task.

    Vectors that don't belong to a passage's present context don't count: passages may have current, a boolean. The raw
    cut comes behind the filters and before equal passages and caps. Any number of questions is asked, most_questions in
    each pass over the passages: so many are on the driver and have a running top in a task at once, and each pass
    leaves its tops in the shared folder.
    """
    spark = passages.sparkSession
    if "current" in passages.columns:
        passages = passages.where("current")
    kinds, order = dict(passages.dtypes), [F.desc("score"), F.col("chunk_id")]
    filters = [c for c in FILTERS if c in questions.columns]
    columns = ["chunk_id", "content" if embed else "vector", *(c for c in ("court_code", "year") if filters)]

    def nearest(asked: list) -> DataFrame:
        held = spark.sparkContext.broadcast(([r["qid"] for r in asked], np.array([r["vector"] for r in asked], np.float64), {c: [r[c] for r in asked] for c in filters}))
        near = passages.select(columns).mapInArrow(block_top(held, raw, embed), f"qid long, chunk_id {kinds['chunk_id']}, score double")
        return ranked(near, order, raw, by=["qid"]).drop("rank")

    asked = questions.select("qid", "vector", *filters).limit(most_questions + 1).collect()
    if len(asked) <= most_questions:
        near = nearest(asked)
    else:
        # Written once, so that all passes see the same questions, and read back a block at a time.
        path, tops = shared_path(spark, "questions"), shared_path(spark, "nearest")
        questions.select("qid", "vector", *filters).write.parquet(path)
        waiting = spark.read.parquet(path).toLocalIterator()
        while part := list(islice(waiting, most_questions)):
            made = nearest(part)
            made.write.mode("append").parquet(tops)
        near = ranked(spark.read.schema(made.schema).parquet(tops), order, raw, by=["qid"]).drop("rank")
    return top_passages(near.join(passages.select(*IDS), "chunk_id"), limit, per_case)


def citation_block(questions: DataFrame, judgments: DataFrame) -> DataFrame:
    """(qid, doc_id, source_text_hash) of eligible judgments whose neutral citation a question names."""
    asked = questions.withColumn("cited", detect_citation(F.col("text"))).where("cited is not null")
    asked = asked.select("*", F.col("cited.year").alias("of_year"), F.upper("cited.court").alias("of_court"), F.col("cited.number").alias("of_number"))
    own = judgments.where("eligibility = 'eligible'").withColumn("own", neutral_citation(F.col("citation")))
    own = owned(own).select("doc_id", "source_text_hash", "own_court", "own_year", F.col("own.year").alias("of_year"), F.upper("own.court").alias("of_court"), F.col("own.number").alias("of_number"))
    held = asked.join(own, ["of_year", "of_court", "of_number"])
    return held.where(allowed(questions)).select("qid", "doc_id", "source_text_hash")


def case_name_block(questions: DataFrame, judgments: DataFrame) -> DataFrame:
    """(qid, doc_id, source_text_hash) of eligible judgments whose citation names every party of a question.

    A question meets only judgments that have the longest word of its first party; then every side is checked.
    """
    asked = questions.where(looks_like_case_name(F.col("text"))).withColumn("sides", party_words(F.col("text"))).where(F.size("sides") > 1)
    asked = asked.withColumn("word", F.array_sort(F.transform(F.col("sides")[0], lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"])
    own = judgments.where("eligibility = 'eligible'").transform(owned).select("doc_id", "source_text_hash", "own_court", "own_year", "citation")
    held = own.withColumn("word", F.explode(F.array_distinct(F.split(normal_citation(F.col("citation")), " ")))).join(asked, "word")
    return held.where(names_every_party(F.col("sides"), F.col("citation")) & allowed(questions)).select("qid", "doc_id", "source_text_hash").distinct()


def exact_blocks(questions: DataFrame, judgments: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, class, chunk_id, doc_id, hashes): the leading passage of each judgment that a question names, one per source text.

    Class 0 is a citation, class 1 a case name. judgments(doc_id, source_text_hash, citation, court_code, year,
    eligibility); passages need an ordinal.
    """
    named = citation_block(questions, judgments).withColumn("class", F.lit(0)).unionByName(case_name_block(questions, judgments).withColumn("class", F.lit(1)))
    one = named.groupBy("qid", "source_text_hash").agg(F.min(F.struct("class", "doc_id")).alias("x")).select("qid", "x.class", "x.doc_id")
    lead = passages.join(one.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("ordinal", "chunk_id", "source_text_hash", "content_hash")).alias("x"))
    return one.join(lead.select("doc_id", "x.chunk_id", "x.source_text_hash", "x.content_hash"), "doc_id")


def overlap_score(question: Column, passage: Column) -> Column:
    """The offline stand-in for a reranking model."""
    own = words(passage)
    return F.size(F.array_intersect(words(question), own)) / (1 + F.sqrt(F.size(own)))


def overlap_scores(top: DataFrame) -> DataFrame:
    return top.select("qid", "position", F.round(overlap_score(F.col("text"), F.col("content")), 9).alias("rerank"))


def hybrid(questions: DataFrame, lexical: DataFrame, dense: DataFrame, passages: DataFrame, head: int = RERANK, k: int = 60, scorer: Callable[[DataFrame], DataFrame] = overlap_scores) -> DataFrame:
    """Fused and reranked passages: qid, chunk_id, doc_id, hashes, both ranks, rrf, rerank, position and final.

    scorer takes (qid, position, text, content) of the heads to (qid, position, rerank).
    """
    fused = fuse(lexical, dense, ["source_text_hash", "content_hash"], ["chunk_id", "doc_id"], k, by=["qid"])
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), "seen", "chunk_id")
    placed = fused.withColumn("position", F.row_number().over(order).cast("long"))
    # The text joins only the head, which is at most head rows of a question.
    top = placed.where(F.col("position") <= head).join(passages.select("chunk_id", "content"), "chunk_id").join(questions.select("qid", "text"), "qid")
    scores = scorer(top.select("qid", "position", "text", "content"))
    return rerank_head(placed.join(scores, ["qid", "position"], "left"), "position", "rerank", head, by=["qid"])


def cases(found: DataFrame, exact: DataFrame | None = None, per_case: int = PER_CASE, top_k: int = 10, offset: int = 0) -> DataFrame:
    """Passages grouped into cases of one source text; a page of cases. exact: as exact_blocks has it.

    Cases that a citation names come first, then those that a name does, then the channels' in the order of their best
    passage. A case shows its exact leading passage first and at most per_case different passages in all.
    """
    rows = found.select("qid", *IDS, F.lit(2).alias("class"), F.col("final").alias("place"), "lexical_rank", "dense_rank", "rrf", "rerank")
    if exact is not None:
        rows = rows.unionByName(exact.select("qid", *IDS, "class", F.col("doc_id").cast("long").alias("place")), allowMissingColumns=True)
    order = [F.col("class"), F.col("place")]
    once = first_of_each(rows, ["qid", "source_text_hash", "content_hash"], order)
    case = Window.partitionBy("qid", "source_text_hash")
    at = once.withColumn("best", F.min(F.struct("class", "place")).over(case)).withColumn("in_case", F.row_number().over(case.orderBy(*order)).cast("long"))
    at = at.where(F.col("in_case") <= per_case)
    numbered = at.withColumn("case_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy("best", "source_text_hash")).cast("long"))
    return numbered.where(F.col("case_rank").between(offset + 1, offset + top_k))


def search(questions: DataFrame, judgments: DataFrame, passages: DataFrame, lexical: DataFrame, dense: DataFrame, top_k: int = 10, offset: int = 0) -> DataFrame:
    """The whole plan: exact blocks before fused and reranked channels, grouped into cases, with each case's addresses."""
    found = hybrid(questions, lexical, dense, passages)
    made = cases(found, exact_blocks(questions, judgments, passages), top_k=top_k, offset=offset)
    both = F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull()
    channel = F.when(F.col("class") == 0, "citation").when(F.col("class") == 1, "case_name").when(both, "hybrid").when(F.col("lexical_rank").isNotNull(), "lexical").otherwise("dense")
    score = F.when(F.col("class") < 2, F.lit(1.0)).otherwise(F.coalesce("rerank", "rrf"))
    return made.withColumn("channel", channel).withColumn("score", score).join(twins(judgments), "source_text_hash", "left")


def twins(judgments: DataFrame) -> DataFrame:
    """For each source text its eligible addresses, by date and then address."""
    eligible = judgments.where("eligibility = 'eligible'")
    listed = F.array_sort(F.collect_list(F.struct(F.col("judgment_date").isNull().alias("n"), F.col("judgment_date").alias("d"), F.col("uri").alias("u"))))
    return eligible.groupBy("source_text_hash").agg(F.transform(listed, lambda x: x["u"]).alias("uris"))
