"""Word search: the grammar of a question, posting lists with word positions, phrases, and cover density.

A question is alternatives parted by the word "or"; an alternative is atoms that must all be there, or, behind a minus,
must not. An atom is a word or a phrase: words in double quotes, or what is written together (Smith-Jones). Words are
looked up as they stand and as English stems; stop words have no stem but keep their place in a phrase.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.english import STOP_WORDS, cover_density, stem, stems, with_lexemes
from ..functions.postings import answers, holding_all, single_and_repeated
from ..session import shared_path

SIMPLE, ENGLISH = "simple", "english"
ATOM = '(-?"[^"]*"|\\S+)'


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def atoms_of(questions: DataFrame, forms: tuple[str, ...] = (SIMPLE, ENGLISH)) -> DataFrame:
    """One row for each word of an atom: qid, form, alternative, negated, atom, place (in the atom), term, n (words of the atom), wanted.

    Atoms that must be there are numbered from 0 to wanted - 1 in each alternative. An alternative without one asks for
    nothing: a question of exclusions alone finds nothing. Atoms given twice count once.
    """
    tokens = F.regexp_extract_all("text", F.lit(ATOM), 1)
    ors = lambda held, i: F.size(F.filter(F.slice(held, 1, i), lambda t: F.lower(t) == "or"))
    marked = F.transform("tokens", lambda t, i: F.struct(ors(F.col("tokens"), i).alias("alternative"), t.startswith("-").alias("negated"), i.alias("atom"), F.when(F.lower(t) != "or", F.array_join(words(t), " ")).alias("text")))
    rows = questions.select("qid", tokens.alias("tokens")).select("qid", F.explode(marked).alias("x")).select("qid", "x.*").where("text <> ''")
    lists = []
    if SIMPLE in forms:
        lists.append(rows.withColumn("form", F.lit(SIMPLE)).withColumn("words", F.transform(F.split("text", " "), lambda w, i: F.struct(i.alias("place"), w.alias("term")))))
    if ENGLISH in forms:
        stems = with_lexemes(rows, "text").where(F.size("lexemes") > 0)
        first = F.col("lexemes")[0]["place"]
        lists.append(stems.withColumn("form", F.lit(ENGLISH)).withColumn("words", F.transform("lexemes", lambda x: F.struct((x["place"] - first).alias("place"), x["stem"].alias("term")))).drop("lexemes"))
    held = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    once = held.groupBy("qid", "form", "alternative", "negated", "words").agg(F.min("atom").alias("atom"))
    own = Window.partitionBy("qid", "form", "alternative")
    numbered = once.withColumn("wanted", F.count_if(~F.col("negated")).over(own)).withColumn("atom", F.row_number().over(own.orderBy("negated", "atom")) - 1)
    return numbered.where("wanted > 0").select("qid", "form", "alternative", "negated", "atom", F.size("words").alias("n"), F.col("wanted").cast("int").alias("wanted"), F.explode("words").alias("x")).select("*", "x.place", "x.term").drop("x")


def postings_of(forms: tuple[str, ...], kind: pa.DataType, shared: Broadcast | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value if shared else None
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                found: list[tuple] = []
                for chunk, text in zip(batch.column("chunk_id").to_pylist(), batch.column("content").to_pylist()):
                    own: dict[tuple[str, str], list[int]] = {}
                    for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower()), 1):
                        if SIMPLE in forms and (asked is None or (SIMPLE, w) in asked):
                            own.setdefault((SIMPLE, w), []).append(i)
                        if ENGLISH in forms and w not in STOP_WORDS and (asked is None or (ENGLISH, stem(w)) in asked):
                            own.setdefault((ENGLISH, stem(w)), []).append(i)
                    found += ((form, term, chunk, places) for (form, term), places in own.items())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.string(), kind, pa.list_(pa.int32())))], ["form", "term", "chunk_id", "places"])

    return run


def positional_index(passages: DataFrame, forms: tuple[str, ...] = (SIMPLE, ENGLISH), shared: Broadcast | None = None) -> DataFrame:
    """Posting lists: form, term, chunk_id, places (of all words, from 1). Made where a passage is, without a shuffle.

    shared holds a set of (form, term) to list only; without it the index is whole and may be written for later runs.
    """
    kind = passages.schema["chunk_id"].dataType
    arrow = pa.string() if kind.simpleString() == "string" else pa.int64()
    ids = passages.select(F.col("chunk_id").cast("string" if arrow == pa.string() else "long").alias("chunk_id"), "content")
    made = ids.mapInArrow(postings_of(forms, arrow, shared), f"form string, term string, chunk_id {ids.schema['chunk_id'].dataType.simpleString()}, places array<int>")
    return made.withColumn("chunk_id", F.col("chunk_id").cast(kind))


def written(frame: DataFrame, name: str) -> DataFrame:
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def starts(entries: Column, n: Column) -> Column:
    """Where an atom begins: places that all of its words have, each less its own place in the atom."""
    shifted = F.transform(entries, lambda e: F.transform(e["places"], lambda p: p - e["place"]))
    both = F.aggregate(F.slice(shifted, 2, F.greatest(F.size(shifted) - 1, F.lit(0))), F.get(shifted, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return F.when(F.size(entries) == n, both).otherwise(F.array().cast("array<int>"))


def matching(questions: DataFrame, passages: DataFrame, allowed: Callable[[DataFrame], DataFrame], forms: tuple[str, ...] = (SIMPLE, ENGLISH), most_terms: int = 200_000, index: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score) of the passages that match a question, for any number of questions at once.

    A passage matches by either form if it has all atoms of one alternative and none that it excludes. Its score is the
    sum over the forms of the cover density of its best alternative, an atom counting at each place where it begins.

    Up to most_terms words of atoms are sent to all tasks, which answer them where a passage is read: posting lists stay in
    a task, and only scored rows leave it. allowed takes (qid, chunk_id, ...) to those that pass the questions' filters.
    keys, a frame of one column of the passages, shows more cheaply than their chunk_id which of them may repeat one.

    Beyond that, for repeated ids, and with index, a whole index written before, joins take their place. Each alternative then meets the
    passages of its rarest word only, by the number of passages that have each asked word, and only those that are
    allowed meet the other words' lists.
    """
    spark = passages.sparkSession
    atoms = written(atoms_of(questions, forms), "atoms")
    if index is None and (rows := atoms.limit(most_terms + 1).toArrow()).num_rows <= most_terms:
        once, repeated = single_and_repeated(passages, passages.select("chunk_id") if keys is None else keys)
        found = allowed(answers(atoms, rows, once, stems)).select("qid", "chunk_id", F.round("score", 9).alias("score"))
        return found if repeated is None else found.unionByName(matching(questions, repeated, allowed, forms, -1))
    terms = atoms.select("form", "term").distinct()
    known = terms.limit(most_terms + 1).collect() if index is None else ()
    if index is None and len(known) <= most_terms:
        lists = positional_index(passages, forms, spark.sparkContext.broadcast({(r["form"], r["term"]) for r in known}))
    else:
        lists = (positional_index(passages, forms) if index is None else index).join(terms, ["form", "term"], "left_semi")
    lists = written(lists, "postings")
    counts = lists.groupBy("form", "term").agg(F.count("*").alias("held"))
    of = ["qid", "form", "alternative"]
    keys = atoms.where("not negated").join(counts, ["form", "term"], "left").groupBy(*of).agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "term")).alias("x")).select(*of, "x.term")
    near = allowed(lists.select("form", "term", "chunk_id").join(keys, ["form", "term"]).select(*of, "chunk_id"))
    hits = near.join(atoms, of).join(lists, ["form", "term", "chunk_id"])
    per = hits.groupBy(*of, "chunk_id", "wanted").agg(F.collect_list(F.struct("negated", "atom", "n", "place", "places")).alias("hits"))
    atom = lambda k: F.filter("hits", lambda h: ~h["negated"] & (h["atom"] == k))
    found = F.transform(F.sequence(F.lit(0), F.col("wanted") - 1), lambda k: starts(atom(k), F.get(atom(k), F.lit(0))["n"]))
    excluded = F.array_distinct(F.transform(F.filter("hits", lambda h: h["negated"]), lambda h: h["atom"]))
    barred = F.exists(excluded, lambda k: F.size(starts(F.filter("hits", lambda h: h["atom"] == k), F.get(F.filter("hits", lambda h: h["atom"] == k), F.lit(0))["n"])) > 0)
    kept = per.where(~barred).withColumn("found", found).where(F.forall("found", lambda s: F.size(s) > 0))
    places = F.array_sort(F.flatten(F.transform("found", lambda s, k: F.transform(s, lambda p: F.struct(p.alias("place"), k.alias("term"))))))
    scored = kept.withColumn("score", cover_density(places, F.col("wanted")))
    best = scored.groupBy("qid", "chunk_id", "form").agg(F.max("score").alias("score"))
    return best.groupBy("qid", "chunk_id").agg(F.round(F.sum("score"), 9).alias("score"))


def counted_by_join(asked: DataFrame, passages: DataFrame) -> DataFrame:
    a = asked.select("qid", F.size("terms").alias("n"), F.explode("terms").alias("word"))
    h = passages.select("chunk_id", F.explode(words(F.col("content"))).alias("word"))
    # Per word first, so that a common word is one row of a passage.
    per = h.join(a, "word").groupBy("qid", "chunk_id", "n", "word").agg(F.count("*").alias("c")).groupBy("qid", "chunk_id", "n").agg(F.sum("c").alias("score"), F.count("*").alias("found"))
    return per.where("found = n").select("qid", "chunk_id", "score")


def with_all_words(questions: DataFrame, passages: DataFrame, keys: DataFrame | None = None, most_terms: int = 200_000) -> DataFrame:
    """(qid, chunk_id, hits): passages that have all words of a question as they stand, and how often they have any of them.

    keys is as in matching. Of up to most_terms words in all, only rows of the result leave the task that reads a passage.
    """
    asked = questions.select("qid", F.array_distinct(words(F.col("text"))).alias("terms"))
    return holding_all(asked, SIMPLE, passages, stems, counted_by_join, False, keys, most_terms).withColumnRenamed("score", "hits")
