"""English word stems after Porter (1980) and a cover-density score after Clarke, Cormack and Tudhope (2000).

Scores order passages as the published methods do; they aren't numerically those of any database.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import cut, holding_all, single_and_repeated, slices

STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
# The suffixes of steps 2, 3 and 4 of the published algorithm.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c and v for each letter; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def ends_short(stem: str) -> bool:
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def swapped(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table that the word has, exchanged if what stays has a vowel and a consonant behind it."""
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")) or (measure(word) == 1 and ends_short(word)):
                    word += "e"
                elif double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = swapped(swapped(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if measure(rest) > 1 or (measure(rest) == 1 and not ends_short(rest)):
            word = rest
    return word[:-1] if measure(word) > 1 and double(word) and word.endswith("l") else word


def stems(words: list[str]) -> list[str | None]:
    """None for stop words."""
    return [None if w in STOP_WORDS else stem(w) for w in words]


def lexemes(text: str | None) -> list[tuple[int, str]]:
    """(place, stem) of the words that aren't stop words; places count all words from 1."""
    return [(i, stem(w)) for i, w in enumerate(re.findall("[a-z0-9]+", (text or "").lower()), 1) if w not in STOP_WORDS]


def stemmed(column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("stem", pa.string())]))
        for batch in batches:
            made = [[{"place": i, "stem": s} for i, s in lexemes(x)] for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], [*batch.schema.names, "lexemes"])

    return run


def with_lexemes(rows: DataFrame, column: str) -> DataFrame:
    """Adds lexemes; the index of a text is made once, where the text is."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(stemmed(column), f"{fields}, lexemes array<struct<place:int,stem:string>>")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, text): id, stem, n and first for each stem of a row; each different word is stemmed once for some MB of text."""
    for batch in slices(batches, "text"):
        rows, places, words = cut(batch.column("text"))
        kinds = pa.array(stems(words.dictionary.to_pylist()), pa.string()).dictionary_encode()
        kind = pc.fill_null(kinds.indices, -1).to_numpy()[words.indices.to_numpy()]
        there = kind >= 0
        width = max(len(kinds.dictionary), 1)
        pairs, at, n = np.unique(rows[there] * width + kind[there], return_index=True, return_counts=True)
        held = [batch.column("id").take(pa.array(pairs // width)), kinds.dictionary.take(pa.array(pairs % width)), pa.array(n, pa.int64()), pa.array(places[there][at], pa.int32())]
        yield pa.RecordBatch.from_arrays(held, ["id", "stem", "n", "first"])


def counted_lexemes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, stem, n, first): how often a key's texts have a stem, and its first place; only texts of repeated keys shuffle, as their counts."""

    def made(part: DataFrame) -> DataFrame:
        held = part.select(F.col(key).alias("id"), F.lower(column).alias("text"))
        return held.mapInArrow(counted, f"id {rows.schema[key].dataType.simpleString()}, stem string, n long, first int").withColumnRenamed("id", key)

    once, repeated = single_and_repeated(rows, rows.select(key))
    found = made(once)
    return found if repeated is None else found.unionByName(made(repeated).groupBy(key, "stem").agg(F.sum("n").alias("n"), F.min("first").alias("first")))


def cover_density(hits: Column, n_terms: Column) -> Column:
    """From struct(place, term) in order of place: the sum over shortest covers of all terms, each one over its excess length.

    A cover is a stretch that holds every term and no shorter stretch with that property. Terms that share places may have
    a cover shorter than their number; its excess is 0.
    """
    # All hits of one place are taken in before a cover may end there.
    told = F.transform(hits, lambda h, i: F.struct(h["place"].alias("place"), h["term"].alias("term"), F.coalesce(F.get(hits, i + 1)["place"] == h["place"], F.lit(False)).alias("more")))
    start = F.struct(F.array_repeat(F.lit(0), n_terms).alias("last"), F.lit(0).alias("from"), F.lit(0.0).alias("score"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i == hit["term"], hit["place"]).otherwise(x))
        begin = F.array_min(last)
        new = ~hit["more"] & (begin > state["from"])
        gain = F.when(new, 1.0 / (1 + F.greatest(hit["place"] - begin + 1 - n_terms, F.lit(0)))).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(new, begin).otherwise(state["from"]).alias("from"), (state["score"] + gain).alias("score"))

    return F.aggregate(told, start, step)["score"]


def ranked_by_join(asked: DataFrame, passages: DataFrame) -> DataFrame:
    terms = asked.select("qid", F.size("terms").alias("n"), F.posexplode("terms").alias("term", "stem"))
    held = with_lexemes(passages.select("chunk_id", "content"), "content").select("chunk_id", F.explode("lexemes").alias("x")).select("chunk_id", "x.place", "x.stem")
    hits = held.join(terms, "stem").groupBy("qid", "chunk_id", "n").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("hits"), F.countDistinct("term").alias("found"))
    return hits.where("found = n").select("qid", "chunk_id", cover_density(F.col("hits"), F.col("n")).alias("score"))


def ranked_matches(questions: DataFrame, passages: DataFrame, keys: DataFrame | None = None, most_terms: int = 200_000) -> DataFrame:
    """(qid, chunk_id, score): passages that hold the stems of all of a question's words.

    questions(qid, text), passages(chunk_id, content); keys is a frame of one column of the passages that shows which of them
    may repeat a chunk_id. Of up to most_terms stems in all, only rows of the result leave the task that reads a passage;
    beyond that, and for repeated ids, hits of asked stems shuffle.
    """
    asked = with_lexemes(questions.select("qid", "text"), "text").select("qid", F.array_sort(F.array_distinct(F.col("lexemes.stem"))).alias("terms")).where(F.size("terms") > 0)
    return holding_all(asked, "english", passages, stems, ranked_by_join, True, keys, most_terms)
