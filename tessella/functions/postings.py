"""Words of many texts at once, and all questions asked of the passages of a batch: numpy over Arrow's buffers, inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut at once, and rows that leave a task at once.
TEXT_BYTES, ROWS = 4 << 20, 500_000
LETTER = np.zeros(256, bool)
LETTER[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows with about TEXT_BYTES of text at once, one text at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TEXT_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of each [a-z0-9]+ in texts of small letters: its row, its place in the text from 1, and the word itself."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, bounds, data = texts.buffers()
    ends = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(begin, ends)
    each = np.diff(at)
    rows = np.repeat(np.arange(len(texts)), each)
    places = np.arange(1, len(begin) + 1) - np.repeat(at[:-1], each)
    offsets = np.concatenate(([0], np.cumsum(stop - begin)))
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    return rows, places, words.dictionary_encode()


def single_and_repeated(rows: DataFrame, ids: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame | None]:
    """rows parted by whether their key is once in ids, a frame of that column alone, or else more often or null; None if there are no others."""
    key = ids.columns[0]
    twice = ids.groupBy(F.col(key).alias("twice")).count().where("count > 1 or twice is null").select("twice")
    n = twice.limit(most + 1).count()
    if not n:
        return rows, None
    held = F.broadcast(twice) if n <= most else twice
    return rows.join(held, F.col(key).eqNullSafe(F.col("twice")), "left_anti"), rows.join(held, F.col(key).eqNullSafe(F.col("twice")), "left_semi")


@dataclass
class Asked:
    """Questions as arrays. Term i of all forms is in forms[k][1] at i less forms[k][2]; an atom is terms with places in it,
    the first one 0; an alternative is (question, form, wanted atoms, excluded atoms), in order of question and form."""

    qids: pa.Array
    forms: list[tuple[str, pa.Array, int]]
    n_terms: int
    atoms: list[tuple[np.ndarray, np.ndarray]]
    alternatives: list[tuple[int, int, np.ndarray, np.ndarray]]
    #: The terms that each alternative wants, one after the other, and where each one's begin.
    needs: np.ndarray
    since: np.ndarray


def asked_of(atoms: pa.Table) -> Asked:
    """From rows of plans.lexical.atoms_of: qid, form, alternative, negated, atom, place, term."""
    keys = atoms.column("qid").combine_chunks().dictionary_encode()
    q = keys.indices.to_pylist()
    form, alternative, negated, atom, place, term = (atoms.column(c).to_pylist() for c in ("form", "alternative", "negated", "atom", "place", "term"))
    ids = {x: i for i, x in enumerate(sorted(set(zip(form, term))))}
    forms, base = [], 0
    for f in sorted(set(form)):
        own = [t for g, t in ids if g == f]
        forms.append((f, pa.array(own, pa.large_string()), base))
        base += len(own)
    words: dict[tuple, list] = {}
    for x in zip(q, form, alternative, negated, atom, place, term):
        words.setdefault(x[:5], []).append((x[5], ids[x[1], x[6]]))
    known: dict[tuple, int] = {}
    sides: dict[tuple, tuple[list, list]] = {}
    for (i, f, g, barred, _), own in words.items():
        sides.setdefault((i, f, g), ([], []))[barred].append(known.setdefault(tuple(sorted(own)), len(known)))
    names = [f for f, _, _ in forms]
    made = [(i, names.index(f), np.array(a), np.array(b, np.int64)) for (i, f, _), (a, b) in sorted(sides.items()) if a]
    held = [(np.array([t for _, t in x]), np.array([p for p, _ in x])) for x in known]
    needs = [np.concatenate([held[k][0] for k in a]) for _, _, a, _ in made]
    since = np.cumsum([0, *map(len, needs)])[:-1]
    return Asked(keys.dictionary, forms, base, held, made, np.concatenate([np.zeros(0, np.int64), *needs]), since)


def within(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of values are in held; both are in order."""
    at = np.searchsorted(held, values)
    at[at == len(held)] = 0
    return held[at] == values if len(held) else np.zeros(len(values), bool)


class Posted:
    """Where the terms of a batch's passages are: row * 2**32 + place, in order; atoms' beginnings are found when asked for."""

    def __init__(self, asked: Asked, texts: pa.Array, stems: Callable[[list[str]], list[str | None]]):
        rows, places, words = cut(texts)
        spot, index = (rows << 32) + places, words.indices.to_numpy()
        terms, spots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for form, known, base in asked.forms:
            own = words.dictionary if form == "simple" else pa.array(stems(words.dictionary.to_pylist()), pa.large_string())
            found = pc.fill_null(pc.index_in(own, value_set=known), -1).to_numpy()[index] if len(own) else np.zeros(0, np.int64)
            there = found >= 0
            terms.append(found[there].astype(np.int64) + base)
            spots.append(spot[there])
        term, self.spots = np.concatenate(terms), np.concatenate(spots)
        order = np.argsort(term, kind="stable")
        self.spots = self.spots[order]
        self.bounds = np.searchsorted(term[order], np.arange(asked.n_terms + 1))
        self.held = np.diff(self.bounds)
        self.atoms, self.starts, self.rows = asked.atoms, {}, {}

    def of(self, term: int) -> np.ndarray:
        return self.spots[self.bounds[term] : self.bounds[term + 1]]

    def begins(self, atom: int) -> np.ndarray:
        if atom not in self.starts:
            terms, places = self.atoms[atom]
            order = np.argsort(self.held[terms], kind="stable")
            found = self.of(terms[order[0]]) - places[order[0]]
            for i in order[1:]:
                if not len(found):
                    break
                found = found[within(found, self.of(terms[i]) - places[i])]
            self.starts[atom] = found
        return self.starts[atom]

    def has(self, atom: int) -> np.ndarray:
        """Rows that have the atom, in order."""
        if atom not in self.rows:
            row = self.begins(atom) >> 32
            self.rows[atom] = row[np.diff(row, prepend=-1) > 0]
        return self.rows[atom]

    def matched(self, wanted: np.ndarray, excluded: np.ndarray) -> np.ndarray:
        """Rows that have all wanted atoms and none of the excluded."""
        rows = None
        for a in sorted(wanted, key=lambda a: self.held[self.atoms[a][0]].min()):
            rows = self.has(a) if rows is None else rows[within(rows, self.has(a))]
            if not len(rows):
                return rows
        for a in excluded:
            if len(self.has(a)):
                rows = rows[~within(rows, self.has(a))]
        return rows

    def hits(self, wanted: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        return [s[within(s >> 32, rows)] for s in map(self.begins, wanted)]

    def counts(self, wanted: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often any wanted atom is in each of the rows."""
        spots = np.concatenate(self.hits(wanted, rows)) >> 32
        return np.bincount(np.searchsorted(rows, spots), minlength=len(rows)).astype(np.float64)

    def densities(self, wanted: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The cover density of functions.english of each of the rows, summed in order of place."""
        if len(wanted) == 1:
            return self.counts(wanted, rows)  # each place is a cover of its own
        hits = self.hits(wanted, rows)
        spots, kinds = np.concatenate(hits), np.repeat(np.arange(len(hits)), [len(x) for x in hits])
        order = np.argsort(spots, kind="stable")
        spots, kinds = spots[order], kinds[order]
        begin = spots
        for k in range(len(hits)):
            begin = np.minimum(begin, np.maximum.accumulate(np.where(kinds == k, spots, -1)))
        # All hits of one place are taken in before a cover may end there, and no cover begins in another row.
        ends = np.append(spots[1:] != spots[:-1], True) & (begin >> 32 == spots >> 32)
        spots, begin = spots[ends], begin[ends]
        new = np.diff(begin, prepend=-1) > 0
        spots, begin = spots[new], begin[new]
        return np.bincount(np.searchsorted(rows, spots >> 32), 1.0 / (1 + np.maximum(spots - begin + 1 - len(wanted), 0)), len(rows))


def summed(found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of a question from (form, rows, scores) of its alternatives: the best of a form, summed over forms."""
    if len(found) == 1:
        return found[0][1:]
    rows = np.unique(np.concatenate([x[1] for x in found]))
    total = np.zeros(len(rows))
    for form in dict.fromkeys(x[0] for x in found):
        best = np.zeros(len(rows))
        for _, own, scores in (x for x in found if x[0] == form):
            at = np.searchsorted(rows, own)
            best[at] = np.maximum(best[at], scores)
        total += best
    return rows, total


def answered(shared: Broadcast, stems: Callable[[list[str]], list[str | None]], covers: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for batch in slices(batches, "content"):
            posted = Posted(asked, batch.column("content"), stems)
            score = posted.densities if covers else posted.counts
            ids, waiting, n, own, last = batch.column("chunk_id"), [], 0, [], -1

            def flushed() -> pa.RecordBatch:
                q = np.repeat([x[0] for x in waiting], [len(x[1]) for x in waiting])
                rows, scores = (np.concatenate([x[i] for x in waiting]) for i in (1, 2))
                return pa.RecordBatch.from_arrays([asked.qids.take(pa.array(q)), ids.take(pa.array(rows)), pa.array(scores)], ["qid", "chunk_id", "score"])

            live = np.flatnonzero(np.minimum.reduceat(posted.held[asked.needs], asked.since)) if len(asked.since) else ()
            for q, form, wanted, excluded in [*(asked.alternatives[i] for i in live), (-1, 0, [], [])]:
                if q != last and own:
                    waiting.append((last, *summed(own)))
                    n, own = n + len(waiting[-1][1]), []
                    if n >= ROWS:
                        yield flushed()
                        waiting, n = [], 0
                last = q
                if len(wanted) and len(rows := posted.matched(wanted, excluded)):
                    own.append((form, rows, score(wanted, rows)))
            if waiting:
                yield flushed()

    return run


def answers(atoms: DataFrame, rows: pa.Table, passages: DataFrame, stems: Callable[[list[str]], list[str | None]], covers: bool = True) -> DataFrame:
    """(qid, chunk_id, score) of the passages that match one of rows, the collected atoms, where the passage is read.

    Nothing shuffles: the questions go to all tasks. A score is a cover density, or else how often the wanted atoms are
    there. No two passages have the same chunk_id, and rows has all atoms.
    """
    shared = passages.sparkSession.sparkContext.broadcast(asked_of(rows))
    kinds = {"qid": atoms.schema["qid"].dataType.simpleString(), "chunk_id": passages.schema["chunk_id"].dataType.simpleString()}
    texts = passages.select("chunk_id", F.lower("content").alias("content"))
    return texts.mapInArrow(answered(shared, stems, covers), f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")


def holding_all(asked: DataFrame, form: str, passages: DataFrame, stems: Callable[[list[str]], list[str | None]], joined: Callable[[DataFrame, DataFrame], DataFrame], covers: bool, keys: DataFrame | None, most_terms: int) -> DataFrame:
    """(qid, chunk_id, score) of the passages that hold all terms of a question, from asked(qid, terms), arrays of different terms.

    Up to most_terms terms in all are answered where a passage is read; beyond that, and for repeated ids, by joined. keys is
    a frame of one column of the passages that shows which of them may repeat a chunk_id.
    """
    once, again = single_and_repeated(asked, asked.select("qid"))
    atoms = once.select("qid", F.lit(form).alias("form"), F.lit(0).alias("alternative"), F.lit(False).alias("negated"), F.posexplode("terms").alias("atom", "term"), F.lit(0).alias("place"))
    rows = atoms.limit(most_terms + 1).toArrow()
    if rows.num_rows > most_terms:
        return joined(asked, passages)
    single, repeated = single_and_repeated(passages, passages.select("chunk_id") if keys is None else keys)
    found = answers(atoms, rows, single, stems, covers)
    found = found if covers else found.withColumn("score", F.col("score").cast("long"))
    for part, held in ((again, passages), (once, repeated)):
        if part is not None and held is not None:
            found = found.unionByName(joined(part, held))
    return found
