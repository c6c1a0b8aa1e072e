"""Hashes of words and word n-grams for many texts at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

U = np.uint64
#: Texts are hashed in groups of about so many bytes, at most twice as many but for a longer text, which is cut.
GROUP = 1 << 19
BASE = U(0x9E3779B97F4A7C15)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    inverse = U(pow(int(BASE), -1, 2**64))
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts of at most GROUP bytes that end at blanks; a longer word is a part of its own."""
    blank = re.compile(rb"[\x20\x09-\x0D]")
    at = 0
    while at < len(text):
        end = min(at + GROUP, len(text))
        if end < len(text):
            cut = max(text.rfind(bytes([b]), at, end) for b in np.flatnonzero(IS_BLANK).tolist())
            if cut < 0:
                found = blank.search(text, end)
                end = found.start() if found else len(text)
            else:
                end = cut + 1
        yield text[at:end]
        at = end


def long_word(word: bytes) -> np.ndarray:
    """The hash of one word of any length, as word_hashes has it."""
    up, _ = powers(2 * GROUP + 1)
    total, factor = U(0), U(1)
    with np.errstate(over="ignore"):
        for part in (np.frombuffer(word[i : i + GROUP], np.uint8) for i in range(0, len(word), GROUP)):
            total += factor * (BYTE[part] * up[: len(part)]).sum()
            factor *= up[len(part)]
    return mix(np.array([total], np.uint64))


def groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in texts:
        if len(text) > GROUP and group:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a group of texts, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    if len(data) > 2 * GROUP + 1:
        # Only a long text of its own: it is cut at blanks.
        parts = [long_word(part) if len(part) > GROUP else word_hashes([part])[0] for part in slices(texts[0])]
        hashes = np.concatenate(parts)
        return hashes, np.array([len(hashes)])
    blank = IS_BLANK[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(2 * GROUP + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.searchsorted(starts, np.cumsum(sizes))
    return hashes, np.diff(bounds, prepend=0)


def shingle_sets(texts: Iterable[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a text of fewer words has one, of all its words."""
    factors = mix(np.arange(1, n + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
    for group in groups(texts):
        words, counts = word_hashes(group)
        if len(words) >= n:
            grams = np.zeros(len(words) - n + 1, np.uint64)
            for k in range(n):
                grams += words[k : len(words) - n + 1 + k] * factors[k]
            grams = mix(grams)
        at = 0
        for count in counts.tolist():
            if count >= n:
                yield np.unique(grams[at : at + count - n + 1])
            elif count:
                yield mix((words[at : at + count] * factors[:count]).sum(keepdims=True) + U(count))
            else:
                yield np.zeros(0, np.uint64)
            at += count
