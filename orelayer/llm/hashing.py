"""64-bit hashes of words and word shingles, for many texts at once, as numpy arrays inside a task."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
ODD = 0x9E3779B97F4A7C15
_SPACE = re.compile(r"[\x20\x09-\x0D]")
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches of few rows: what a task holds of texts at a time follows these, not the size of Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _characters() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(ODD))


@lru_cache(maxsize=1)
def blanks() -> np.ndarray:
    """By code point: the white space of the text operators."""
    found = np.zeros(0x110000, bool)
    found[[32, *range(9, 14)]] = True
    return found


@lru_cache(maxsize=1)
def not_letters_or_digits() -> np.ndarray:
    """By code point: everything but letters and digits."""
    return ~np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """By code point: A-Z lower-cased."""
    found = np.arange(0x110000, dtype=np.uint32)
    found[65:91] += 32
    return found


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up, down = np.full(size, ODD, np.uint64), np.full(size, ODD_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: str, separators: np.ndarray) -> np.ndarray:
    """A hash per word of a text: a sum of hashed characters times powers, read from prefix sums, then mixed."""
    codes = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~separators[codes]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = max(BLOCK * 2, 1 << (len(codes) + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_characters()[codes] * up[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def segments(text: str) -> Iterator[str]:
    """A long text in parts that end at white space, so that no word is cut."""
    start = 0
    while len(text) - start > BLOCK and (found := _SPACE.search(text, start + BLOCK)):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def hashed_words(texts: Iterable[str | None], separators: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn. Short texts are hashed together, long ones part by part."""
    held: list[str] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        joined = " ".join(held)
        starts = np.cumsum([0, *(len(t) + 1 for t in held)])
        codes_at = _word_starts(joined, separators)
        hashes = word_hashes(joined, separators)
        cuts = np.searchsorted(codes_at, starts)
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield hashes[low:high]

    for text in texts:
        if text and len(text) > BLOCK:
            if held:
                yield from flush()
                held, size = [], 0
            yield np.concatenate([word_hashes(part, separators) for part in segments(text)])
            continue
        held.append(text or "")
        size += len(held[-1]) + 1
        if size >= BLOCK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _word_starts(text: str, separators: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[1:] = ~separators[codes]
    return np.flatnonzero(np.diff(inside) == 1)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` words; a shorter text gives one hash of all its words, no words give none."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(ODD) + words[i : i + count])
    return total


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of ``size`` words, sorted."""
    return np.unique(runs(words, size))
