"""Character n-grams of many texts at once, as numpy arrays inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

BLANK = 32
# Texts are worked on in blocks of about so many characters; a longer text is cut at a blank and put together again.
BLOCK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """By code point: whether it may stand inside a word: no blank and no mark that ends a phrase."""
    kept = np.fromiter((not chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
    kept[[ord(c) for c in '.,;:!?"()[]|']] = False
    return kept


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def cut(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in parts of at most ``size`` characters, cut at a blank where the part has one."""
    start = 0
    while len(text) - start > size:
        end = text.rfind(" ", start + size // 2, start + size)
        end = end if end > 0 else start + size
        yield text[start:end]
        start = end
    yield text[start:]


def blocks(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of texts, with the number of the text each comes from, in blocks of bounded size."""
    owners, parts, size = [], [], 0
    for number, text in enumerate(texts):
        for part in cut(text):
            owners.append(number)
            parts.append(part.lower())
            size += len(part)
            if size >= BLOCK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def code_points(parts: list[str], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one array of code points with a blank around each, and the part of each position."""
    codes = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(kept[codes], codes, np.uint32(BLANK))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    sizes[0] += 1
    return codes, np.repeat(np.arange(len(parts)), sizes)


def hashed(codes: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and buckets of the grams of ``size`` characters that have a blank at their ends only."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = codes == BLANK
    whole = np.ones(count, bool)
    for i in range(1, size - 1):
        whole &= ~blank[i : i + count]
    at = np.flatnonzero(whole)
    key = np.full(len(at), size, np.uint64)
    for i in range(size):
        key = (key * np.uint64(1_000_003)) ^ codes[at + i]
    return at, ((key * MIX) >> np.uint64(64 - bits)).astype(np.int64)
