"""Token counts by byte-pair merging over a heap and a linked list: no token ids are made.

A piece starts as its bytes. The adjacent pair of lowest rank is popped and merged again and again; the count is the
bytes less the merges. Short pieces repeat, so each worker remembers the counts of those it met, up to a fixed number of bytes, and
forgets them all when that is reached; long pieces are not remembered. So memory is bounded, but for the longest piece itself, and the counts are the same.

Defined results: null counts as empty text, empty text has 0 tokens; rows keep their id, null or repeated; the text of
an added token is one token wherever it stands, as the library has it by default; the time for a piece of n bytes is
n log n, so a text without a blank is no special case. Only the id and the text are read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How the library splits text before merging. \s is Unicode's White_Space; the second form is the same for ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
# Bytes of memory for remembered pieces, about what one takes besides its characters, and characters of the longest one remembered.
REMEMBERED, OVERHEAD, SHORT = 64_000_000, 150, 100
# Longer texts are split piece by piece, so that their pieces are never all in memory.
LONG = 1_000_000


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable bytes as they are, the rest from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + n): b for n, b in enumerate(others)}}


class Merges(dict):
    """Token count by piece of text; counts that are missing are worked out and remembered."""

    def __init__(self, specification: str):
        super().__init__()
        self.held = 0
        spec = json.loads(specification)
        ids = {**byte_characters()}
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            merged = ids.setdefault(left + right, 256 + rank)
            self.ranks.setdefault(ids[left] << 20 | ids[right], (rank, merged))
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        self.split, self.ascii_split = regex.compile(PATTERN), re.compile(ASCII_PATTERN)

    def __missing__(self, piece: str) -> int:
        count = self.merged(piece.encode("utf-8"))
        if len(piece) <= SHORT:
            self.held += OVERHEAD + len(piece)
            if self.held > REMEMBERED:
                self.clear()
                self.held = OVERHEAD + len(piece)
            self[piece] = count
        return count

    def merged(self, piece: bytes) -> int:
        symbols, size, ranks = list(piece), len(piece), self.ranks
        if size < 2:
            return size
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        waiting, heap = [-1] * size, []
        for i in range(size - 1):
            found = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                waiting[i] = found[0]
                heap.append(found[0] << 32 | i)
        heapq.heapify(heap)
        count = size
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if waiting[i] != top >> 32:
                continue
            j = after[i]
            symbols[i] = ranks[symbols[i] << 20 | symbols[j]][1]
            waiting[i] = waiting[j] = -1
            after[i] = k = after[j]
            count -= 1
            if k < size:
                before[k] = i
                if found := ranks.get(symbols[i] << 20 | symbols[k]):
                    waiting[i] = found[0]
                    heapq.heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0:
                found = ranks.get(symbols[h] << 20 | symbols[i])
                waiting[h] = found[0] if found else -1
                if found:
                    heapq.heappush(heap, found[0] << 32 | h)
        return count

    def tokens(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        count = len(parts) - 1
        for part in parts:
            split = self.ascii_split if part.isascii() else self.split
            if len(part) > LONG:
                count += sum(self[m.group()] for m in split.finditer(part))
            else:
                count += sum(map(self.__getitem__, split.findall(part)))
        return count


@lru_cache(maxsize=2)
def merges_of(specification: str) -> Merges:
    """One per worker process, kept from task to task."""
    return Merges(specification)


def count_tokens(docs: DataFrame, vocabulary: str, ident: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``ident``, bytes, tokens, and whether there are more than ``limit`` tokens, by the vocabulary file at a path.

    The driver reads the file (a few MB, whatever the corpus) and broadcasts it; workers need no file of their own.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(shipped.value)
        for batch in batches:
            texts = batch.column(1)
            counts = [merges.tokens(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.select(docs[ident]).schema[0].dataType.simpleString()
    body = docs.select(
        docs[ident].alias("id"),
        docs[text].alias("text"),
        F.octet_length(F.coalesce(docs[text], F.lit(""))).cast("bigint").alias("n_bytes"),
    )
    found = body.mapInArrow(counted, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return found.select(F.col("id").alias(ident), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
