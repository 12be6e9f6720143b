"""Benchmark decontamination: every passage of the corpus is a query against an inverted index of the test items.

Documents are read in overlapping passages, twice as long as the longest item, so every item that stands in a document lies
whole in one of them. Passages ask a BM25 index whose impacts are divided by what the item scores against itself, so a score
is the share of an item that a passage covers and one threshold serves items of any length. A passage is looked at only
where the block maxima of its terms can reach the threshold; there block-max WAND retrieves all items above it, with no
limit on their number. An item counts as found when enough of its word runs stand in the passage; where a question and an
answer can be told apart, enough of those of each: in an item of two sentences, and in a longer one with a question mark before,
or a mark like "Answer:" at, its last sentence unless that is just a few words. Overlaps of question and answer are shown for the last sentence of any item.

The items are the smaller side. They go through the driver in blocks of at most ``Test.items`` items, shortest first, and each
block is an index of its own that is broadcast: a bounded size however many items there are. Documents are not shuffled.

Defined results: null or empty texts and items find nothing; a word is a run of letters and digits in lower case; repeated
items and documents are each reported; null ids are reported as null; rows of one document and item give the passage of highest
score, the first of equals; an empty table gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orelayer.llm import hashing

SENTENCE = re.compile(r"(?<=[.!?])\s+")
ANSWER = re.compile(r"(?i)\W*(a|answer|antwort|réponse|respuesta)\s*:")


@dataclass(frozen=True)
class Test:
    threshold: float = 0.6
    overlap: float = 0.5
    run: int = 3
    # An answer of fewer runs is not asked for on its own.
    answer_runs: int = 3
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    items: int = 5_000
    # The share of an item that words of many items may make up without being looked up at first.
    plain: float = 0.3
    words_at_once: int = 400_000


def _words(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    return hashing.hashed_words((t.lower() if t else t for t in texts), hashing.not_letters_or_digits())


@dataclass
class Item:
    ident: object
    words: np.ndarray
    question: np.ndarray
    answer: np.ndarray
    whole: np.ndarray
    # Whether the answer must be found on its own.
    asks: bool


def parse_items(rows: list[tuple[object, str | None]], run: int, least_answer: int = 3) -> list[Item]:
    """Items with their word runs; the last sentence is the answer if something comes before it."""
    found = []
    for ident, text in rows:
        sentences = SENTENCE.split((text or "").strip())
        said = [(s, w) for s, w in zip(sentences, _words(sentences)) if len(w)]
        if not said:
            continue
        parts = [w for _, w in said]
        asks = len(said) > 2 and (said[-2][0].endswith("?") or bool(ANSWER.match(said[-1][0])))
        asked, told = (parts[:-1], parts[-1]) if len(parts) > 1 else (parts, parts[0][:0])
        asked = np.concatenate(asked)
        words = np.concatenate(parts)
        question, answer, whole = (np.unique(hashing.runs(w, run)) for w in (asked, told, words))
        found.append(Item(ident, words, question, answer, whole, len(said) == 2 or (asks and len(answer) >= least_answer)))
    return found


@dataclass
class Index:
    """Postings by term, in the order of items, with the highest impact per term and block of items."""

    test: Test
    items: list[Item]
    terms: np.ndarray = field(init=False)
    passage: int = field(init=False)

    def __post_init__(self) -> None:
        test, count = self.test, len(self.items)
        lengths = np.array([len(i.words) for i in self.items])
        self.passage = 2 * int(lengths.max())
        owner = np.repeat(np.arange(count), lengths)
        self.terms, term = np.unique(np.concatenate([i.words for i in self.items]), return_inverse=True)
        pairs, times = np.unique(term * count + owner, return_counts=True)
        term, owner = pairs // count, pairs % count
        found_in = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((count - found_in + 0.5) / (found_in + 0.5))
        norm = test.k1 * (1 - test.b + test.b * lengths[owner] / lengths.mean())
        impact = idf[term] * times * (test.k1 + 1) / (times + norm)
        impact = impact / np.bincount(owner, weights=impact, minlength=count)[owner]
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.owner, self.impact = owner, impact
        blocks = -(-count // test.block)
        pairs, place = np.unique(term * blocks + owner // test.block, return_inverse=True)
        highest = np.zeros(len(pairs))
        np.maximum.at(highest, place, impact)
        self.block_terms, self.block_of, self.block_max = pairs // blocks, pairs % blocks, highest
        self.block_starts = np.searchsorted(self.block_terms, np.arange(len(self.terms) + 1))
        # Terms of many items are left out of the first test as long as they are a small share of every item.
        plain, share = np.zeros(len(self.terms), bool), np.zeros(count)
        for t in np.argsort(-found_in, kind="stable"):
            low, high = self.starts[t], self.starts[t + 1]
            more = share[owner[low:high]] + impact[low:high]
            if more.max() > test.plain:
                break
            share[owner[low:high]] = more
            plain[t] = True
        self.plain = plain
        self.plain_share = np.zeros(blocks)
        np.maximum.at(self.plain_share, np.arange(count) // test.block, share)
        self.known = np.zeros(1 << 20, bool)
        self.known[self.terms >> np.uint64(44)] = True

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and the terms."""
        at = np.flatnonzero(self.known[words >> np.uint64(44)])
        term = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        same = self.terms[term] == words[at]
        return at[same], term[same]

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score with these distinct terms reaches the threshold."""
        least, size = self.test.threshold, self.test.block
        lists = []
        for t in terms:
            low, high = self.starts[t], self.starts[t + 1]
            blocks = slice(self.block_starts[t], self.block_starts[t + 1])
            lists.append(
                [
                    self.owner[low:high].tolist(),
                    self.impact[low:high].tolist(),
                    dict(zip(self.block_of[blocks].tolist(), self.block_max[blocks].tolist())),
                    float(self.impact[low:high].max()),
                    0,
                ]
            )
        found = []
        while lists:
            lists.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, None
            for n, cursor in enumerate(lists):
                bound += cursor[3]
                if bound >= least:
                    pivot = n
                    break
            if pivot is None:
                break
            item = lists[pivot][0][lists[pivot][4]]
            block = item // size
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            if sum(c[2].get(block, 0.0) for c in ahead) < least:
                # No item of this block can reach the threshold, up to where another list joins in.
                target = (block + 1) * size
                if pivot + 1 < len(lists):
                    target = max(item + 1, min(target, lists[pivot + 1][0][lists[pivot + 1][4]]))
            elif ahead[0][0][ahead[0][4]] == item:
                score = sum(c[1][c[4]] for c in ahead)
                if score >= least:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for cursor in ahead:
                if cursor[0][cursor[4]] < target:
                    cursor[4] = bisect_left(cursor[0], target, cursor[4])
            lists = [c for c in lists if c[4] < len(c[0])]
        return found

    def candidates(self, number: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages in which the block maxima of distinct terms can reach the threshold somewhere."""
        picked = ~self.plain[term]
        pairs = np.unique(number[picked] * len(self.terms) + term[picked])
        number, term = pairs // len(self.terms), pairs % len(self.terms)
        width = self.block_starts[term + 1] - self.block_starts[term]
        ends = np.cumsum(width)
        if not len(ends):
            return number
        at = np.arange(ends[-1]) - np.repeat(ends - width - self.block_starts[term], width)
        keys, place = np.unique(np.repeat(number, width) * len(self.plain_share) + self.block_of[at], return_inverse=True)
        bound = np.bincount(place, weights=self.block_max[at]) + self.plain_share[keys % len(self.plain_share)]
        return np.unique(keys[bound >= self.test.threshold - 1e-9] // len(self.plain_share))

    def search(self, documents: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """Document, item, score, overlap of question and answer, first word of the passage: the best per document and item."""
        sizes = np.array([len(d) for d in documents])
        step = self.passage // 2
        passages = np.maximum(-(-sizes // step), 1)
        first = np.cumsum(passages) - passages
        words = np.concatenate(documents)
        ends = np.cumsum(sizes)
        at, term = self.lookup(words)
        doc = np.searchsorted(ends, at, side="right")
        within = at - (ends - sizes)[doc]
        number = first[doc] + within // step
        twice = within >= step  # such a word also lies in the second half of the passage before
        all_numbers = np.concatenate([number, number[twice] - 1])
        all_terms = np.concatenate([term, term[twice]])
        some = self.candidates(all_numbers, all_terms)
        best: dict[tuple[int, int], tuple] = {}
        order = np.argsort(all_numbers, kind="stable")
        all_numbers, all_terms = all_numbers[order], all_terms[order]
        for passage, low, high in zip(some, np.searchsorted(all_numbers, some), np.searchsorted(all_numbers, some, side="right")):
            owner = int(np.searchsorted(first, passage, side="right")) - 1
            hits = self.retrieve(np.unique(all_terms[low:high]).tolist())
            if not hits:
                continue
            start = int(passage - first[owner]) * step
            body = documents[owner][start : start + self.passage]
            present: dict[int, np.ndarray] = {}
            for item, score in hits:
                one = self.items[item]
                asked, told = self._overlap(one.question, body, present), self._overlap(one.answer, body, present)
                enough = min(asked, told) >= self.test.overlap
                if not enough and not one.asks:
                    enough = self._overlap(one.whole, body, present) >= self.test.overlap
                if enough and score > best.get((owner, item), (0.0,))[0]:
                    best[owner, item] = (score, asked, told, start)
        for (owner, item), values in best.items():
            yield owner, item, *values

    def _overlap(self, wanted: np.ndarray, body: np.ndarray, present: dict[int, np.ndarray]) -> float:
        """The share of an item's runs that stand in a passage. A part shorter than a run is one run of its own length."""
        if not len(wanted):
            return 1.0
        share = 0.0
        for size in range(1, self.test.run + 1):
            if size not in present:
                present[size] = hashing.runs(body, size)
            share = max(share, float(np.isin(wanted, present[size]).mean()))
        return share


def _found(texts: list[str | None], index: Index) -> Iterator[tuple[int, int, float, float, float, int]]:
    """Text, item, score, overlaps and first word, searched some texts at a time."""
    held: list[np.ndarray] = []
    base = size = 0
    for words in _words(texts):
        held.append(words)
        size += len(words)
        if size >= index.test.words_at_once:
            for owner, *rest in index.search(held):
                yield base + owner, *rest
            base, held, size = base + len(held), [], 0
    if held:
        for owner, *rest in index.search(held):
            yield base + owner, *rest


def _indexes(items: DataFrame, test: Test, item: str, item_text: str) -> Iterator[Broadcast]:
    """The broadcast indexes of the blocks of items, shortest items first."""
    rows = items.select(items[item], items[item_text]).orderBy(F.length(items[item_text]), items[item], items[item_text])
    held: list[tuple] = []
    context = items.sparkSession.sparkContext
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == test.items:
            if block := parse_items(held, test.run, test.answer_runs):
                yield context.broadcast(Index(test, block))
            held = []
    if block := parse_items(held, test.run, test.answer_runs):
        yield context.broadcast(Index(test, block))


def find_items(
    docs: DataFrame, items: DataFrame, test: Test = Test(), ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """A row per document and test item found in it: score, overlap of question and answer, first word of the passage."""
    body = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    item_type = items.select(items[item].alias("item")).schema["item"].dataType
    schema = T.StructType(
        [T.StructField("id", body.schema["id"].dataType), T.StructField("item", item_type)]
        + [T.StructField(c, T.DoubleType()) for c in ("score", "question", "answer")]
        + [T.StructField("start", T.LongType())]
    )
    arrow_item = to_arrow_type(item_type)

    def searching(shipped: Broadcast):  # noqa: ANN202
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shipped.value
            for batch in batches:
                rows = list(_found(batch.column(1).to_pylist(), index))
                owner, item_at, score, asked, told, start = zip(*rows) if rows else [()] * 6
                idents = pa.array([index.items[i].ident for i in item_at], arrow_item)
                numbers = [pa.array(c, pa.float64()) for c in (score, asked, told)]
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), idents, *numbers, pa.array(start, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item", "score", "question", "answer", "start"])

        return search

    found = docs.sparkSession.createDataFrame([], schema)
    for shipped in _indexes(items, test, item, item_text):
        found = found.unionByName(body.mapInArrow(searching(shipped), schema))
    names = {"id": ident, "item": item, "score": "score", "question": "question_overlap", "answer": "answer_overlap", "start": "start_word"}
    return found.select(*[F.col(c).alias(n) for c, n in names.items()])


def without_items(
    docs: DataFrame, items: DataFrame, test: Test = Test(), text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item is found. Nothing is shuffled."""
    place = docs.columns.index(text)

    def clean(shipped: Broadcast):  # noqa: ANN202
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[owner for owner, *_ in _found(batch.column(place).to_pylist(), shipped.value)]] = False
                yield batch.filter(pa.array(stays))

        return keep

    for shipped in _indexes(items, test, item, item_text):
        docs = docs.mapInArrow(clean(shipped), docs.schema)
    return docs
