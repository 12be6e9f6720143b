"""Phrases whose words occur together more often than their parts suggest, per language.

Every task counts the word sequences of its texts in HAT-tries (:mod:`orelayer.llm.hat_trie`) over word ids and spills them as
sorted runs, cut into partitions by prefix: the first id, or the first two or three where the prefix before is a busy one. One task
per partition merges the runs of all tasks and keeps the sequences that reach the minimum. Words are counted first, then pairs of
frequent words, then triples and quadruples all of whose pairs are frequent; no other sequence can be frequent. Which words and pairs are
frequent is told to tasks by a bitmap of bounded size: a false positive costs time only. Scores are decimals, exact.

A word's id is a seeded 64-bit hash of language and word. The word count sees every distinct word of every language; should two
share an id, the next seed is taken, so ids are exact.

Defined results: null text is empty, a null language ``und``; A-Z are lower-cased, every other character stays; repeated rows count
each; a phrase never crosses a mark of ``BREAKS``; a text of any length is worked on in parts that share the words at their border;
an empty table gives no rows. Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orelayer.llm.hashing import ODD, _powers, folded, mixed
from orelayer.llm.hat_trie import HatTrie, decoded, encoded, row_hashes, summed
from orelayer.llm.scratch import Scratch
from orelayer.session import written

# Marks that end a piece, and the blanks between words.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
_CUT = re.compile(f"[{re.escape(BREAKS + BLANKS)}]")
UNKNOWN = "und"
# Shares that a language's phrases are ranked in before their first ones are ranked together.
SHARES = 16


@dataclass(frozen=True)
class Settings:
    least: int = 30
    longest: int = 4
    contained: int = 80
    top: int = 2000
    block: int = 1 << 20
    budget: int = 1 << 20
    limit: int = 1 << 15
    filter_bits: int = 27
    seed: int = 0


# ---------------------------------------------------------------- words of texts, in tasks


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 inside a word, 1 a blank, 2 a mark that ends a piece."""
    found = np.zeros(0x110000, np.uint8)
    found[[ord(c) for c in BLANKS]] = 1
    found[[ord(c) for c in BREAKS]] = 2
    return found


@lru_cache(maxsize=2)
def _characters(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(ODD) + mixed(np.array([seed], np.uint64)))


@lru_cache(maxsize=4096)
def _language(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


@dataclass
class Words:
    """The words of a block in order: ids, the piece each is in, and where it starts and ends in ``codes``. The first ``known`` words belong to
    the part before and were counted there; only the sequences that go on from them are new."""

    ids: np.ndarray
    piece: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    codes: np.ndarray = field(repr=False)
    known: int = 0

    def text(self, i: int) -> str:
        return self.codes[self.starts[i] : self.ends[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def sequences(self, size: int, usable: list[np.ndarray]) -> np.ndarray:
        """Rows of ``size`` ids within a piece that are not known yet; ``usable[j]`` says of each place whether a run of ``j + 1`` words may be used."""
        count = len(self.ids) - size + 1
        if count <= 0:
            return np.zeros((0, size), np.uint64)
        good = self.piece[:count] == self.piece[size - 1 :]
        good[: max(self.known - size + 1, 0)] = False
        for j, ok in enumerate(usable):
            for shift in range(size - j):
                good &= ok[shift : shift + count]
        at = np.flatnonzero(good)
        return np.column_stack([self.ids[at + j] for j in range(size)])


def _read(parts: list[str], langs: list[str], seed: int) -> Words:
    """The words of some texts; a mark stands between two texts."""
    codes = folded()[np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    kinds = _kinds()[codes]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = kinds == 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(1 << max(21, (len(codes) + 1).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_characters(seed)[codes] * up[: len(codes)], out=sums[1:])
    opens = np.cumsum([0, *(len(p) + 1 for p in parts)])
    owner = np.searchsorted(opens, starts, side="right") - 1
    tongue = np.array([_language(x, seed) for x in langs], np.uint64)
    word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(mixed(word * np.uint64(ODD) + tongue[owner]), np.cumsum(kinds == 2)[starts], starts, ends, owner, codes)


def blocks(rows: Iterable[tuple[str | None, str | None]], settings: Settings, seed: int) -> Iterator[tuple[Words, list[str]]]:
    """The words of (text, language) rows in blocks of about ``settings.block`` characters, and the languages of a block's texts."""
    held: list[str] = []
    langs: list[str] = []
    size = 0
    for text, lang in rows:
        text, lang = text or "", UNKNOWN if lang is None else lang
        if len(text) > settings.block:
            yield from _long(text, lang, settings, seed)
            continue
        held.append(text)
        langs.append(lang)
        size += len(text) + 1
        if size >= settings.block:
            yield _read(held, langs, seed), langs
            held, langs, size = [], [], 0
    if held:
        yield _read(held, langs, seed), langs


def _long(text: str, lang: str, settings: Settings, seed: int) -> Iterator[tuple[Words, list[str]]]:
    """A long text in parts cut before a blank or mark; each begins with the last words of the piece that the part before ended in."""
    start, carried = 0, np.zeros(0, np.uint64)
    while start < len(text):
        found = _CUT.search(text, start + settings.block) if start + settings.block < len(text) else None
        end = found.start() if found else len(text)
        words = _read([text[start:end]], [lang], seed)
        ended = int((_kinds()[words.codes] == 2).sum())
        n = len(carried)
        words.ids, words.piece = np.concatenate([carried, words.ids]), np.concatenate([np.zeros(n, words.piece.dtype), words.piece])
        for name in ("starts", "ends", "owner"):
            setattr(words, name, np.concatenate([np.zeros(n, np.int64), getattr(words, name)]))
        words.known = n
        last = words.ids[words.piece == ended]
        carried = last[max(len(last) - settings.longest + 1, 0) :]
        yield words, [lang]
        start = end


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None]]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


# ---------------------------------------------------------------- counting


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def count_words(docs: DataFrame, settings: Settings, seed: int) -> DataFrame:
    """``lang, word, id, n`` per distinct word, and ``clash``: whether another word has its id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names = HatTrie(1, settings.budget, settings.limit), {}

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            known = [names.pop(i) for i in keys[:, 0].tolist()]
            columns = [pa.array([lang for lang, _ in known], pa.string()), pa.array([w for _, w in known], pa.string()), _signed(keys[:, 0]), pa.array(counts)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "id", "n"])

        for words, langs in blocks(_rows(batches), settings, seed):
            new = slice(words.known, None)
            ids, place, counts = np.unique(words.ids[new], return_index=True, return_counts=True)
            for i, at in zip(ids.tolist(), (place + words.known).tolist()):
                if i not in names:
                    names[i] = langs[words.owner[at]], words.text(at)
            for run in trie.add(ids[:, None], counts):
                yield out(*run)
        for run in trie.spill():
            yield out(*run)

    found = docs.mapInArrow(count, "lang string, word string, id bigint, n bigint")
    own = F.struct("lang", "word")
    merged = found.groupBy("id").agg(F.sum("n").alias("n"), F.min(own).alias("own"), F.max(own).alias("other"))
    return merged.select("own.lang", "own.word", "id", "n", (F.col("own") != F.col("other")).alias("clash"))


def _bitmap(keys: DataFrame, count: int, settings: Settings) -> np.ndarray:
    """A bitmap of hashed rows of ids: 16 bits or more for each of ``count`` rows as long as ``filter_bits`` allow.

    It is put together in chunks on the cluster; the driver gets at most 2 ** filter_bits bits.
    """
    bits = min(max((16 * count).bit_length(), 16), settings.filter_bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            at = (row_hashes(rows) & np.uint64((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16), pa.array((at & 0xFFFF).astype(np.int32))], ["chunk", "bit"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = []
            for found in batch.column(1):
                one = np.zeros(1 << 16, bool)
                one[found.values.to_numpy()] = True
                chunks.append(np.packbits(one, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.binary())], ["chunk", "bits"])

    sets = keys.mapInArrow(places, "chunk bigint, bit int").groupBy("chunk").agg(F.collect_set("bit").alias("found"))
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for chunk, body in sets.mapInArrow(packed, "chunk bigint, bits binary").collect():
        bitmap[chunk << 13 : chunk + 1 << 13] = np.frombuffer(body, np.uint8)
    return bitmap


def _has(bitmap: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = row_hashes(rows) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _partition(keys: np.ndarray, parts: int, busy: list[np.ndarray]) -> np.ndarray:
    """The prefix partition of each sequence. ``busy[j]`` holds the hashes of busy prefixes of ``j + 1`` ids: those are cut by one id more."""
    found = keys[:, 0].copy()
    for j, known in enumerate(busy):
        if j + 1 >= keys.shape[1] or not len(known):
            break
        prefix = row_hashes(keys[:, : j + 1])
        place = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
        hit = known[place] == prefix
        if not hit.any():
            break
        found[hit] = row_hashes(keys[hit, : j + 2])
    return (mixed(found) >> np.uint64(64 - (parts - 1).bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)


def count_sequences(
    docs: DataFrame, sizes: list[int], filters: list[np.ndarray], busy: list[np.ndarray], parts: int, settings: Settings, seed: int, name: str, scratch: Scratch
) -> DataFrame:
    """``size, a, b, c, d, n`` of the sequences that occur at least ``settings.least`` times; ids beyond the size are null.

    ``filters`` are bitmaps of the words and pairs that may be part of one; ``parts`` a power of two.
    """
    context = docs.sparkSession.sparkContext
    told = context.broadcast((filters, busy))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, busy = told.value
        tries = {size: HatTrie(size, settings.budget // len(sizes), settings.limit) for size in sizes}

        def out(size: int, runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            runs = list(runs)
            if not runs:
                return
            keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([c for _, c in runs])
            part = _partition(keys, parts, busy)
            order = np.lexsort((*keys.T[::-1], part))
            keys, counts, part = keys[order], counts[order], part[order]
            opens = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            cuts = [*opens.tolist(), len(part)]
            bodies = [encoded(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            columns = [pa.array(np.full(len(bodies), size, np.int32)), pa.array(part[opens]), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["size", "part", "run"])

        for words, _ in blocks(_rows(batches), settings, seed):
            usable = [_has(filters[0], words.ids[:, None])]
            if len(filters) > 1 and len(words.ids) > 1:
                pairs = np.column_stack([words.ids[:-1], words.ids[1:]])
                usable.append(_has(filters[1], pairs))
            for size, trie in tries.items():
                yield from out(size, trie.add(words.sequences(size, usable)))
        for size, trie in tries.items():
            yield from out(size, trie.spill())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, rows = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            keys, counts = keys[counts >= settings.least], counts[counts >= settings.least]
            size = keys.shape[1]
            ids = [_signed(keys[:, j]) if j < size else pa.nulls(len(keys), pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), *ids, pa.array(counts)], ["size", "a", "b", "c", "d", "n"])

        for batch in batches:
            for size, part, run in zip(*(c.to_pylist() for c in batch.columns)):
                if (size, part) != last and held:
                    yield from out()
                    held, rows = [], 0
                last = size, part
                held.append(decoded(run))
                rows += len(held[-1][0])
                if rows > 2 * settings.budget:  # what is alike in many runs becomes one row
                    held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    rows = len(held[0][0])
        if held:
            yield from out()

    runs = scratch.write(docs.mapInArrow(count, "size int, part bigint, run binary"), f"{name}-runs")
    dealt = runs.repartition("size", "part").sortWithinPartitions("size", "part")
    found = scratch.write(dealt.mapInArrow(merge, "size int, a bigint, b bigint, c bigint, d bigint, n bigint"), name)
    told.unpersist()
    scratch.drop(f"{name}-runs")
    return found


def _busy(rows: DataFrame, columns: list[str], share: int) -> np.ndarray:
    """Sorted hashes of the prefixes that begin more than one in ``share / 4`` of all sequences: at most so many by counting."""
    found = rows.where(F.col("n") >= share).select(*columns).toArrow()
    if not found.num_rows:
        return np.zeros(0, np.uint64)
    return np.sort(row_hashes(np.column_stack([c.to_numpy().view(np.uint64) for c in found.columns])))


def frequent(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words per language (``lang, words``), the frequent words (``lang, word, id, n``), and the frequent sequences of two and more words."""
    scratch = Scratch(docs.sparkSession, "phrases")
    body = docs.select("text", "lang")
    for seed in range(settings.seed, settings.seed + 16):
        words = scratch.write(count_words(body, settings, seed), "words")
        if words.where("clash").isEmpty():
            break
        scratch.drop("words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("words")), "phrases-totals")
    common = written(words.where(F.col("n") >= settings.least).select("lang", "word", "id", "n"), "phrases-words")
    scratch.drop("words")
    total, kinds = totals.agg(F.sum("words")).first()[0] or 0, common.count()
    parts = 1 << max(10, (total >> 18).bit_length())
    share = max(total // (4 * parts), settings.least)
    singles = _bitmap(common.select("id"), kinds, settings)
    busy = [_busy(common, ["id"], share)]
    pairs = count_sequences(body, [2], [singles], busy, parts, settings, seed, "pairs", scratch)
    found = [written(pairs, "phrases-pairs")]
    if settings.longest > 2:
        both = _bitmap(pairs.select("a", "b"), pairs.count(), settings)
        busy.append(_busy(pairs, ["a", "b"], share))
        longer = count_sequences(body, list(range(3, settings.longest + 1)), [singles, both], busy, parts, settings, seed, "longer", scratch)
        found.append(written(longer, "phrases-longer"))
    scratch.drop()
    sequences = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return totals, common, sequences


# ---------------------------------------------------------------- scores


def _wide(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``settings.top`` phrases.

    A candidate is cut where its score, floor(2,000,000 * a / (l + r)), is lowest. Candidates that stand inside a longer one
    with ``contained`` % of their count go.
    """
    totals, common, sequences = frequent(docs, settings)
    ids = F.filter(F.array("a", "b", "c", "d"), lambda x: x.isNotNull())
    candidates = sequences.select(ids.alias("key"), "size", F.col("n").alias("a"))
    known = candidates.select("key", "a").unionByName(common.select(F.array("id").alias("key"), F.col("n").alias("a")))

    cuts = candidates.select("key", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.slice("key", F.lit(1), F.col("k")).alias("left"), F.expr("slice(key, k + 1, size - k)").alias("right"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    lowest = cuts.groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = candidates.where("size > 2").select("key", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("key", "a", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = inner.groupBy(F.expr("slice(key, at, m)").alias("key")).agg(F.max("a").alias("longer"))
    inside = _wide(F.col("longer")) * 100 >= _wide(F.col("a")) * settings.contained
    kept = lowest.join(inner, "key", "left").where(~F.coalesce(inside, F.lit(False)))

    # The words of the ids, in order; the first id tells the language.
    places = kept.select("key", F.posexplode("key").alias("at", "id")).join(common.select("id", "lang", "word"), "id")
    named = places.groupBy("key").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    phrase = F.concat_ws(" ", F.transform("words", lambda w: w["word"]))
    rows = kept.join(named, "key").select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # The first of each of some shares of a language hold its first; so no task gets the first of every other task.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= settings.top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    ranked = ranked.where(F.col("rank") <= settings.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
