"""Languages of a document as a mixture: proportions by expectation-maximisation, the set of languages by likelihood.

A language is a distribution over hashed character trigrams, counted over all training documents. A document is a
mixture of languages: expectation-maximisation finds the proportions that make its trigrams likeliest. Every further
language costs ``penalty * ln(trigrams)``; languages are taken in order of their proportion, as many as the penalised
likelihood is best with. The language of the document is the one of largest proportion, its score that proportion.

Trigrams are counted by Spark with partial sums per task; the table of languages and buckets (at most
``max_languages`` by ``2**bits`` numbers) is all that reaches the driver. Documents are scored where they are read.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is every text when nothing was
learned; ties go to the language that sorts first; rows keep their id, null or repeated; a long text is counted part by
part and judged whole; an empty table gives no rows. Only id, text and language are read, the language for learning only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelayer.llm import grams

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 15
    smoothing: float = 0.5
    rounds: int = 12
    penalty: float = 4.0
    max_languages: int = 500
    # Rows of trigrams by language that are worked on at a time.
    cells: int = 4_000_000


@dataclass(frozen=True)
class Languages:
    names: list[str]
    chances: np.ndarray  # bucket by language
    settings: Settings


def _trigrams(parts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    codes, part = grams.code_points(parts, grams.letters())
    at, bucket = grams.hashed(codes, 3, bits)
    return part[at + 1], bucket


def learn(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Languages:
    """The trigram distribution of every language of the rows where ``training`` holds and the language is not null."""
    bits = settings.bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for owners, parts in grams.blocks(t.as_py() for t in batch.column(1)):
                local = {name: i for i, name in enumerate(dict.fromkeys(names[o] for o in owners))}
                own = np.fromiter((local[names[o]] for o in owners), np.int64, len(owners))
                part, bucket = _trigrams(parts, bits)
                found = np.bincount(own[part] << bits | bucket, minlength=len(local) << bits).reshape(len(local), -1)
                for name, i in local.items():
                    sums[name] = sums.get(name, 0) + found[i]
        for name, n in sums.items():
            some = np.flatnonzero(n)
            columns = [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    rows = docs.where(training & docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].alias("lang"), docs[text].alias("text"))
    sums = rows.mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).take(settings.max_languages + 1)
    if len(found) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    found.sort(key=lambda r: r.lang)
    table = np.zeros((1 << bits, len(found)))
    for i, row in enumerate(found):
        table[[c.bucket for c in row.counts], i] = [c.n for c in row.counts]
    table += settings.smoothing
    return Languages([r.lang for r in found], (table / table.sum(axis=0, keepdims=True)).astype(np.float64), settings)


class _Mixtures:
    """The trigram counts of some documents: ``doc`` (ascending), chance by language, times found."""

    def __init__(self, starts: np.ndarray, chance: np.ndarray, times: np.ndarray):
        self.starts, self.chance, self.times = starts, chance, times
        self.sizes = np.diff(np.append(starts, len(times)))
        self.total = np.add.reduceat(times, starts)

    def fit(self, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and likelihood, from a start that is 0 for the languages left out."""
        for _ in range(rounds):
            mixed = np.einsum("ml,ml->m", self.chance, np.repeat(share, self.sizes, axis=0))
            weighted = np.add.reduceat(self.chance * (self.times / mixed)[:, None], self.starts, axis=0)
            share = share * weighted / self.total[:, None]
        mixed = np.einsum("ml,ml->m", self.chance, np.repeat(share, self.sizes, axis=0))
        return share, np.add.reduceat(self.times * np.log(mixed), self.starts)

    def only(self, docs: np.ndarray) -> _Mixtures:
        rows = np.repeat(docs, self.sizes)
        sizes = self.sizes[docs]
        return _Mixtures(np.cumsum(sizes) - sizes, self.chance[rows], self.times[rows])


def proportions(mixtures: _Mixtures, settings: Settings) -> np.ndarray:
    """Proportions by document and language: those of the language set with the best penalised likelihood."""
    docs, langs = len(mixtures.starts), mixtures.chance.shape[1]
    alone = np.add.reduceat(mixtures.times[:, None] * np.log(mixtures.chance), mixtures.starts, axis=0)
    best = alone.max(axis=1)
    found = np.zeros((docs, langs))
    found[np.arange(docs), alone.argmax(axis=1)] = 1.0
    cost = settings.penalty * np.log(mixtures.total + 1.0)
    share, most = mixtures.fit(np.full((docs, langs), 1.0 / langs), settings.rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, langs + 1):
        # No set can be likelier than all languages together, so further ones are tried only where they could still win.
        open_ = most - cost * (size - 1) > best
        if not open_.any():
            break
        some = np.flatnonzero(open_)
        start = np.zeros((len(some), langs))
        np.put_along_axis(start, order[some, :size], 1.0 / size, axis=1)
        part, reached = mixtures.only(open_).fit(start, settings.rounds)
        reached = reached - cost[some] * (size - 1)
        better = reached > best[some]
        best[some[better]], found[some[better]] = reached[better], part[better]
    return found


def _counted(texts: list[str | None], settings: Settings, langs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, buckets and times found, whole documents at a time and in bounded numbers."""
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, times = np.concatenate(held), np.concatenate(counts)
        keys, place = np.unique(keys, return_inverse=True)
        return keys >> settings.bits, keys & ((1 << settings.bits) - 1), np.bincount(place, weights=times)

    last = -1
    for owners, parts in grams.blocks(t or "" for t in texts):
        if size * langs > settings.cells and owners[0] != last:
            yield merged()
            held, counts, size = [], [], 0
        part, bucket = _trigrams(parts, settings.bits)
        keys, times = np.unique(np.asarray(owners)[part] << settings.bits | bucket, return_counts=True)
        held.append(keys)
        counts.append(times)
        size, last = size + len(keys), owners[-1]
    if size:
        yield merged()


def _judged(texts: list[str | None], languages: Languages) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Language, score and proportions of each text."""
    names, settings = languages.names, languages.settings
    pred, score, shares = [UNKNOWN] * len(texts), np.zeros(len(texts)), [{} for _ in texts]
    for doc, bucket, times in _counted(texts, settings, len(names)) if names else ():
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        found = proportions(_Mixtures(starts, languages.chances[bucket], times), settings)
        for number, row in zip(doc[starts], found):
            top = int(row.argmax())
            pred[number], score[number] = names[top], min(1.0, float(row[top]))
            shares[number] = {names[i]: float(row[i]) for i in np.flatnonzero(row > 0)}
    for number, body in enumerate(texts):
        if pred[number] != UNKNOWN and not grams.has_letter(body):
            pred[number], score[number], shares[number] = UNKNOWN, 0.0, {}
    return pred, score, shares


def identify(docs: DataFrame, languages: Languages, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``lang_pred``, ``score`` and ``shares``: the proportion of every language of the document's set."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, shares = _judged(batch.column(1).to_pylist(), languages)
            maps = pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), maps]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "shares"])

    body = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    kind = body.schema["id"].dataType.simpleString()
    found = body.mapInArrow(judged, f"id {kind}, lang_pred string, score double, shares map<string,double>")
    return found.withColumnRenamed("id", ident)


def keep_identified(docs: DataFrame, languages: Languages, least: float = 0.5, part: float = 0.1, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose languages of a share of ``part`` or more make up ``least`` of the text together.

    So a text in several languages stays; one without a letter, or without evidence for any language in particular, goes. Nothing is shuffled.
    """
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, _, shares = _judged(batch.column(place).to_pylist(), languages)
            known = [p != UNKNOWN and sum(s for s in own.values() if s >= part) >= least for p, own in zip(pred, shares)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
