"""Toxicity of whole texts from subword bags.

A passage of some words is the average of the embeddings of its character n-grams, and a linear softmax over that average
tells toxic from other passages; embeddings and softmax are trained together with numpy. A misspelling that training never
saw shares most n-grams with the word it hides. Labels are per document, so a toxic document teaches through the
passage that scores highest, other documents through all; one dimension of the embeddings starts from document counts. A document scores as its most toxic passage, put on the
scale of chances by a logistic fit on the training documents.

Training reads a bounded, documented sample of labelled rows: of each label at most ``Settings.sample`` documents, those
whose hashed ids are lowest; it runs on the driver, which gets those texts alone: toxic ones whole, of longer clean ones
pieces of ``Settings.train_chars`` characters in all, spread evenly over the whole text. The logistic fit is on the most toxic
passage of whole texts, found where they lie. Scoring reads every text in full, where it lies, with one number per n-gram bucket.

Defined results: null or empty text has the score of a text without n-grams, the same for all; rows keep their id, null
or repeated; several labels of one id count as toxic if one is; where one label is missing altogether every score is that
label's share; a long text is scored part by part; an empty table gives no rows. Only id and text are read for scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelayer.llm import grams
from orelayer.session import written


# Passages that are worked on at a time where a whole sample would take too much of the driver's memory.
SLICE = 20_000


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    dim: int = 8
    passage: int = 8
    sample: int = 1000
    train_chars: int = 10_000
    piece_chars: int = 500
    epochs: int = 8
    batch: int = 256
    rate: float = 0.05
    embed_rate: float = 0.005
    start: float = 10.0
    prior: float = 4.0
    weak: float = 3.0
    decay: float = 1e-6
    min_passages: int = 3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``weight`` of every n-gram bucket in a passage's logit, then slope and shift to the logit of a chance."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    settings: Settings


def _passages(parts: list[str], settings: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per gram size (passage, bucket), and for all passages the part they come from; passages are numbered in order."""
    codes, part = grams.code_points(parts, grams.word_characters())
    blank = codes == grams.BLANK
    opens = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
    word_part = part[opens + 1]
    first = np.searchsorted(word_part, np.arange(len(parts)))
    within = (np.arange(len(opens)) - first[word_part]) // settings.passage
    # Number passages over all parts: a new one begins where the part or the passage within it changes.
    change = np.ones(len(opens), bool)
    change[1:] = (np.diff(word_part) != 0) | (np.diff(within) != 0)
    number = np.cumsum(change) - 1
    found = []
    for size in settings.sizes:
        at, bucket = grams.hashed(codes, size, settings.bits)
        word = np.searchsorted(opens, at, side="right") - 1
        found.append((number[word] if len(opens) else at, bucket))
    return found, word_part[change]


def _logits(parts: list[str], model_weight: np.ndarray, bias: float, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The logit of every passage and its part."""
    found, owner = _passages(parts, settings)
    sums, counts = np.zeros(len(owner)), np.zeros(len(owner))
    for passage, bucket in found:
        sums += np.bincount(passage, weights=model_weight[bucket], minlength=len(owner))
        counts += np.bincount(passage, minlength=len(owner))
    return sums / np.maximum(counts, 1) + bias, owner


def highest(texts: list[str | None], weight: np.ndarray, bias: float, settings: Settings) -> np.ndarray:
    """Per text the logit of its most toxic passage; without n-grams, the bias."""
    best = np.full(len(texts), -np.inf)
    for owners, parts in grams.blocks(t or "" for t in texts):
        logit, owner = _logits(parts, weight, bias, settings)
        np.maximum.at(best, np.asarray(owners)[owner], logit)
    return np.where(np.isneginf(best), bias, best)


def _bags(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all passages: their text, where their buckets start, the buckets. Rare buckets share bucket 0."""
    owner, sizes, bucket = [], [], []
    for owners, parts in grams.blocks(texts):
        found, own = _passages(parts, settings)
        owner.append(np.asarray(owners)[own])
        passages = np.concatenate([p for p, _ in found])
        bucket.append(np.concatenate([b for _, b in found])[np.argsort(passages, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(passages, minlength=len(own)))
    buckets = np.concatenate(bucket)
    common = np.bincount(buckets, minlength=1 << settings.bits) >= settings.min_passages
    buckets = np.where(common[buckets], buckets, np.int32(0))
    return np.concatenate(owner), np.cumsum([0, *np.concatenate(sizes)]), buckets


def _pairs(owner: np.ndarray, starts: np.ndarray, buckets: np.ndarray, bits: int) -> np.ndarray:
    """The distinct pairs of document and bucket, found some passages at a time."""
    found = []
    for low in range(0, len(owner), SLICE):
        high = min(low + SLICE, len(owner))
        own = np.repeat(owner[low:high].astype(np.int64), np.diff(starts[low : high + 1]))
        found.append(np.unique(own << bits | buckets[starts[low] : starts[high]]))
    return np.unique(np.concatenate(found))


def _means(weight: np.ndarray, starts: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean weight of every passage's buckets, some passages at a time."""
    found = np.zeros(len(sizes))
    for low in range(0, len(sizes), SLICE):
        high = min(low + SLICE, len(sizes))
        row = np.repeat(np.arange(high - low), sizes[low:high])
        sums = np.bincount(row, weights=weight[buckets[starts[low] : starts[high]]], minlength=high - low)
        found[low:high] = sums / np.maximum(sizes[low:high], 1)
    return found


def _evidence(owner: np.ndarray, starts: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, settings: Settings) -> np.ndarray:
    """Per bucket the log odds of toxic documents among those that have it, in standard deviations; weak ones are 0."""
    pairs = _pairs(owner, starts, buckets, settings.bits)
    has, size = pairs & ((1 << settings.bits) - 1), 1 << settings.bits
    bad = np.bincount(has, weights=toxic[pairs >> settings.bits], minlength=size)
    good, share = np.bincount(has, minlength=size) - bad, toxic.mean()
    a, b = bad + settings.prior * share, good + settings.prior * (1 - share)
    total_a, total_b = toxic.sum() + settings.prior, (1 - toxic).sum() + settings.prior
    odds = np.log(a / (total_a - a)) - np.log(b / (total_b - b))
    sure = odds / np.sqrt(1 / a + 1 / b)
    return np.where(np.abs(sure) >= settings.weak, sure, 0.0)


def spread(text: str, settings: Settings) -> str:
    """A long text as pieces, cut at blanks, that are spread evenly from its start to its end."""
    if len(text) <= settings.train_chars:
        return text
    starts = np.linspace(0, len(text) - settings.piece_chars, settings.train_chars // settings.piece_chars).astype(int).tolist()
    pieces = []
    for start in starts:
        piece = text[start : start + settings.piece_chars]
        # A word that is cut at an end of the piece goes.
        low = piece.find(" ") + 1 if start and text[start - 1] != " " else 0
        high = piece.rfind(" ") if start + len(piece) < len(text) and text[start + len(piece)] != " " else len(piece)
        pieces.append(piece[low:high] if low < high else piece)
    return " ".join(pieces)


def train(texts: list[str], toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Embeddings and softmax by stochastic gradient steps with per-value step sizes."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    size = 1 << settings.bits
    if not 0.0 < share < 1.0:
        chance = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), 0.0, 0.0, float(np.log(chance / (1 - chance))), settings)
    rng = np.random.default_rng(settings.seed)
    owner, starts, buckets = _bags(texts, settings)
    label = toxic[owner].astype(np.int64)
    embed = rng.uniform(-0.5, 0.5, (size, settings.dim)) / settings.dim
    soft, bias = rng.uniform(-0.5, 0.5, (settings.dim, 2)), np.zeros(2)
    # One dimension starts from how surely documents with an n-gram are toxic, so that the first passages chosen are the right ones.
    embed[:, 0], soft[0] = settings.start * _evidence(owner, starts, buckets, toxic, settings), (-0.5, 0.5)
    embed[0] = 0.0
    seen_s, seen_b = np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    sizes = np.diff(starts)
    chosen = np.flatnonzero(sizes > 0)
    for _ in range(settings.epochs):
        weight = embed @ (soft[:, 1] - soft[:, 0])
        logit = _means(weight, starts, buckets, sizes)[chosen]
        order = np.lexsort((-logit, owner[chosen]))
        top = np.ones(len(order), bool)
        top[1:] = np.diff(owner[chosen][order]) != 0
        tops = chosen[order[top]]
        use = np.sort(np.concatenate([chosen[label[chosen] == 0], tops[label[tops] == 1]]))
        balance = np.bincount(label[use], minlength=2)
        cost = len(use) / (2.0 * np.maximum(balance, 1))
        shuffled = use[rng.permutation(len(use))]
        for low in range(0, len(use), settings.batch):
            some = shuffled[low : low + settings.batch]
            n = sizes[some]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) - np.repeat(ends - n - starts[some], n)
            ids = buckets[at]
            mean = np.add.reduceat(embed[ids], ends - n, axis=0) / n[:, None]
            score = mean @ soft + bias
            chance = np.exp(score - score.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(some)), label[some]] -= 1.0
            grad = chance * cost[label[some]][:, None] / len(some)
            grad_s, grad_b = mean.T @ grad, grad.sum(axis=0)
            grad_m = (grad @ soft.T) / n[:, None]
            known, place = np.unique(ids, return_inverse=True)
            row = np.repeat(np.arange(len(some)), n)
            grad_e = np.stack([np.bincount(place, weights=grad_m[row, d]) for d in range(settings.dim)], axis=1)
            grad_e += settings.decay * embed[known]
            grad_e[known == 0] = 0.0
            # Embeddings move by the sum over passages, so that n-grams of many passages outweigh those of one or two.
            embed[known] -= settings.embed_rate * len(some) * grad_e * n.mean()
            for values, gradient, seen in ((soft, grad_s, seen_s), (bias, grad_b, seen_b)):
                seen += gradient**2
                values -= settings.rate * gradient / np.sqrt(seen)
    weight, shift = embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])
    return _calibrated(weight, shift, highest(texts, weight, shift, settings), toxic, settings)


def _calibrated(weight: np.ndarray, bias: float, x: np.ndarray, toxic: np.ndarray, settings: Settings) -> Model:
    """A logistic fit of the labels on the highest logits, labels softened a little so that it is always finite."""
    share = float(toxic.mean())
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((1 - toxic).sum() + 2)
    aim = np.where(toxic == 1, high, low)
    balance = np.where(toxic == 1, 0.25 / share, 0.75 / (1 - share))
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    z, slope, shift = (x - centre) / spread, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        w, r = balance * p * (1 - p) + 1e-9, balance * (p - aim)
        hessian = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, [(r * z).sum(), r.sum()])
        slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
    return Model(weight, bias, slope / spread, shift - slope * centre / spread, settings)


def learn(
    docs: DataFrame, labels: DataFrame, training: Column, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Train on at most ``settings.sample`` labelled documents of each label; ``training`` is a condition on ``doc_id``."""
    known = labels.select(labels[ident].alias("doc_id"), labels[label].alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")).where(training)
    lowest = [known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample) for value in (0, 1)]
    chosen = F.broadcast(lowest[0].unionByName(lowest[1]))
    rows = docs.select(docs[ident].alias("doc_id"), docs[text].alias("text")).join(chosen, "doc_id")
    # Rows may repeat an id: the sample is bounded by rows too.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * settings.sample)
    rows = written(rows.select("text", "toxic").repartition(32), "toxicity-sample")

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "") if bad else spread(t or "", settings) for t, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "toxic"])

    found = rows.mapInArrow(shortened, "text string, toxic int").orderBy("toxic", F.xxhash64("text")).toArrow()
    model = train([t or "" for t in found["text"].to_pylist()], found["toxic"].to_numpy(), settings)
    if not model.slope:
        return model

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = highest(batch.column(0).to_pylist(), model.weight, model.bias, settings)
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column(1)], ["x", "toxic"])

    whole = rows.mapInArrow(judged, "x double, toxic int").orderBy("toxic", "x").toArrow()
    return _calibrated(model.weight, model.bias, whole["x"].to_numpy(), whole["toxic"].to_numpy(), settings)


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``score`` between 0 and 1 and ``predicted``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = highest(batch.column(1).to_pylist(), model.weight, model.bias, model.settings)
            chance = 1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance)], ["id", "score"])

    body = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    kind = body.schema["id"].dataType.simpleString()
    found = body.mapInArrow(scored, f"id {kind}, score double")
    return found.select(F.col("id").alias(ident), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
