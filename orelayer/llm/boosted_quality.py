"""Quality of whole texts by histogram gradient-boosted trees over document statistics.

Statistics of a document come from counts of its bytes, words, pairs of neighbouring words and lines, each taken over the whole
text where it lies. Training cuts every statistic into at most ``Settings.bins`` bins at quantiles of the sample, sums
gradients and curvatures of the logistic loss per bin, node and statistic in one pass of numpy over all nodes of a level, and splits
each node where its gain is highest. All trees are flattened into arrays (statistic, threshold, left, right, value); a leaf's children
are itself, so that every document walks all trees level by level in a few numpy steps, without a branch per row.

Training reads a bounded, documented sample of labelled rows: of each label at most ``Settings.sample`` documents, those whose hashed
ids are lowest. Only their statistics come to the driver. The statistics of all documents are written once and serve training and scores.

Defined results: null text is empty, all its statistics are 0; rows keep their id, null or repeated; several labels of one
id count as 1 if one is; where one label is missing altogether every score is that label's share; an empty table gives no
rows. Only id and text are read for scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelayer.session import written


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    bins: int = 64
    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    penalty: float = 1.0
    least: float = 2.0


@dataclass(frozen=True)
class Forest:
    """Flattened trees: of every node the statistic it asks, the threshold up to which it goes left, children and value."""

    roots: np.ndarray
    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int


# Classes of bytes whose share of all bytes is a statistic.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "line_end": b"\n\r",
    "comma_period": b",.",
    "ask_shout": b"!?",
    "colon": b":;",
    "quote": b"'\"`",
    "bracket": b"()[]{}",
    "pipe": b"|",
    "angle": b"<>",
    "symbol": b"#$%&*@^~_=+\\/-",
    "wide": bytes(range(128, 256)),
}
MEASURES = [
    *CLASSES, "entropy", "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "same_neighbours", "distinct_pairs",
    "log_lines", "line_words", "repeated_lines", "open_lines", "longest_word", "sentence_words",
]


@lru_cache(maxsize=1)
def _class_matrix() -> np.ndarray:
    found = np.zeros((256, len(CLASSES)))
    for i, members in enumerate(CLASSES.values()):
        found[list(members), i] = 1
    return found


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of :data:`MEASURES` per text."""
    if not texts:
        return np.zeros((0, len(MEASURES)))
    counts, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), len(MEASURES) - len(CLASSES) - 1))
    for i, text in enumerate(texts):
        body = (text or "").encode("utf-8", "surrogatepass")
        counts[i] = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
        words = body.split()
        if not words:
            continue
        n, sizes = len(words), Counter(words)
        lines = [x for x in (line.strip() for line in body.split(b"\n")) if x]
        stops = counts[i, [33, 46, 63]].sum()
        pairs = len(set(zip(words, words[1:])))
        rest[i] = (
            np.log1p(len(body)),
            np.log1p(n),
            sum(map(len, words)) / n,
            len(sizes) / n,
            max(sizes.values()) / n,
            sum(map(eq, words, words[1:])) / n,
            pairs / max(n - 1, 1),
            np.log1p(len(lines)),
            np.log1p(n / len(lines)),
            1 - len(set(lines)) / len(lines),
            sum(not line.endswith((b".", b"!", b"?", b'"', b":")) for line in lines) / len(lines),
            np.log1p(max(map(len, sizes))),
            np.log1p(n / (stops + 1)),
        )
    total = np.maximum(counts.sum(axis=1), 1)[:, None]
    share = counts / total
    entropy = -(share * np.log2(np.maximum(share, 1e-300))).sum(axis=1)
    return np.column_stack([counts @ _class_matrix() / total, entropy, rest])


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Values between which bins lie: midpoints of neighbours where there are few, quantiles otherwise."""
    known = np.unique(column)
    if len(known) > bins:
        known = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return (known[:-1] + known[1:]) / 2


def train(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Boosted trees for the chance that ``y`` is 1."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0.0 < share < 1.0:
        chance = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros(0, np.int64)
        return Forest(none, none, np.zeros(0), none, none, np.zeros(0), float(np.log(chance / (1 - chance))), 0)
    edges = [_edges(x[:, j], settings.bins) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.int64)
    start = float(np.log(share / (1 - share)))
    logit = np.full(len(y), start)
    nodes: list[list[float]] = []  # statistic, threshold, left, right, value
    roots = []
    for _ in range(settings.trees):
        chance = 1 / (1 + np.exp(-logit))
        gradient, curve = chance - y, np.maximum(chance * (1 - chance), 1e-12)
        roots.append(len(nodes))
        where = np.full(len(y), _leaf(nodes))
        level = [roots[-1]]
        for _ in range(settings.depth):
            level = _grow(nodes, level, where, binned, edges, gradient, curve, settings)
            if not level:
                break
        sums, curves = np.bincount(where, gradient, len(nodes)), np.bincount(where, curve, len(nodes))
        for node in range(roots[-1], len(nodes)):
            nodes[node][4] = float(-settings.rate * sums[node] / (curves[node] + settings.penalty))
        logit += np.array([n[4] for n in nodes[roots[-1] :]])[where - roots[-1]]
    flat = np.array(nodes)
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(np.array(roots), *[flat[:, i].astype(k) for i, k in enumerate(kinds)], start, settings.depth)


def _leaf(nodes: list[list[float]]) -> int:
    own = len(nodes)
    nodes.append([0, np.inf, own, own, 0.0])
    return own


def _grow(
    nodes: list, level: list[int], where: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray, settings: Settings
) -> list[int]:
    """Split the nodes of a level at the bin of highest gain; moves the rows in ``where`` and returns the new nodes."""
    place = np.full(len(nodes), -1)
    place[level] = np.arange(len(level))
    rows = np.flatnonzero(place[where] >= 0)
    at, size, count = place[where[rows]], settings.bins, len(level)
    best_gain, best = np.full(count, 1e-9), np.full((count, 2), -1)
    for j, edge in enumerate(edges):
        if not len(edge):
            continue
        cell = at * size + binned[rows, j]
        g = np.bincount(cell, gradient[rows], count * size).reshape(count, size).cumsum(axis=1)
        h = np.bincount(cell, curve[rows], count * size).reshape(count, size).cumsum(axis=1)
        all_g, all_h = g[:, -1:], h[:, -1:]
        g, h = g[:, : len(edge)], h[:, : len(edge)]
        gain = g**2 / (h + settings.penalty) + (all_g - g) ** 2 / (all_h - h + settings.penalty) - all_g**2 / (all_h + settings.penalty)
        gain[(h < settings.least) | (all_h - h < settings.least)] = -1
        top = gain.argmax(axis=1)
        found = gain[np.arange(count), top]
        better = found > best_gain
        best_gain[better], best[better] = found[better], np.column_stack([np.full(count, j), top])[better]
    grown = []
    children = np.full((len(nodes), 2), -1)
    for node, (j, cut) in zip(level, best):
        if j >= 0:
            left, right = _leaf(nodes), _leaf(nodes)
            nodes[node][:4] = [int(j), float(edges[j][cut]), left, right]
            children[node] = left, right
            grown += [left, right]
    split = rows[children[where[rows], 0] >= 0]
    j, cut = best[place[where[split]], 0], best[place[where[split]], 1]
    goes_right = (binned[split, j] > cut).astype(int)
    where[split] = children[where[split], goes_right]
    return grown


def logits(x: np.ndarray, forest: Forest) -> np.ndarray:
    """The sum of the trees' values per row: all rows and trees step down one level at a time."""
    if not len(forest.roots):
        return np.full(len(x), forest.start)
    node = np.broadcast_to(forest.roots, (len(x), len(forest.roots))).copy()
    rows = np.arange(len(x))[:, None]
    for _ in range(forest.depth):
        node = np.where(x[rows, forest.statistic[node]] <= forest.threshold[node], forest.left[node], forest.right[node])
    return forest.start + forest.value[node].sum(axis=1)


def measured(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The id as ``id`` and the statistics ``x`` of every document, written."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x = statistics(part.column(1).to_pylist())
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], ["id", "x"])

    body = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    kind = body.schema["id"].dataType.simpleString()
    return written(body.mapInArrow(measure, f"id {kind}, x array<double>"), "quality-statistics")


def learn(x: DataFrame, labels: DataFrame, training: Column, settings: Settings = Settings(), ident: str = "doc_id", label: str = "quality") -> Forest:
    """Train on :func:`measured` rows of at most ``settings.sample`` documents of each label; ``training`` is a condition on ``doc_id``."""
    known = labels.select(labels[ident].alias("doc_id"), labels[label].alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("label") != 0).cast("int")).alias("label")).where(training)
    lowest = [known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample) for value in (0, 1)]
    chosen = F.broadcast(lowest[0].unionByName(lowest[1]))
    rows = x.join(chosen, x["id"] == chosen["doc_id"]).select("label", "x", F.xxhash64("id").alias("order"))
    # Rows may repeat an id: the sample is bounded by rows too, and sorted, so that reruns agree.
    found = rows.orderBy("order", "x").limit(2 * settings.sample).toArrow()
    values = found["x"].combine_chunks()
    return train(values.flatten().to_numpy().reshape(len(found), len(MEASURES)), found["label"].to_numpy().astype(float), settings)


def score(x: DataFrame, forest: Forest, ident: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """``ident``, ``score`` between 0 and 1 and ``predicted`` of :func:`measured` rows."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(MEASURES))
                chance = 1 / (1 + np.exp(-np.clip(logits(values, forest), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chance)], ["id", "score"])

    found = x.mapInArrow(scored, f"id {x.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(ident), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
