"""Mixing sources to target weights with exact block quotas.

Every source is a stream of words: its documents in the order of a hash, one after the other. The stream is cut into
blocks of equal size, and the mix draws blocks, not documents. Every shard owns an equal share of each source's permuted blocks,
so that no two shards draw the same one. How many blocks of each source a shard draws is decided from the top down: the quotas of
all sources are split in two by a multivariate hypergeometric draw, and each half again, until every shard has its own; no half gets
more than its blocks can give. A shard draws its own blocks in permuted order, again from the first after the last, so the tree
decides which blocks are taken and how often; within a shard the draws are shuffled by a hash. The short block at a source's end
belongs to no shard's quota; with it, or with one draw that is cut, the words taken are the target to the word.

Only one row per source goes through the driver (and a number per source and shard); ``max_sources`` bounds it and more
sources are an error, not a cut. Positions in a stream are sums over hash buckets, so no task sees a whole source.

Defined results: null text has size 0 and is never taken; a null source is a source, the last one; null ids and repeated
rows are documents like others (rows that agree in id and text may swap their places); a source of size 0 has target 0;
an empty table gives no rows. Only id, text and source are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orelayer.llm.text import word_count, words
from orelayer.session import written

# numpy draws from fewer than 10**9 blocks; block sizes grow with the corpus to stay below that.
MOST_BLOCKS = 400_000_000
BROADCAST_VALUES = 1_000_000


@dataclass(frozen=True)
class Mix:
    """How to mix: weights repeat over the sources in code point order, ``most`` times a source is the most of it."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.0
    most: int = 3
    shards: int = 16
    block_words: int = 1024
    seed: int = 20250101
    max_sources: int = 100_000


def source_targets(sizes: list[int], weights: list[float], share: float = 1.0, most: int = 3) -> list[float]:
    """Words by weight; what a source cannot give (``most`` times its size) is shared again among the others."""
    targets = [0.0] * len(sizes)
    left, waiting = share * sum(sizes), [i for i, size in enumerate(sizes) if size]
    while waiting:
        unit = left / sum(weights[i] for i in waiting)
        full = [i for i in waiting if unit * weights[i] > most * sizes[i]]
        for i in full or waiting:
            targets[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        waiting = [i for i in waiting if i not in set(full)]
    return targets


def shard_bounds(blocks: np.ndarray, shards: int) -> np.ndarray:
    """By source: the first rank that each shard owns, and the end."""
    return np.asarray(blocks, np.int64)[:, None] * np.arange(shards + 1) // shards


def shard_quotas(quotas: list[int], passes: list[int], blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws by source and shard: rows add up to ``quotas``, a shard draws none of its blocks more than ``passes`` times, and the shards'
    totals are as equal as that allows."""
    found = np.zeros((len(quotas), shards), np.int64)
    room = np.asarray(passes, np.int64)[:, None] * np.diff(shard_bounds(blocks, shards)) if quotas else found
    waiting = [(np.asarray(quotas, np.int64), 0, shards)] if quotas else []
    while waiting:
        own, low, high = waiting.pop()
        if high - low == 1:
            found[:, low] = own
            continue
        middle = (low + high) // 2
        most = np.minimum(own, room[:, low:middle].sum(axis=1))
        least = np.maximum(own - room[:, middle:high].sum(axis=1), 0)
        aim = int(own.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = np.clip(rng.multivariate_hypergeometric(own, aim, method="marginals"), least, most)
        # What the bounds took or gave is made up, again by a draw, by sources that have room for it.
        gap = min(max(aim, int(least.sum())), int(most.sum())) - int(left.sum())
        spare = most - left if gap > 0 else left - least
        left = left + np.sign(gap) * rng.multivariate_hypergeometric(spare, abs(gap), method="marginals")
        waiting += [(left, low, middle), (own - left, middle, high)]
    return found


def plan_source(size: int, take: int, block: int, seed: int) -> dict:
    """How ``take`` words come from a stream: permutation and number of its ``full`` blocks, ``quota`` draws of them in at most ``passes`` each,
    of which one is cut to ``cut`` words unless that is 0; the rest of the stream ``tails`` times and then ``rest`` words of it."""
    full, tail = divmod(size, block)
    step = max(1, int(full * 0.6180339887))
    while full and gcd(step, full) != 1:
        step += 1
    turns, left = divmod(take, size) if size else (0, 0)
    last = min(left // block, full)
    more = left - last * block
    cut = more if more > tail else 0
    last += bool(cut)
    return {
        "full": full, "step": step, "shift": seed % full if full else 0, "quota": turns * full + last, "passes": turns + bool(last),
        "cut": cut, "tails": turns, "rest": 0 if cut else more,
    }


def _sources(measured: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its place, size, target, permutation, and what each shard owns and draws of it."""
    rows = measured.groupBy("source").agg(F.sum("size").alias("n")).take(mix.max_sources + 1)
    if len(rows) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources; group them first or raise max_sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in rows]
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(rows))]
    targets = source_targets(sizes, weights, mix.share, mix.most)
    block = max(mix.block_words, -(-mix.most * sum(sizes) // MOST_BLOCKS))
    plans = [plan_source(n, min(round(t), mix.most * n), block, mix.seed) for n, t in zip(sizes, targets)]
    column = {c: [p[c] for p in plans] for c in ("quota", "passes", "full")}
    quotas = shard_quotas(column["quota"], column["passes"], column["full"], mix.shards, mix.seed)
    bounds = shard_bounds(column["full"], mix.shards)
    plain = ("full", "step", "shift", "passes", "cut", "tails", "rest")
    schema = T.StructType(
        [T.StructField("source", T.StringType()), T.StructField("slot", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("source_size", "block_words", *plain, "cut_shard")]
        + [T.StructField("target", T.DoubleType())]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("bounds", "quotas")]
    )
    values = [
        (
            r.source, i, sizes[i], block, *(plans[i][c] for c in plain),
            int(np.flatnonzero(quotas[i])[-1]) if plans[i]["cut"] else -1, targets[i], bounds[i].tolist(), quotas[i].tolist(),
        )
        for i, r in enumerate(rows)
    ]
    found = measured.sparkSession.createDataFrame(values, schema)
    return F.broadcast(found) if len(rows) * (2 * mix.shards + 14) <= BROADCAST_VALUES else found


def _placed(rows: DataFrame) -> DataFrame:
    """``start``: the words before a document in its source's stream, summed over buckets of its key's first bits."""
    bucket = ["slot", "coarse", "fine"]
    rows = rows.withColumn("coarse", F.shiftrightunsigned("key", 54)).withColumn(
        "fine", F.shiftrightunsigned("key", 44).bitwiseAND(F.lit(1023))
    )
    fine = rows.groupBy(*bucket).agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("slot", "coarse").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("slot").orderBy("coarse")) - F.col("n")
    coarse = coarse.select("slot", "coarse", ahead.alias("ahead"))
    within = F.sum("n").over(Window.partitionBy("slot", "coarse").orderBy("fine")) - F.col("n")
    fine = fine.select(*bucket, within.alias("within")).join(coarse, ["slot", "coarse"])
    order = Window.partitionBy(*bucket).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("running", F.sum("size").over(order) - F.col("size"))
    return running.join(fine, bucket).withColumn("start", F.col("ahead") + F.col("within") + F.col("running"))


def _draws(seed: int) -> Column:
    """What the mix takes of a document: a struct per pass and block, with the words [from, from + words) of it."""
    c = F.col
    first, final = F.expr("start div block_words"), F.expr("(start + size - 1) div block_words")

    def owned(block: Column) -> Column:
        """The block's rank among the source's permuted blocks, and the shard that owns it."""
        rank = (c("step") * block + c("shift")) % F.greatest(c("full"), F.lit(1).cast("bigint"))
        return F.struct(block.alias("block"), rank.alias("rank"), (F.size(F.filter("bounds", lambda e: e <= rank)) - 1).alias("shard"))

    def draw(o: Column, turn: Column) -> Column:
        block, shard, whole = o["block"], o["shard"], o["block"] < c("full")
        begin = F.get("bounds", shard)
        number = turn * (F.get("bounds", shard + 1) - begin) + o["rank"] - begin
        quota = F.get("quotas", shard)
        low = F.greatest(c("start"), block * c("block_words"))
        high = F.least(c("start") + c("size"), (block + 1) * c("block_words"))
        part = lambda n: F.least(high, block * c("block_words") + n)
        of_full = F.when((c("cut_shard") == shard) & (number == quota - 1), part(c("cut"))).when(number < quota, high).otherwise(low)
        of_tail = F.when(turn < c("tails"), high).when(turn == c("tails"), part(c("rest"))).otherwise(low)
        return F.struct(
            F.when(whole, shard).otherwise(F.pmod(c("slot"), F.size("quotas"))).alias("shard"),
            F.xxhash64(F.lit(seed), c("slot"), turn, block).alias("place"),
            turn.alias("turn"),
            block.alias("block"),
            (low - c("start")).alias("from"),
            F.greatest(F.when(whole, of_full).otherwise(of_tail) - low, F.lit(0)).alias("words"),
        )

    turns = F.sequence(F.lit(0).cast("bigint"), F.greatest(c("passes"), c("tails")))
    blocks = F.transform(F.sequence(first, final), owned)
    made = F.flatten(F.transform(blocks, lambda o: F.transform(turns, lambda t: draw(o, t))))
    return F.when(c("size") > 0, F.filter(made, lambda d: d["words"] > 0))


def mix_sources(docs: DataFrame, mix: Mix = Mix(), ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``taken`` and its ``draws`` (null: nothing to take)."""
    measured = docs.select(
        docs[ident].alias("id"),
        docs[source].cast("string").alias("source"),
        word_count(docs[text]).alias("size"),
        F.xxhash64(F.lit(mix.seed), docs[ident], docs[text]).alias("key"),
    )
    measured = written(measured, "mix-sizes")
    sources = _sources(measured, mix)
    known = measured.join(sources.select("source", "slot"), measured["source"].eqNullSafe(sources["source"])).select(
        "id", "size", "key", "slot"
    )
    drawn = _placed(known).join(sources.drop("source"), "slot").withColumn("draws", _draws(mix.seed))
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["words"])
    return drawn.select(
        F.col("id").alias(ident),
        "size",
        "source_size",
        "target",
        F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"),
        "draws",
    )


def shard_pieces(docs: DataFrame, mixed: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: ``shard``, ``place``, the document and the words drawn, each shard sorted by place.

    Ids must tell documents apart. A shard is sorted in one task: choose as many shards as shards should be small.
    """
    drawn = mixed.select(F.col(ident).alias("id"), F.explode("draws").alias("d"))
    body = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    piece = F.array_join(F.slice(words(F.col("text")), F.col("d.from").cast("int") + 1, F.col("d.words").cast("int")), " ")
    found = drawn.join(body, "id").select("d.shard", "d.place", F.col("id").alias(ident), "d.turn", "d.block", piece.alias("piece"))
    return found.repartition("shard").sortWithinPartitions("shard", "place", "block")
