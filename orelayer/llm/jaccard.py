"""All pairs of documents whose word shingles agree to three quarters, and the groups they form. No pair is missed.

Documents become sets of hashed shingles. Equal sets are one class from the start. A set is represented by a bitmap whose
length follows its size, and by its first shingles in an order that puts common ones last: two sets that agree well enough
share one of these. Sets that share one meet in tiles of a shingle and a band of sizes; bands are as wide as the sizes that
can agree, so a pair meets in the band of its smaller set. Bit counts bound the overlap of a pair from above; only pairs
that pass have their texts read again, and their sorted arrays intersected exactly.

No group is paired off: in every tile all sets are compared with the least one; sets that are linked by then form one
component, and only sets of another component than the tile's first are compared with the rest, by the bit counts of their
bitmaps inside the tile, large tiles block by block. Pairs within a component cannot change the result.

Common shingles are found on a bounded sample (``Join.sample`` documents). They only decide the order, which must be the same
everywhere and nothing else: results do not depend on it.

Defined results: null or empty text, or text without a word, has no shingles and no links; fewer words than a shingle are one
shingle; a null id is never linked; rows that share an id are one document for links, each with its own count; an empty table
gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelayer.llm import hashing
from orelayer.llm.components import components
from orelayer.llm.scratch import Scratch
from orelayer.session import written


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 75
    sample: int = 40_000
    common_least: int = 6
    most_common: int = 200_000
    block: int = 1024
    # Sets share few tiles of more members than this, and may share thousands of smaller ones.
    large: int = 64
    broadcast_ids: int = 2_000_000


def _body(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(docs[ident].alias("id"), docs[text].alias("text"))


def _sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    for found in hashing.hashed_words(texts, hashing.blanks()):
        yield hashing.shingles(found, words)


def common_shingles(body: DataFrame, join: Join) -> np.ndarray:
    """Shingles of at least ``join.common_least`` sampled documents, sorted; at most ``join.most_common``, by count."""
    words = join.words

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches, 128):
            found = np.concatenate([*_sets(batch.column(0).to_pylist(), words)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    ids = body.select("id").orderBy(F.xxhash64("id"), "id").limit(join.sample)
    some = body.join(F.broadcast(ids.distinct()), "id").select("text")
    counts = some.mapInArrow(shingled, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= join.common_least).orderBy(F.desc("n"), "shingle").limit(join.most_common).select("shingle").toArrow()
    return np.sort(found["shingle"].to_numpy().view(np.uint64))


def signatures(body: DataFrame, common: np.ndarray, join: Join) -> DataFrame:
    """Per row: set size, 128 bits that tell the set, its bitmap, the shingles by which it is found, and a number that tells
    the row once this is written."""
    words, percent = join.words, join.percent

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches):
            sizes, first, second, bitmaps, found = [], [], [], [], []
            for one in _sets(batch.column(1).to_pylist(), words):
                n = len(one)
                sizes.append(n)
                first.append(int(np.bitwise_xor.reduce(hashing.mixed(one))) if n else 0)
                second.append(int(np.add.reduce(hashing.mixed(one ^ np.uint64(hashing.ODD)))) if n else 0)
                cells = 1 << max(0, (n - 1).bit_length() - 5)
                bitmap = np.zeros(cells, np.uint64)
                bit = one & np.uint64(cells * 64 - 1)
                np.bitwise_or.at(bitmap, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
                bitmaps.append(bitmap.view(np.int64))
                keep = n - -(-percent * n // 100) + 1 if n else 0
                late = common[np.minimum(np.searchsorted(common, one), len(common) - 1)] == one if len(common) else np.zeros(n, bool)
                rare = one[~late][:keep]
                found.append(np.concatenate([rare, one[late][: keep - len(rare)]]).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    pa.array(bitmaps, longs),
                    pa.array(found, longs),
                ],
                ["id", "n", "first", "second", "bitmap", "found"],
            )

    kind = body.schema["id"].dataType.simpleString()
    found = body.mapInArrow(signed, f"id {kind}, n bigint, first bigint, second bigint, bitmap array<bigint>, found array<bigint>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _tiles(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Shingle, band, set and whether the band is the set's own (or the next smaller one), for shingles of two sets or more."""
    found = sets.select("id", "n", F.explode("found").alias("shingle"))
    shared = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > 1).select("shingle")
    shared = scratch.write(shared, "shared-shingles")
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(4 / 3) + 1e-9).cast("int")
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own"))))
    return found.join(shared, "shingle").select("shingle", "id", "n", both.alias("t")).select("shingle", "t.band", "t.own", "id", "n")


def _folded(long: Column, short: Column) -> Column:
    """A bitmap of the length of ``short``: the halves of one that is twice as long are laid over each other."""
    half = F.size(short)
    return F.when(F.size(long) == half, long).otherwise(
        F.transform(F.slice(long, 1, half), lambda v, i: v.bitwiseOR(F.get(long, i + half)))
    )


def _may_link(join: Join) -> Column:
    """Whether the sizes, and the overlap that the bitmaps allow, reach the share asked for."""
    a, b, n, m = F.col("bitmap_a"), F.col("bitmap_b"), F.col("n_a"), F.col("n_b")
    x, y = _folded(a, F.when(F.size(a) <= F.size(b), a).otherwise(b)), _folded(b, F.when(F.size(a) <= F.size(b), a).otherwise(b))
    extra = lambda p, q: F.aggregate(F.zip_with(p, q, lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))), F.lit(0), lambda s, v: s + v)
    most = F.least(n - extra(x, y), m - extra(y, x))
    near = (100 * F.least(n, m) >= join.percent * F.greatest(n, m)) & (F.size(a) <= 2 * F.size(b)) & (F.size(b) <= 2 * F.size(a))
    return F.when(near, (100 + join.percent) * most >= join.percent * (n + m)).otherwise(False)


def _bounded(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs that sizes and bitmaps leave."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bitmap_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(join)).select("a", "b")


def _verified(pairs: DataFrame, body: DataFrame, join: Join, scratch: Scratch) -> DataFrame:
    """The pairs whose sets agree to the share asked for, by intersecting their sorted arrays."""
    words, percent = join.words, join.percent
    pairs = scratch.write(pairs, "pairs")
    one, other = (pairs.select(F.col(c).alias("id")).distinct() for c in ("a", "b"))
    ids = scratch.write(one.unionByName(other).distinct(), "pair-ids")
    needed = F.broadcast(ids) if ids.count() <= join.broadcast_ids else ids
    texts = body.join(needed, "id", "left_semi")
    with_texts = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches, 128):
            linked = []
            for one, other in zip(_sets(batch.column(2).to_pylist(), words), _sets(batch.column(3).to_pylist(), words)):
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(one) + len(other) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    kind = pairs.schema["a"].dataType.simpleString()
    return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(compared, f"a {kind}, b {kind}")


def _blocks(rows: DataFrame, join: Join) -> DataFrame:
    """The members of each tile as arrays. A large tile is dealt into blocks of about ``join.block`` members, and every
    two blocks of it meet in a row of their own, so no row holds more than two blocks."""
    blocks = F.ceil(F.col("sets") / join.block).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meeting = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", meeting)
    member = F.struct("id", "n", "own", "apart", "label", "mine", "bitmap", "keys").alias("member")
    large = (F.col("sets") > join.large).alias("large")
    dealt = dealt.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), large, member)
    found = dealt.groupBy("key", "low", "high", "large").agg(F.collect_list("member").alias("members"))
    return found.select("key", "low", "high", "large", "members")


def _bounded_in_tiles(rows: DataFrame, join: Join) -> DataFrame:
    """Pairs of two components in a tile that sizes and bitmaps leave, one of them ``apart`` from the tile's head.

    Bit counts are taken in the tile: no pair becomes a row before its bound has passed. A pair that meets in several
    large tiles becomes a row in one of them, that of least key of those in which the two may be compared (``keys`` has a
    set's large tiles), and pairs of small tiles are made distinct batch by batch.
    """
    percent = join.percent

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, low, high = (batch.column(c).to_numpy() for c in range(3))
            large, column = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            flat, starts = column.values, column.offsets.to_numpy()
            fields = {c: flat.field(c) for c in ("id", "label", "bitmap", "keys")}
            n, own, apart, mine = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("n", "own", "apart", "mine"))
            labels = fields["label"].dictionary_encode().indices.to_numpy()
            bits, cuts = fields["bitmap"].values.to_numpy().view(np.uint64), fields["bitmap"].offsets.to_numpy()
            keys, owned = (fields["keys"].values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "own"))
            ends = fields["keys"].offsets.to_numpy()

            def first_met(x: int, y: int) -> int:
                a, b = slice(ends[x], ends[x + 1]), slice(ends[y], ends[y + 1])
                both, in_a, in_b = np.intersect1d(keys[a], keys[b], assume_unique=True, return_indices=True)
                return int(both[owned[a][in_a] | owned[b][in_b]].min())

            one, other = [], []
            for group in range(batch.num_rows):
                at = np.arange(starts[group], starts[group + 1])
                if not apart[at].any():
                    continue
                widths = cuts[at + 1] - cuts[at]
                width = int(widths.min())
                maps = np.stack([np.bitwise_or.reduce(bits[cuts[i] : cuts[i + 1]].reshape(-1, width), axis=0) for i in at])
                size, label = n[at], labels[at]
                for x in np.flatnonzero(apart[at]):
                    open_ = (label != label[x]) & (own[at] | own[at][x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
                    if low[group] != high[group]:
                        open_ &= mine[at] != mine[at][x]
                    y = np.flatnonzero(open_)
                    y = y[~(apart[at][y] & (y < x))]  # two that are apart meet once
                    most = np.minimum(
                        size[x] - np.bitwise_count(maps[x] & ~maps[y]).sum(axis=1, dtype=np.int64),
                        size[y] - np.bitwise_count(maps[y] & ~maps[x]).sum(axis=1, dtype=np.int64),
                    )
                    y = at[y[(100 + percent) * most >= percent * (size[x] + size[y])]]
                    if large[group]:
                        y = np.array([i for i in y if first_met(at[x], i) == key[group]], np.int64)
                    one.append(np.full(len(y), at[x]))
                    other.append(y)
            ids = fields["id"].dictionary_encode()
            code = ids.indices.to_numpy()
            pairs = [code[np.concatenate(p)].astype(np.int64) if p else np.zeros(0, np.int64) for p in (one, other)]
            told = np.unique(np.minimum(*pairs) * len(ids.dictionary) + np.maximum(*pairs))
            pick = [pa.array(told // len(ids.dictionary)), pa.array(told % len(ids.dictionary))] if len(told) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(p) for p in pick], ["id", "other"])

    kind = rows.schema["id"].dataType.simpleString()
    return _blocks(rows, join).mapInArrow(compared, f"id {kind}, other {kind}")


def link_documents(docs: DataFrame, join: Join = Join(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``n_shingles`` and ``component_id``: the least id it is linked with, directly or through others."""
    body = _body(docs, ident, text)
    # Tables are written before they are joined: then both sides of a join are plain exchanges, and adaptive execution can
    # split the partition that a large group of copies fills. They go when the links are written.
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed = scratch.write(signatures(body, common_shingles(body, join), join), "signatures")
    classes = (
        signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
        .groupBy("n", "first", "second")
        .agg(F.min(F.struct("id", "row")).alias("head"))
        .select("n", "first", "second", F.col("head.id").alias("least"), F.col("head.row").alias("row"))
    )
    classes = scratch.write(classes, "classes")
    told = signed.select("id", "n", "first", "second").join(classes.drop("row"), ["n", "first", "second"], "left")
    members = written(told.select("id", "n", "least"), "members")
    # One row per class: rows that repeat an id and a text are the same set.
    sets = signed.join(classes.select("row"), "row", "left_semi")
    sets = scratch.write(sets.select("id", "n", "bitmap", "found"), "sets")
    tiles = scratch.write(_tiles(sets, scratch), "tiles")
    sets = sets.drop("found")
    scratch.drop("signatures", "classes", "shared-shingles")

    tile = ["shingle", "band"]
    head = F.min(F.when(F.col("own"), F.struct("id", "n")))
    least = tiles.groupBy(*tile).agg(head.alias("head"), F.count(F.lit(1)).alias("sets"))
    least = least.where(F.col("head").isNotNull() & (F.col("sets") > 1)).select(*tile, F.col("head.id").alias("head"), F.col("head.n").alias("n_head"), "sets")
    headed = scratch.write(tiles.join(scratch.write(least, "tile-heads"), tile), "headed-tiles")
    scratch.drop("tiles")
    same = members.where(F.col("id").isNotNull() & F.col("least").isNotNull()).select(F.col("id").alias("a"), F.col("least").alias("b"))

    # First every set meets the least head of all its tiles, then the heads that are still of another component.
    near = (F.col("id") != F.col("head")) & (100 * F.least("n", "n_head") >= join.percent * F.greatest("n", "n_head"))
    met = headed.where(near).groupBy("id").agg(F.min("head").alias("other"))
    links = scratch.write(_verified(_bounded(_pairs(met), sets, join), body, join, scratch), "links")
    labels = components(links)
    met = headed.where(near).select("id", F.col("head").alias("other")).distinct()
    met = _labelled(_labelled(met, labels, "id"), labels, "other").where(F.col("label_id") != F.col("label_other"))
    more = _verified(_bounded(_pairs(met.select("id", "other")), sets, join), body, join, scratch)
    links = scratch.write(links.unionByName(more), "links")
    labels = components(links)

    # What is left: tiles of several components. Sets that are apart from the head's component meet all of other ones.
    known = _labelled(headed.where(F.col("sets") > 2), labels, "id").withColumnRenamed("label_id", "label")
    told_by = F.xxhash64("id", "own")
    mixed = known.groupBy(*tile).agg(
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.max(F.when(F.col("id") == F.col("head"), F.col("label"))).alias("main"),
        F.count(F.lit(1)).alias("members"),
        F.bit_xor(told_by).alias("first"),
        F.bit_xor(F.xxhash64(told_by, "n")).alias("second"),
    )
    # Documents that share a passage share many shingles: of the tiles with the same members one is enough.
    mixed = mixed.where(F.col("low") != F.col("high")).groupBy("band", "members", "first", "second", "main")
    mixed = scratch.write(mixed.agg(F.min("shingle").alias("shingle")).select(*tile, "main"), "mixed-tiles")
    # The head has met all others; it is left out.
    rest = known.join(mixed, tile).where(F.col("id") != F.col("head"))
    apart = (F.col("label") != F.col("main")).alias("apart")
    rest = scratch.write(rest.select(F.xxhash64(*tile).alias("key"), "id", "n", "own", "sets", "label", apart), "mixed-sets")
    in_large = F.when(F.col("sets") > join.large, F.struct("key", "own"))
    keys = rest.groupBy("id", "n").agg(F.sort_array(F.collect_set(in_large)).alias("keys"))
    rest = rest.join(scratch.write(sets.select("id", "n", "bitmap").join(keys, ["id", "n"]), "mixed-bitmaps"), ["id", "n"])
    more = _verified(_pairs(_bounded_in_tiles(rest, join)), body, join, scratch)
    found = components(links.unionByName(more).unionByName(same))
    scratch.drop()
    return _joined(members, found, ident)


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair once, the smaller id first."""
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``label_<name>``: the component of the set in a column; a set without links is its own."""
    found = rows.join(labels.select(F.col("node").alias(name), F.col("label").alias("of")), name, "left")
    return found.withColumn(f"label_{name}", F.coalesce("of", name)).drop("of")


def _joined(members: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    """Rows with the label of their id; an id without links is its own."""
    found = members.join(labels, members["id"] == labels["node"], "left")
    return found.select(
        F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id")
    )


def keep_one_per_group(docs: DataFrame, join: Join = Join(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those linked to a document of a smaller id. Rows with a null id stay;
    of rows that repeat an id and a text one stays."""
    linked = link_documents(docs, join, ident, text)
    gone = written(linked.where(F.col(ident) != F.col("component_id")).select(ident).distinct(), "linked-ids")
    left = docs.join(F.broadcast(gone) if gone.count() <= join.broadcast_ids else gone, ident, "left_anti").select(*docs.columns)
    again = docs.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select(ident)
    again = written(again, "repeated-ids")
    if not again.head(1):
        return left
    once = left.join(again, ident, "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, ident, "left_semi").select(*docs.columns).dropDuplicates([ident, text]))
