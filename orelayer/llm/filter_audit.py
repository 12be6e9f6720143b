"""What each of several filters removes on its own, together, and in every order, kept up to date as files arrive.

A document fails any of five filters, one letter each: A under 200 words; B 100 * distinct words < 50 * words; C 100 * ``[A-Z]``
> 3 * code points; D it holds one of ``#$%&*|``; E its text equals that of a document with a smaller id, in any part. A to D
follow from the text alone. E depends on all documents, so it is kept as a stream with retractions: files come as available-now
micro-batches, state keyed by the text holds the smallest id seen so far and where that document was counted, and when a smaller
id arrives, the earlier one's mask is taken back from its part's counters and counted again with E. What the sink keeps is
signed counts per (part, mask, good, toxic); their sum after any split into micro-batches is that of one batch.

Every task first combines its rows of one text: of all but its smallest id it is certain that they fail E, so a text that
fills a table reaches its state as few rows. State lives in the RocksDB store, under buckets of the text's digest; a lost
executor costs a reload from the checkpoint. A micro-batch that runs again replaces the counts it wrote before.

Texts are told apart by SHA-256 of their UTF-8. Defined results: null texts are empty ones (they fail A, and E against each
other); a null language and an empty one are the same part; rows of one id with one text are copies of each other and
none is smaller; a null id comes after all others and has no labels; of several labels of an id the highest counts; an
empty table gives no rows. Only ``doc_id``, ``text``, ``lang`` and the labels are read.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from orelayer.llm.scratch import Scratch
from orelayer.session import path_exists, written
from orelayer.streaming.changes import rocksdb_state

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
# Texts that a task holds while it combines rows; more of them only mean more rows for the state.
HELD = 50_000
NO_ID = (1 << 63) - 1
FIELDS = "bucket int, digest binary, first bigint, no_id boolean, part string, mask int, good int, toxic int, copies boolean, n bigint"
STATE_COLUMNS = ["digest", "first", "part", "mask", "good", "toxic", "copies", "n"]
# Maps of a bucket that are kept beside each other before they are merged.
VERSIONS = 8
DELTA = "part string, mask int, good int, toxic int, n bigint"


def fails(text: str | None) -> tuple[bytes, int]:
    """The digest of a text and the filters A to D that it fails."""
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.split()  # of bytes: at the six ASCII blanks alone
    count, points = len(words), len(text or "")
    upper = len(body) - len(body.translate(None, UPPER))
    return hashlib.sha256(body).digest(), (
        A * (count < 200)
        | B * (100 * len(set(words)) < 50 * count)
        | C * (100 * upper > 3 * points)
        | D * (len(body.translate(None, SYMBOLS)) < len(body))
    )


def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, text, part`` to ``doc_id, digest, mask, part``."""
    for batch in batches:
        found = [fails(t) for t in batch.column(1).to_pylist()]
        digests, bits = [d for d, _ in found], [m for _, m in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(bits, pa.int32()), batch.column(2)], ["doc_id", "digest", "mask", "part"]
        )


def combined(buckets: int):
    """Rows of one text in one task: those of its smallest id as they are, all others as copies."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple[int, int, Counter]] = {}  # digest: smallest id, mask, rows per (part, good, toxic)
        copies: Counter = Counter()  # rows per (part, mask, good, toxic) that surely fail E

        def out() -> pa.RecordBatch:
            rows = [
                (int.from_bytes(d[:4], "big") % buckets, d, i, i == NO_ID, part, m, good, toxic, False, n)
                for d, (i, m, held) in least.items()
                for (part, good, toxic), n in held.items()
            ]
            rows += [(k % buckets, b"", 0, False, *key, True, n) for k, (key, n) in enumerate(copies.items())]
            least.clear()
            copies.clear()
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for ident, digest, mask, part, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                ident = NO_ID if ident is None else ident
                known = least.get(digest)
                if known is None or ident < known[0]:
                    for (p, g, t), n in known[2].items() if known else ():
                        copies[p, mask, g, t] += n
                    least[digest] = (ident, mask, Counter({(part, good, toxic): 1}))
                elif ident == known[0]:
                    known[2][part, good, toxic] += 1
                else:
                    copies[part, mask, good, toxic] += 1
            if len(least) >= HELD:
                yield out()
        yield out()

    return combine


class SmallestIds(StatefulProcessor):
    """Per text the smallest id and the rows counted for it; gives signed counts, which retract a row that proves a copy.

    A key is a bucket of texts. Its state is a list of maps from digest to entry, one for every micro-batch that changed it; later
    maps win, and when there are several, they are merged into one. So a micro-batch costs one read and one append a bucket.
    """

    def init(self, handle) -> None:
        self.maps = handle.getListState("maps", "entries binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        delta: Counter = Counter()
        arrived: dict[bytes, list] = {}
        for frame in rows:
            for digest, first, part, mask, good, toxic, copies, n in zip(*(frame[c].tolist() for c in STATE_COLUMNS)):
                if copies:
                    delta[part, mask | E, good, toxic] += n
                else:
                    arrived.setdefault(bytes(digest), []).append((first, mask, part, good, toxic, n))
        known: dict[bytes, tuple] = {}
        versions = 0
        for (entries,) in self.maps.get():
            known.update(pickle.loads(entries))
            versions += 1
        changes = {digest: entry for digest, new in arrived.items() if (entry := met(known.get(digest), new, delta))}
        if changes and versions >= VERSIONS:
            self.maps.put([(pickle.dumps(known | changes),)])
        elif changes:
            self.maps.appendValue((pickle.dumps(changes),))
        if signed := [(*k, n) for k, n in delta.items() if n]:
            yield pd.DataFrame(signed, columns=["part", "mask", "good", "toxic", "n"])

    def close(self) -> None:
        pass


def met(known: tuple | None, arrived: list[tuple], delta: Counter) -> tuple | None:
    """Count the rows that arrived of one text; the text's new entry, if it changed: its smallest id, its mask, rows by (part, good, toxic)."""
    least, held = (known[0], dict(known[2])) if known else (None, {})
    changed = False
    for ident, mask, part, good, toxic, n in sorted(arrived):
        if least is not None and ident > least:
            delta[part, mask | E, good, toxic] += n
            continue
        if least is not None and ident < least:
            for (p, g, t), m in held.items():
                delta[p, mask, g, t] -= m
                delta[p, mask | E, g, t] += m
            held = {}
        least, changed = ident, True
        held[part, good, toxic] = held.get((part, good, toxic), 0) + n
        delta[part, mask, good, toxic] += n
    return (least, arrived[0][1], held) if changed else None


def marked(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Documents as the rows that the state takes."""
    body = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    kind = body.schema["doc_id"].dataType.simpleString()
    found = body.mapInArrow(masks, f"doc_id {kind}, digest binary, mask int, part string")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max((F.coalesce(c, F.lit(0)) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    told = found.join(known, "doc_id", "left").select(
        F.col("doc_id").cast("bigint"), "digest", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    return told.mapInArrow(combined(buckets), FIELDS)


def bucket_count(spark: SparkSession, path: str, root: str) -> int:
    """Buckets of texts: at least 512, one for every 64 MB of files when the stream in ``root`` began, and the same ever since."""
    note = f"{root}/buckets"
    if path_exists(spark, note):
        return int(spark.read.text(note).first()[0])
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    buckets = max(512, size >> 26)
    spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.text(note)
    return buckets


def count_masks(spark: SparkSession, docs: DataFrame, labels: DataFrame, root: str, buckets: int) -> DataFrame:
    """Run the stream ``docs`` to its end and return counts per (part, mask, good, toxic).

    ``root`` holds the checkpoint and the signed counts of every micro-batch: a later call with more files goes on from there.
    """
    with rocksdb_state(spark):
        rows = marked(docs, labels, buckets)
        signed = rows.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=SmallestIds(), outputStructType=DELTA, outputMode="append", timeMode="none"
        )

        def keep(batch: DataFrame, epoch: int) -> None:
            totals = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
            totals.write.mode("overwrite").parquet(f"{root}/counts/epoch={epoch}")

        signed.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not path_exists(spark, f"{root}/counts"):
        return spark.createDataFrame([], DELTA)
    every = spark.read.schema(DELTA).option("recursiveFileLookup", "true").parquet(f"{root}/counts")
    return every.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """Per part, order of filters and step: what the step's filter does there. ``counts`` are few rows: parts x masks x labels."""
    steps = [
        {"filter_order": "".join(order), "step": step + 1, "own": 1 << FILTERS.index(order[step]), "before": sum(1 << FILTERS.index(x) for x in order[:step])}
        for order in permutations(FILTERS)
        for step in range(5)
    ]
    # One literal for the 600 steps: a column for each value would take seconds to plan.
    orders = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    rows = counts.select("*", F.explode(orders).alias("o")).select("part", "mask", "good", "toxic", "n", "o.*")
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    failing, left = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) == 0
    gone = failing & left
    # In 1 of bit_count(mask) orders a filter comes first of all that a document fails.
    share = (F.lit(120) / F.greatest(F.bit_count(mask), F.lit(1))).cast("bigint")

    def total(condition, value=F.col("n")):
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~failing & left).alias("kept"),
        total(gone).alias("removed"),
        total(failing & ~left).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(gone & (F.col("good") == 1)).alias("good_lost"),
        total(gone & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(failing, F.col("n") * share).alias("shapley"),
    )


def audit_filters(
    spark: SparkSession, path: str, labels: DataFrame, *, batch_bytes: int | None = None, root: str | None = None
) -> DataFrame:
    """The audit of the parquet file or files at ``path``, in micro-batches of about ``batch_bytes``: by default 64 MB for every
    core of the cluster. ``root`` is the stream's own folder; without it the stream is new, reads every file and leaves nothing behind.
    """
    schema = spark.read.parquet(path).select("doc_id", "text", "lang").schema
    scratch = Scratch(spark, "filter-audit")
    root = root or scratch.root
    buckets = bucket_count(spark, path, root)
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes or spark.sparkContext.defaultParallelism << 26)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # A stream is over a folder; a single file is the one of its name there.
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    arriving = reader.parquet(path)
    counts = written(count_masks(spark, arriving, labels, root, buckets), "filter-audit-counts")
    scratch.drop()
    return audit(counts)
