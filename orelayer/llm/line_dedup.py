"""Line deduplication that moves hashes and bitmaps, not text. DataFrame functions only.

Lines are hashed, the hashes are dealt by range and sorted by document and position within a hash, and the first
occurrence in each document is found while the sorted rows stream by. Documents get back a bitmap of the lines
they keep: 64 lines to a bigint, whole words of kept lines at the end left out.

Defined results: a null or empty text is one empty line; a null id counts as one document that sorts before all
others; rows with the same id are one document, so their lines never make each other repeats; rows that agree in id
and text get the same answer; an empty table gives no rows. Only the id and the text are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelayer.llm.scratch import Scratch
from orelayer.llm.text import SPACE_CHARS, fold_case
from orelayer.session import written

FIRST_ID = -(2**63)
# A key is dealt by document into so many parts, so that a line of every third document never meets in one task.
PARTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return fold_case(F.btrim(line, F.lit(SPACE_CHARS)))


def _ident(docs: DataFrame, ident: str, text: str) -> list[Column]:
    """What tells a row: its id and a digest of its text."""
    return [
        F.coalesce(docs[ident], F.lit(FIRST_ID)).alias("doc"),
        F.xxhash64(docs[text]).alias("row"),
    ]


def line_hashes(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points: 128 bits of hash, document, row, position."""
    lines = docs.select(*_ident(docs, ident, text), F.posexplode(F.transform(_lines(docs[text]), _key)).alias("pos", "key"))
    return lines.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "row", "pos"
    )


def dropped_lines(hashes: DataFrame, min_docs: int = 3, parts: int = PARTS) -> DataFrame:
    """The positions to drop: keys of at least ``min_docs`` documents, except in the largest document that has them."""
    key = ["h1", "h2", "part"]
    dealt = hashes.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int"))
    streamed = dealt.select(*key, "doc", "pos").repartitionByRange(*key).sortWithinPartitions(*key, "doc", "pos")
    before = F.lag("doc").over(Window.partitionBy(*key).orderBy("doc", "pos"))
    firsts = streamed.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("doc")))
    groups = firsts.groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))
    whole = Window.partitionBy("h1", "h2")
    repeated = (
        groups.withColumn("docs", F.sum("docs").over(whole))
        .withColumn("last", F.max("last").over(whole))
        .where(F.col("docs") >= min_docs)
        .select(*key, "last")
    )
    return dealt.join(repeated, key).where(F.col("doc") != F.col("last")).select("doc", "row", "pos")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """Per row the bitmap of kept lines: bit ``pos % 64`` of word ``pos div 64`` is 1 where the line stays."""
    word, bit = F.expr("cast(pos div 64 as int)"), F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc", "row", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    sparse = words.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("sparse"))
    dense = F.aggregate(
        "sparse",
        F.array().cast("array<bigint>"),
        lambda found, one: F.concat(
            found, F.array_repeat(F.lit(-1).cast("bigint"), one["word"] - F.size(found)), F.array(F.bitwise_not(one["bits"]))
        ),
    )
    return sparse.select("doc", "row", dense.alias("keep"))


def keep_bitmaps(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Bitmaps of the rows that lose a line, by ``doc`` and ``row``; rows that keep all lines have none.

    The line hashes are written to the shared folder, as they are read twice and a lost executor then costs a re-read;
    they go when the bitmaps are written.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    hashes = scratch.write(line_hashes(docs, ident, text, min_chars), "line-hashes")
    found = written(bitmaps(dropped_lines(hashes, min_docs)), "keep-bitmaps")
    scratch.drop()
    return found


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, joined again."""
    stays = F.filter(
        _lines(text),
        lambda line, i: F.coalesce(F.getbit(F.get(keep, F.floor(i / 64).cast("int")), i % 64), F.lit(1)) == 1,
    )
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n"))


def dedup_lines(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """Every row with its line count, its bitmap (null: all lines stay) and the text that stays.

    Returns ``ident``, ``n_lines``, ``n_dropped``, ``keep`` and ``kept``, and ``original`` (the input row as a struct).
    """
    found = keep_bitmaps(docs, ident, text, min_chars, min_docs)
    rows = docs.select(*_ident(docs, ident, text), F.struct(*[docs[c] for c in docs.columns]).alias("original"))
    body = F.coalesce(F.col(f"original.`{text}`"), F.lit(""))
    n_lines = F.length(body) - F.length(F.translate(body, "\n", "")) + 1
    n_dropped = F.aggregate("keep", F.lit(0), lambda n, word: n + 64 - F.bit_count(word))
    return rows.join(found.hint("shuffle_hash"), ["doc", "row"], "left").select(
        F.col(f"original.`{ident}`").alias(ident),
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("bigint").alias("n_dropped"),
        "keep",
        kept_text(body, F.col("keep")).alias("kept"),
        "original",
    )


def without_repeated_lines(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", chars: str = "n_chars", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that stays; ``chars``, if there, is its new length.

    A null text stays null; a document that loses every line stays as an empty text.
    """
    found = dedup_lines(docs, ident, text, min_chars, min_docs).withColumn("before", F.col(f"original.`{text}`"))
    changed = F.col("keep").isNotNull()
    values = {
        text: F.when(changed, F.col("kept")).otherwise(F.col("before")),
        chars: F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col(f"original.`{chars}`")) if chars in docs.columns else None,
    }
    return found.select(*[(F.col(f"original.`{c}`") if values.get(c) is None else values[c]).alias(c) for c in docs.columns])
