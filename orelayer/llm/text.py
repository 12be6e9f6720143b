"""What the text operators share: input columns, words, folds, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a character class and as the characters themselves.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as bigint; null counts as no text. Words are the runs between single blanks once white space is folded."""
    blank = F.btrim(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS)))
    return F.when(blank == "", F.lit(0)).otherwise(F.regexp_count(blank, F.lit(" +")) + 1).cast("bigint")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(ident: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % folds == 0
