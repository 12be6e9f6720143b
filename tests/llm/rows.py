"""Hand-made documents for the tests: nulls, empty and long texts, ties, repeats, and columns with clashing names."""

from __future__ import annotations

import random
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n int, size string, doc int, row int, keep string, start string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text, lang, source) with the other columns filled."""
    filled = [(*r, len(r[1]) if r[1] is not None else None, "x", 1, "y", 2, 3, "z", "w") for r in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(3)


def sentence(rng: random.Random, words: list[str], count: int) -> str:
    return " ".join(rng.choice(words) for _ in range(count))


def vocabulary(rng: random.Random, letters: str, count: int = 400) -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(count)]


ENGLISH, GERMAN = "etaoinshrdlu", "enisratdhulcgmüßäö"


def odd_documents(seed: int = 3, count: int = 60) -> list[tuple]:
    """Documents in two languages with copies, near copies, shared lines, and every odd case."""
    rng = random.Random(seed)
    words = {"en": vocabulary(rng, ENGLISH), "de": vocabulary(rng, GERMAN)}
    shared = [sentence(rng, words["en"], 9) for _ in range(4)]
    rows: list[tuple] = []
    for i in range(count):
        lang = rng.choice(["en", "de"])
        lines = [sentence(rng, words[lang], rng.randint(6, 40)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        rows.append((i, "\n".join(lines), lang, rng.choice(["a", "a", "a", "b", "c", None])))
    for i in range(count, count + 12):
        base = rng.choice(rows[:20])
        text = base[1].split(" ")
        if i % 3:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text), base[2], base[3]))
    at = count + 12
    rows += [
        (at, None, "en", "a"),
        (at + 1, "", "de", None),
        (at + 2, " \t\n\r ", None, "b"),
        (at + 3, "1234 5678 !!", "en", "b"),
        (at + 4, "short", "en", "c"),
        (at + 5, "las " * 3000, None, "a"),
        (at + 6, sentence(rng, words["en"], 30_000), "en", "b"),
        (None, sentence(rng, words["en"], 60), "en", "a"),
        (None, None, None, None),
        (at + 7, sentence(rng, words["de"], 80), "de", "c"),
    ]
    return [*rows, rows[-1], rows[5]]  # repeated rows


def held_out(ident: int | None) -> bool:
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % 5 == 0
