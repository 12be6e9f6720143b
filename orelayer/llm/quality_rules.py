"""Quality rules: plain limits, then robust multivariate outliers per language and source. DataFrame functions only.

Documents that pass the plain limits become a vector of five transformed statistics (length, mean word length, density of
symbols, share of repeated lines, share of repeated words). For each language and source the minimum covariance
determinant is sought by concentration steps: start from medians and quartile ranges, then again and again take the share
of documents that lie nearest by Mahalanobis distance and estimate mean and covariance from them. The last estimate is
weighted once more (all documents within the 97.5 % distance) and documents beyond the ``cutoff`` are rejected.

At scale: vectors are integers, so their sums do not depend on the order of rows; a step is two aggregates with partial
sums, and the distance that bounds a step's subset is read from a histogram of at most a few thousand bins per group, so
no task ever sorts or collects a group. Documents (without their text) are written once and read by every step.
Groups of fewer than ``min_group`` documents are pooled by language, and those of small languages together.

Defined results: null or empty text has no words and fails the plain limits; null language or source is a group like
others; rows keep their id, null or repeated; a floor under every pivot of the covariance lets a group of equal documents pass whole; an
empty table gives no rows. Only id, text, language and source are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelayer.llm.text import SPACE_CHARS, words
from orelayer.session import written

DIM = 5
# Quantiles of the chi-square distribution with 5 degrees of freedom.
CHI_MEDIAN, CHI_975, CHI_9999 = 4.351, 12.833, 25.745
SYMBOLS = "#*$%&|<>"
SCALE = 1000
BINS = 32
BROADCAST_GROUPS = 20_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    subset: float = 0.75
    steps: int = 4
    min_group: int = 100
    cutoff: float = CHI_9999
    # The least standard deviation of each statistic, in its own unit: a tenth of the range for the three shares, a twentieth of
    # the range from 50 to 100,000 words and of that from 1 to 11 characters. The cutoff is about five of them.
    floors: tuple[float, ...] = (0.38, 0.5, 0.69, 0.46, 0.05)


def _covered(w: str) -> str:
    """SQL: how many words of array ``w`` lie in a window of three words that is found twice or more.

    ``g`` holds a hash per window. Hash and position are packed into one bigint, so that sorting brings equal windows
    together; as many low bits hold the position as the number of words needs. The whole hashes are compared after that.
    """
    return f"""
    CASE WHEN size({w}) < 3 OR size(array_distinct(g)) = size(g) THEN 0L ELSE
      aggregate(
        sort_array(transform(
          filter(packed, (x, j) ->
            coalesce(shiftrightunsigned(x, b) = shiftrightunsigned(get(packed, j - 1), b)
              AND get(g, cast(x & mask AS int)) = get(g, cast(get(packed, j - 1) & mask AS int)), false)
            OR coalesce(shiftrightunsigned(x, b) = shiftrightunsigned(get(packed, j + 1), b)
              AND get(g, cast(x & mask AS int)) = get(g, cast(get(packed, j + 1) & mask AS int)), false)),
          x -> x & mask)),
        struct(0L AS n, 0L AS upto),
        (a, x) -> struct(a.n + x + 3 - greatest(a.upto, x) AS n, x + 3 AS upto),
        a -> a.n)
    END"""


def statistics(docs: DataFrame, ident: str, text: str, keep: dict[str, Column]) -> DataFrame:
    """``id``, the columns of ``keep`` and the counts of words, word characters, symbols, lines and repeats."""
    body = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    counted = docs.select(
        docs[ident].alias("id"),
        *[value.alias(name) for name, value in keep.items()],
        F.length(F.translate(body, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        words(docs[text]).alias("w"),
    )
    counted = counted.withColumns(
        {
            "n_words": F.size("w").cast("bigint"),
            "n_lines": F.size("lines").cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "b": F.length(F.bin(F.size("w"))),
            "g": F.expr("IF(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))"),
        }
    )
    counted = counted.withColumns(
        {
            "mask": F.expr("shiftleft(1L, b) - 1"),
            "packed": F.expr("sort_array(transform(g, (h, i) -> shiftleft(shiftrightunsigned(h, b), b) | i))"),
        }
    )
    return counted.withColumn("n_repeat_words", F.expr(_covered("w"))).drop("w", "lines", "g", "packed", "b", "mask")


def _vector() -> list[Column]:
    """The transformed statistics in thousandths, as bigint."""
    c = F.col
    values = [
        F.log1p(c("n_words")),
        c("word_chars") / c("n_words"),
        F.log1p(1000 * c("n_symbols") / c("word_chars")),
        F.log1p(100 * c("n_dup_lines") / c("n_lines")),
        c("n_repeat_words") / c("n_words"),
    ]
    return [F.when(~c("base_failed"), F.round(v * SCALE).cast("bigint")).alias(f"z{i}") for i, v in enumerate(values)]


def _joined(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if few else groups, "group")


def _factor(moments: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Means and the Cholesky factor of the covariance, with a floor under each pivot, as columns."""
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in range(DIM)}
    found = moments.withColumns(mean)
    cov = {
        f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")
        for i, j in pairs
    }
    found = found.withColumns(cov)
    for i, j in pairs:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        found = found.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return found.select("group", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i, j in pairs])


def _distance(rows: DataFrame) -> DataFrame:
    """``d2``: the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIM):
        rest = F.col(f"z{i}") / SCALE - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(DIM):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn("d2", total)


def _start(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Medians and quartile ranges as the first means and a diagonal factor."""
    found = rows.groupBy("group").agg(
        *[F.percentile_approx(f"z{i}", [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i in range(DIM)]
    )
    zero = F.lit(0.0)
    return found.select(
        "group",
        *[(F.col(f"q{i}")[1] / SCALE).alias(f"m{i}") for i in range(DIM)],
        *[
            (F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 / SCALE, F.lit(floors[i])) if i == j else zero).alias(f"l{i}{j}")
            for i in range(DIM)
            for j in range(i + 1)
        ],
    )


def _bounds(measured: DataFrame, share: float) -> DataFrame:
    """Per group the histogram bin within which ``share`` of its documents lie, and the bin of the median."""
    bins = measured.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("group").orderBy("bin")
    run = bins.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("group"))})
    reached = lambda part: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * part), F.col("bin")))
    return run.groupBy("group").agg(reached(share).alias("bound"), reached(0.5).alias("middle"))


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(DIM)]
    products = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _binned(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    near = _distance(_joined(rows, groups, few))
    return near.select("group", *[f"z{i}" for i in range(DIM)], "d2", F.floor(BINS * F.log2(1 + F.col("d2"))).cast("int").alias("bin"))


def _scale() -> Column:
    """What brings the median distance to that of the chi-square distribution; 1 at least, so floors are not undone."""
    return F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("middle") + 1) / BINS) - 1) / CHI_MEDIAN)


def robust_estimates(rows: DataFrame, rules: Rules) -> tuple[DataFrame, bool]:
    """Means, factors and ``scale`` per group; whether the groups are few enough to broadcast."""
    groups = written(_start(rows, rules.floors), "mcd-start")
    few = groups.count() <= BROADCAST_GROUPS
    for step in range(rules.steps):
        near = _binned(rows, groups, few)
        bounds = _bounds(near, rules.subset)
        inner = _joined(near, bounds, few).where(F.col("bin") <= F.col("bound"))
        groups = written(_factor(_moments(inner), rules.floors), f"mcd-step-{step}")
    near = _binned(rows, groups, few)
    bounds = _bounds(near, rules.subset)
    inner = _joined(near, bounds, few).where(F.col("d2") <= CHI_975 * _scale())
    groups = written(_factor(_moments(inner), rules.floors), "mcd-weighted")
    scales = _bounds(_binned(rows, groups, few), rules.subset).select("group", _scale().alias("scale"))
    return written(groups.join(scales, "group"), "mcd"), few


def _grouped(rows: DataFrame, rules: Rules) -> DataFrame:
    """``group``: language and source, or the pooled language, or the pooled rest."""
    name = lambda *parts: F.to_json(F.array(*[F.coalesce(p, F.lit("\0")) for p in parts]))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= rules.min_group
    pooled = F.sum(F.when(~large, F.col("n"))).over(Window.partitionBy("lang"))
    group = (
        F.when(large, name(F.col("lang"), F.col("source")))
        .when(pooled >= rules.min_group, name(F.col("lang")))
        .otherwise(F.lit("[]"))
    )
    sizes = sizes.select(F.col("lang").alias("l"), F.col("source").alias("s"), group.alias("group"))
    same = rows["lang"].eqNullSafe(sizes["l"]) & rows["source"].eqNullSafe(sizes["s"])
    return rows.join(sizes, same).drop("l", "s")


def apply_rules(
    docs: DataFrame, rules: Rules = Rules(), ident: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Every document with its counts, ``base_failed``, ``distance`` (null: not measured) and ``kept``."""
    counted = statistics(docs, ident, text, {"lang": docs[lang].cast("string"), "source": docs[source].cast("string")})
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rows = written(counted.withColumn("base_failed", failed).withColumns({c: v for c, v in zip([f"z{i}" for i in range(DIM)], _vector())}), "rule-counts")
    shown = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    vectors = [f"z{i}" for i in range(DIM)]
    passed = written(_grouped(rows.where(~F.col("base_failed")).select(*shown, *vectors, "lang", "source"), rules), "rule-groups")
    groups, few = robust_estimates(passed.select("group", *vectors), rules)
    judged = _distance(_joined(passed, groups, few)).select(*shown, (F.col("d2") / F.col("scale")).alias("distance"))
    others = rows.where(F.col("base_failed")).select(*shown, F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(others).select(
        F.col("id").alias(ident),
        *shown[1:],
        "distance",
        F.coalesce(F.col("distance") <= rules.cutoff, F.lit(False)).alias("kept"),
    )
