"""Boosted quality scores, HAT-trie phrases and the filter audit against plain Python on odd rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelayer.llm import boosted_quality, filter_audit, hat_trie, phrases
from orelayer.llm.hashing import mixed
from tests.llm.rows import FOLD, frame, held_out, odd_documents

# ---------------------------------------------------------------- trie


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_trie_counts_what_a_counter_counts(width):
    """Tiny limits, so that containers burst at every level and subtrees leave many times; every run is sorted and survives its bytes."""
    rng = np.random.default_rng(width)
    ids = mixed(np.arange(1, 300, dtype=np.uint64))
    trie, want, got, runs = hat_trie.HatTrie(width, budget=1500, limit=60), Counter(), Counter(), 0
    for _ in range(12):
        keys = ids[np.minimum(rng.geometric(0.03, size=(900, width)), 298)]
        want.update(map(tuple, keys.tolist()))
        for run in trie.add(keys):
            runs += 1
            found, counts = hat_trie.decoded(hat_trie.encoded(*run))
            assert [tuple(r) for r in found.tolist()] == sorted(map(tuple, found.tolist()))
            got.update(dict(zip(map(tuple, found.tolist()), counts.tolist())))
    for found, counts in trie.spill():
        got.update(dict(zip(map(tuple, found.tolist()), counts.tolist())))
    assert got == want and (runs > 3 or width == 1)


def test_one_busy_first_id_bursts_into_a_node():
    ids = mixed(np.arange(1, 5000, dtype=np.uint64))
    keys = np.column_stack([np.full(4999, ids[7]), ids])
    trie = hat_trie.HatTrie(2, limit=100)
    assert list(trie.add(keys)) == []
    assert any(isinstance(c, hat_trie.Node) for c in trie.root.children)
    assert sum(len(k) for k, _ in trie.spill()) == 4999


# ---------------------------------------------------------------- phrases


def plain_collocations(rows, least, top, contained=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    known = {p: n for p, n in counts.items() if n >= least}
    out = []
    for (lang, *words), a in known.items():
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = known[(lang, *words[:k])], known[(lang, *words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(
            p[0] == lang and len(p) > len(words) + 1 and 100 * n >= contained * a and any(list(p[i : i + len(words)]) == words for i in range(1, len(p) - len(words) + 1))
            for p, n in known.items()
        )
        if not inside:
            out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    found = []
    for lang in totals:
        ranked = sorted(r for r in out if r[0] == lang)[:top]
        found += [(lang, i + 1, r[3].decode(), -r[2], r[4], r[5], totals[lang], -r[1]) for i, r in enumerate(ranked)]
    return sorted(found)


def phrase_rows():
    rng = random.Random(5)
    words = ["a", "b", "C", "dé", "e", "ff", "ü,", "g.", "h"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    rows += [("x y z " * 400, "en"), ("solo" * 700, "en"), (None, "en"), ("", None), (" \t\n.", "de"), ("las " * 900, None), ("one\ttwo  three\x0bfour\x1cfive " * 50, "de")]
    return [*rows, rows[-3], rows[0]]


@pytest.mark.parametrize("settings", [{}, {"block": 97, "budget": 300, "limit": 20, "top": 15}, {"filter_bits": 16, "contained": 101}])
def test_phrases_match_plain_counts(spark, settings):
    """Whole, in tiny parts with spills, and without containment; a long text is worked on in parts of 97 characters."""
    settings = phrases.Settings(**{"least": 12, **settings})
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, x, 1, "y") for t, x in rows], "text string, lang string, n int, word string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(docs, settings).collect())
    assert got == plain_collocations(rows, 12, settings.top, settings.contained) and got


def test_sequences_cross_the_border_of_parts():
    rows = [("a b c d e f g h i j, k l m n o p", "en")]
    whole, cut = Counter(), Counter()
    for block, into in ((1000, whole), (3, cut)):
        for words, _ in phrases.blocks(rows, phrases.Settings(block=block), 0):
            for k in range(1, 5):
                into.update(map(tuple, words.sequences(k, []).tolist()))
    assert whole == cut and sum(whole.values()) == 16 + 14 + 12 + 10


def test_same_ids_for_two_words_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_signed", lambda values: phrases.pa.array(np.ascontiguousarray(values).view(np.int64) & 7))
    docs = spark.createDataFrame([("a b c d e f g h i j k l m n o p q", "en")], "text string, lang string")
    assert not phrases.count_words(docs, phrases.Settings(), 0).where("clash").isEmpty()


def test_no_documents_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


# ---------------------------------------------------------------- filter audit


def plain_audit(rows, labels):
    """Every order applied literally to every document."""
    good, toxic = {}, {}
    for i, q, t in labels:
        good[i], toxic[i] = max(good.get(i, 0), int(q == 1)), max(toxic.get(i, 0), int(t == 1))
    smallest = {}
    key = lambda i: (i is None, i or 0)
    for i, text, _, _ in rows:
        smallest[text or ""] = min(smallest.get(text or "", (True, 1)), key(i))
    docs = []
    for i, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if key(i) > smallest[text] else set()
        docs.append((lang or "", fails, good.get(i, 0) if i is not None else 0, toxic.get(i, 0) if i is not None else 0))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone, left = [d for d in left if letter in d[1]], [d for d in left if letter not in d[1]]
                failing = [d for d in own if letter in d[1]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone), sum(d[1] == {letter} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)
                )
                shapley[part, letter] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.fixture(scope="module")
def audited_rows():
    rng = random.Random(8)
    rows = odd_documents()
    rows += [(1000 - i, rows[i % 30][1], rng.choice(["en", "fr", None]), "a") for i in range(80)]  # copies whose ids fall
    rows += [(-5, rows[3][1], "en", "a"), (-5, rows[3][1], "de", "a"), (2000, "A#" * 40, "", "a"), (2001, "w%d " * 300 % tuple(range(300)), "en", "a")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 1001, 3)] + [(6, None, 1), (None, 1, 1), (-5, 1, 0), (-5, 0, 1)]
    return rows, labels


@pytest.mark.parametrize("files, falling", [(1, False), (6, False), (6, True)])
def test_audit_does_not_depend_on_arrival(spark, tmp_path, audited_rows, files, falling):
    """All rows in one micro-batch, in several, and with falling ids, so that earlier masks are taken back."""
    rows, labels = audited_rows
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=falling) if files > 1 else rows
    size = -(-len(ordered) // files)
    for n in range(files):
        frame(spark, ordered[n * size : (n + 1) * size]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit_filters(spark, f"{tmp_path}/documents.parquet", told, batch_bytes=1)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == plain_audit(rows, labels)


def test_audit_goes_on_where_it_stopped(spark, tmp_path, audited_rows):
    """Files that come later change the counts of earlier ones; state and buckets come from the stream's folder."""
    rows, labels = audited_rows
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    path, root = f"{tmp_path}/documents.parquet", f"{tmp_path}/stream"
    later = [r for r in rows if r[0] is not None and r[0] < 30]
    early = [r for r in rows if r not in later]
    frame(spark, early).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    for part in (None, later):
        if part:
            frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        buckets = filter_audit.bucket_count(spark, path, root)
        arriving = spark.readStream.schema(docs.schema).parquet(path)
        counts = filter_audit.count_masks(spark, arriving, told, root, buckets)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(counts).collect()}
    assert got == plain_audit(rows, labels)


def test_a_merged_state_is_the_same(monkeypatch):
    """More maps than are kept beside each other: the state of a bucket becomes one map again."""
    monkeypatch.setattr(filter_audit, "VERSIONS", 2)

    class Maps:
        def __init__(self):
            self.held = []

        def get(self):
            return iter(self.held)

        def appendValue(self, value):
            self.held = [*self.held, value]

        def put(self, values):
            self.held = values

    state = filter_audit.SmallestIds()
    state.maps = Maps()
    rng, total, lengths = random.Random(1), Counter(), []
    rows = [(bytes([rng.randrange(5)]) * 32, rng.randrange(400)) for _ in range(60)]
    for low in range(0, 60, 6):
        columns = {"digest": [], "first": [], "part": [], "mask": [], "good": [], "toxic": [], "copies": [], "n": []}
        for digest, ident in rows[low : low + 6]:
            for name, value in zip(columns, (digest, ident, "en", digest[0], 0, 0, False, 1)):
                columns[name].append(value)
        for out in state.handleInputRows((0,), iter([filter_audit.pd.DataFrame(columns)]), None):
            for r in out.itertuples():
                total[r.mask] += r.n
        lengths.append(len(state.maps.held))
    least = {d: min(i for e, i in rows if e == d) for d, _ in rows}
    want = Counter(d[0] | (filter_audit.E if i > least[d] else 0) for d, i in rows)
    assert +total == want and max(lengths) <= 3 and lengths.count(1) > 1


def test_audit_of_an_empty_table(spark, tmp_path):
    frame(spark, odd_documents()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    told = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(spark, f"{tmp_path}/documents.parquet", told).count() == 0


# ---------------------------------------------------------------- boosted trees


def test_flattened_trees_walk_like_nested_ones():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1500, 6)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = boosted_quality.train(x, y, boosted_quality.Settings(trees=25, depth=3, bins=16))
    got = boosted_quality.logits(x, forest)

    def walk(node, row):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.statistic[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    want = [forest.start + sum(walk(root, row) for root in forest.roots) for row in x[:200]]
    assert np.allclose(got[:200], want)
    assert ((got > 0) == (y == 1)).mean() > 0.97


def test_first_split_is_the_best_of_all():
    """A tree of one split against every cut of every statistic."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, size=(400, 4)).astype(float), rng.integers(0, 2, 400).astype(float)
    y[x[:, 2] > 5] = 1
    settings = boosted_quality.Settings(trees=1, depth=1)
    forest = boosted_quality.train(x, y, settings)
    share = y.mean()
    g, h = share - y, np.full(400, share * (1 - share))
    gains = {}
    for j in range(4):
        for cut in np.unique(x[:, j])[:-1] + 0.5:
            left = x[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) >= settings.least:
                gains[j, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + settings.penalty) for s in (left, ~left))
    assert (forest.statistic[0], forest.threshold[0]) == max(gains, key=gains.get)


def test_statistics_of_odd_texts():
    texts = [None, "", " \n", "a", "A B\nA B\n\nc!", "\ud800 x", "é" * 10, "word " * 5000]
    x = boosted_quality.statistics(texts)
    assert x.shape == (len(texts), len(boosted_quality.MEASURES)) and np.isfinite(x).all()
    of = dict(zip(boosted_quality.MEASURES, x[4]))
    assert of["distinct_words"] == 3 / 5 and of["top_word"] == 2 / 5 and of["repeated_lines"] == pytest.approx(1 / 3) and of["open_lines"] == pytest.approx(2 / 3)
    assert (boosted_quality.statistics([None]) == 0).all() and boosted_quality.statistics([]).shape[0] == 0


def test_quality_of_odd_documents(spark):
    rows = odd_documents()
    docs = frame(spark, rows)
    told = [(i, int(i % 3 > 0), 0) for i, *_ in rows if i is not None] + [(0, 1, 1), (None, 1, 0), (4, None, 0)]
    labels = spark.createDataFrame(told, "doc_id bigint, quality int, toxic int")
    x = boosted_quality.measured(docs)
    forest = boosted_quality.learn(x, labels, F.lit(True))
    found = boosted_quality.score(x, forest).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    one = boosted_quality.learn(x, labels.where("quality = 1"), F.lit(True))
    assert {r.predicted for r in boosted_quality.score(x, one).collect()} == {1}
    assert boosted_quality.score(boosted_quality.measured(docs.limit(0)), forest).count() == 0


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    x = boosted_quality.measured(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    forest = boosted_quality.learn(x, labels, ~out)
    rows = boosted_quality.score(x, forest).join(labels, "doc_id").collect()
    good = [r.score for r in rows if held_out(r.doc_id) and r.quality == 1]
    bad = [r.score for r in rows if held_out(r.doc_id) and r.quality == 0]
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([g > b for g in good for b in bad]) > 0.97
