"""Language, toxicity, retrieval, similarity and passages against brute force and held-out rows."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelayer.llm import components, decontaminate, grams, hashing, jaccard, language, substring, toxicity
from orelayer.llm.queries import QUERIES
from orelayer.llm.scratch import Scratch
from orelayer.llm.text import held_out, table
from tests.llm.rows import ENGLISH, FOLD, GERMAN, WORD, frame, odd_documents, sentence, vocabulary
from tests.llm.rows import held_out as plain_held_out


@pytest.fixture(scope="module")
def docs():
    return odd_documents()


def test_held_out_rows(spark):
    ids = [None, -1, 0, 1, 7, 10**12, *range(100, 160)]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", held_out(F.col("i"))).collect()
    assert Counter(map(tuple, got)) == Counter((i, plain_held_out(i)) for i in ids)


# Language


def test_languages_of_odd_documents(spark, docs):
    df = frame(spark, docs)
    languages = language.learn(df, ~held_out(df["doc_id"]))
    assert languages.names == ["de", "en"]
    got = language.identify(df, languages).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in docs)
    known = {r[0]: r for r in docs}
    for r in got:
        text = known[r.doc_id][1] if r.doc_id is not None else "a"
        if not text or not grams.has_letter(text):
            assert (r.lang_pred, r.score, r.shares) == ("und", 0.0, {})
        elif r.doc_id is not None and known[r.doc_id][2] and len(text) > 10:
            assert r.lang_pred == known[r.doc_id][2]
        assert 0.0 <= r.score <= 1.0


def test_a_mixture_has_two_languages_and_its_proportions(spark):
    rng = random.Random(8)
    en, de = vocabulary(rng, ENGLISH), vocabulary(rng, GERMAN)
    rows = [(i, sentence(rng, [en, de][i % 2], 200), ["en", "de"][i % 2], "a") for i in range(60)]
    df = frame(spark, rows)
    languages = language.learn(df, F.lit(True))
    mixed = frame(spark, [(1, sentence(rng, en, 300) + " " + sentence(rng, de, 100), None, "a"), (2, sentence(rng, en, 300), None, "a")])
    got = {r.doc_id: r for r in language.identify(mixed, languages).collect()}
    assert got[1].lang_pred == "en" and set(got[1].shares) == {"en", "de"}
    assert got[1].score == pytest.approx(0.75, abs=0.08)
    assert got[2].shares == {"en": pytest.approx(1.0)}
    kept = language.keep_identified(mixed, languages, least=0.9)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == mixed.columns


def test_a_text_in_three_languages_stays_and_one_without_letters_goes(spark):
    """No language has half of it, yet all of it is identified."""
    rng = random.Random(9)
    words = [vocabulary(rng, letters) for letters in ("etaoinshr", "uvwxyzkqj", "bcdfgmpüä")]
    rows = [(i, sentence(rng, words[i % 3], 200), "abc"[i % 3], "a") for i in range(90)]
    languages = language.learn(frame(spark, rows), F.lit(True))
    mixed = " ".join(sentence(rng, w, n) for w, n in zip(words, (160, 120, 120)))
    docs = frame(spark, [(1, mixed, None, "a"), (2, "12 34 !!", None, "a"), (3, None, None, "a"), (4, sentence(rng, words[0], 50), None, "a")])
    shares = {r.doc_id: r.shares for r in language.identify(docs, languages).collect()}[1]
    assert len(shares) == 3 and max(shares.values()) < 0.5
    assert sorted(r.doc_id for r in language.keep_identified(docs, languages).collect()) == [1, 4]


def test_a_long_text_is_judged_as_its_parts_together(spark, monkeypatch):
    rng = random.Random(8)
    en, de = vocabulary(rng, ENGLISH), vocabulary(rng, GERMAN)
    model = language.Languages(["de", "en"], np.random.default_rng(1).dirichlet(np.ones(1 << 15), 2).T, language.Settings())
    texts = [sentence(rng, en, 3000), "", sentence(rng, de, 10), None, sentence(rng, de, 4000)]
    whole = [(d.tolist(), b.tolist(), t.tolist()) for d, b, t in language._counted(texts, model.settings, 2)]
    monkeypatch.setattr(grams, "BLOCK", 500)
    monkeypatch.setattr(grams.cut, "__defaults__", (500,))
    parts = [(d.tolist(), b.tolist(), t.tolist()) for d, b, t in language._counted(texts, model.settings, 2)]
    assert whole == parts


def test_nothing_learned_is_unknown(spark, docs):
    df = frame(spark, docs)
    got = language.identify(df, language.learn(df, F.lit(False)))
    assert got.where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language.identify(df.limit(0), language.learn(df, F.lit(True))).count() == 0


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(2)
    chance, times = rng.random((50, 3)) + 1e-3, rng.integers(1, 5, 50).astype(float)
    mixtures = language._Mixtures(np.array([0, 20]), chance, times)
    reached = [mixtures.fit(np.full((2, 3), 1 / 3), rounds)[1] for rounds in range(6)]
    assert all((b >= a - 1e-9).all() for a, b in zip(reached, reached[1:]))
    share, _ = mixtures.fit(np.full((2, 3), 1 / 3), 5)
    assert share.sum(axis=1) == pytest.approx([1, 1])


def test_held_out_languages(spark, folder):
    got = QUERIES["op1_language_id"](spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
    assert got.count() == table(spark, folder, "documents").count()


# Toxicity


def toxic_rows(rng, count, bad, share=0.3):
    words = vocabulary(random.Random(1), "abcdefghijkl", 3000)
    rows, labels = [], []
    for i in range(count):
        text, toxic = sentence(rng, words, rng.randint(20, 150)).split(" "), rng.random() < share
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_misspellings_that_were_never_seen_are_toxic(spark):
    rng = random.Random(5)
    rows, labels = toxic_rows(rng, 400, ["worthless", "disgusting", "pathetic"])
    model = toxicity.train([r[1] for r in rows], np.array([t for _, t in labels]))
    fresh, truth = toxic_rows(rng, 100, ["worthlesss", "disgusting!!", "patheticc", "xworthless"])
    got = {r.doc_id: r for r in toxicity.score(frame(spark, fresh), model).collect()}
    right = [got[i].predicted == t for i, t in truth]
    assert np.mean(right) >= 0.95
    assert all(0.0 <= r.score <= 1.0 for r in got.values())


def test_toxicity_of_odd_documents(spark, docs):
    rows, labels = toxic_rows(random.Random(6), 200, ["worthless", "disgusting"])
    learned = toxicity.learn(
        frame(spark, rows),
        spark.createDataFrame([*labels, (5, 0), (None, 1), (7, None)], "doc_id bigint, toxic int"),
        ~held_out(F.col("doc_id")),
        toxicity.Settings(sample=60),
    )
    df = frame(spark, docs)
    got = toxicity.score(df, learned).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in docs)
    empty = {r.score for r in got if r.doc_id in {72, 73, 74}}
    assert len(empty) == 1 and all(0.0 <= r.score <= 1.0 for r in got)
    assert toxicity.score(df.limit(0), learned).count() == 0
    again = toxicity.score(df.repartition(5), learned).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in got} == {(r.doc_id, round(r.score, 9)) for r in again}


def test_one_label_alone_is_its_share(spark, docs):
    model = toxicity.train(["a b", "c"], np.array([0, 0]))
    assert toxicity.score(frame(spark, docs), model).where("predicted <> 0").count() == 0
    none = toxicity.learn(frame(spark, docs).limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True))
    assert toxicity.score(frame(spark, docs), none).where("predicted <> 0").count() == 0


# Decontamination


def plain_scores(index, words):
    """BM25 of a passage against every item, term by term."""
    terms = set(index.lookup(words)[1].tolist())
    scores = defaultdict(float)
    for t in terms:
        for at in range(index.starts[t], index.starts[t + 1]):
            scores[int(index.owner[at])] += float(index.impact[at])
    return terms, scores


@pytest.mark.parametrize("block", [1, 3, 8])
def test_block_max_wand_equals_scoring_every_item(block):
    rng = random.Random(block)
    words = vocabulary(rng, "abcde", 120)
    items = decontaminate.parse_items([(i, f"{sentence(rng, words, rng.randint(1, 25))}. {sentence(rng, words, rng.randint(1, 9))}.") for i in range(90)], 3)
    for threshold in (0.2, 0.5, 0.8):
        index = decontaminate.Index(decontaminate.Test(threshold=threshold, block=block), items)
        for i in range(60):
            body = sentence(rng, words, 20) + " " + (" ".join(["x"]) if i % 2 else " ".join(sentence(rng, words, 5).split(" ")))
            passage = np.concatenate([next(decontaminate._words([body])), rng.choice(items).words])[: index.passage]
            terms, scores = plain_scores(index, passage)
            want = {i: s for i, s in scores.items() if s >= threshold}
            got = dict(index.retrieve(sorted(terms)))
            assert got.keys() == want.keys()
            assert all(got[i] == pytest.approx(want[i]) for i in want)
            at, term = index.lookup(passage)
            if want:
                assert index.candidates(np.zeros(len(at), np.int64), term).tolist() == [0]


def test_planted_items_are_found_and_nothing_else(spark):
    rng = random.Random(12)
    words = vocabulary(rng, ENGLISH, 900)
    items = [(i, f"{sentence(rng, words, rng.randint(8, 30)).capitalize()}. {sentence(rng, words, rng.randint(1, 8))}.") for i in range(30)]
    items += [(90, None), (91, ""), (92, "??"), (3, items[3][1])]
    rows, want = [], Counter()
    for i in range(80):
        text = sentence(rng, words, rng.randint(0, 400)).split(" ")
        if i % 4 == 0:
            item, body = rng.choice(items[:30])
            body = body.upper() if i % 8 else body.replace(".", " !,")
            text.insert(rng.randrange(len(text) + 1), body)
            want[i, item] += 2 if item == 3 else 1
        if i % 4 == 1:  # a question without its answer is not an item
            text.insert(0, items[i % 30][1].split(". ")[0])
        rows.append((i, " ".join(text), "en", "a"))
    rows += [(200, None, None, None), (201, "", "en", "a"), (None, items[5][1], "en", "a"), (202, items[6][1], "en", "a"), (202, items[6][1], "en", "a")]
    want.update([(None, 5), (202, 6), (202, 6)])
    df, tests = frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (5_000, 7):
        test = decontaminate.Test(items=size, words_at_once=3000)
        got = decontaminate.find_items(df, tests, test)
        assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
        kept = decontaminate.without_items(df, tests, test)
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if not any(d == r[0] for d, _ in want))
    assert decontaminate.find_items(df.limit(0), tests).count() == 0
    assert decontaminate.find_items(df, tests.limit(0)).count() == 0


def test_items_in_the_given_documents(spark, folder):
    docs, items = table(spark, folder, "documents").toPandas(), table(spark, folder, "benchmark").toPandas()
    want = {(d, i) for d, text in zip(docs.doc_id, docs.text) for i, item in zip(items.item_id, items.text) if item in (text or "")}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, folder).collect()}
    assert got >= want and len(got - want) <= 0.02 * len(docs)


# Hashes, components, similarity


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "A a\tb\x0bé  \r\n", *[" ".join("".join(rng.choice("abé\U0001f600 \n\x1c") for _ in range(9)) for _ in range(50)) for _ in range(60)]]
    seen = {}
    for text, hashes in zip(texts, hashing.hashed_words(texts, hashing.blanks())):
        words = WORD.findall((text or "").translate(FOLD))
        assert len(words) == len(hashes)
        for word, value in zip(words, hashes.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, ["aa", "bb", "c" * 50], 300), "x" * 700, "a b"]
    whole = [h.tolist() for h in hashing.hashed_words(texts, hashing.blanks())]
    monkeypatch.setattr(hashing, "BLOCK", 100)
    assert [h.tolist() for h in hashing.hashed_words(texts, hashing.blanks())] == whole


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 560)] + [(900, 900), (700, 701), (701, 700), (700, 701)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(links)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots({n for link in links for n in link}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text, size=5):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def plain_components(rows):
    sets = [(r[0], shingle_set(r[1])) for r in rows]
    links = []
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((a, b))
    want = roots({a for a, _ in sets if a is not None}, links)
    return Counter((a, len(x), want.get(a)) for a, x in sets)


def near_copies(seed, families=3, size=25):
    """Families of copies with a few changed words each, around the bound, and documents that share one long passage."""
    rng = random.Random(seed)
    words = vocabulary(rng, ENGLISH, 800)
    rows, common = [], sentence(rng, words, 40)
    for f in range(families):
        base = sentence(rng, words, 80 + 60 * f).split(" ")
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text = text[: rng.randint(len(text) * 3 // 4, len(text))]
            rows.append((len(rows) * 7 % 1009, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text), "en", "a"))
    for _ in range(40):
        rows.append((len(rows) * 7 % 1009, f"{sentence(rng, words, rng.randint(5, 40))} {common} {sentence(rng, words, rng.randint(5, 40))}", "en", "b"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, docs, seed):
    rows = near_copies(seed) if seed == 1 else [*near_copies(seed, 2, 12), *[(5000 + r[0] if r[0] is not None else None, *r[1:]) for r in docs]]
    # Few sampled documents, or a low bar for what is common, change the order of shingles but nothing else.
    join = jaccard.Join(sample=50, common_least=2, block=4, large=6) if seed == 1 else jaccard.Join()
    got = jaccard.link_documents(frame(spark, rows), join)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == plain_components(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g", "en", "a"), (1, "A b c d e f g", "en", "b"), (2, "other words", "en", "a"), (2, "other words", "en", "a"), (None, "a b c d e f g", "en", "a"), (9, None, None, None), (8, "", "en", "a")]
    df = frame(spark, rows)
    kept = jaccard.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 9, 8])
    assert jaccard.link_documents(df.limit(0)).count() == 0


# Passages


def test_chains_equal_the_best_by_all_predecessors():
    rng, settings = random.Random(4), substring.Passages(covered=0)
    for _ in range(150):
        count = rng.randint(1, 25)
        i, j = np.array([rng.randrange(80) for _ in range(count)]), np.array([rng.randrange(80) for _ in range(count)])
        order = sorted(range(count), key=lambda n: (i[n], j[n]))
        score = {}
        for n in order:
            before = [score[m] - settings.gap_cost / 2 * (i[n] - i[m] + j[n] - j[m]) for m in score if i[m] < i[n] and j[m] < j[n]]
            score[n] = settings.k + max([0.0, *before])
        best = substring.chains(i, j, settings)[0]
        own = settings.k
        for (a, b), (c, d) in zip(best, best[1:]):
            assert a < c and b < d
            own += settings.k - settings.gap_cost / 2 * (c - a + d - b)
        assert own == pytest.approx(max(score.values()))


def passage_documents(rng):
    words = vocabulary(rng, ENGLISH, 2000)
    fill = lambda low, high: sentence(rng, words, rng.randint(low, high))
    rows = [(i, fill(60, 300), "en", "a") for i in range(40)]
    planted = set()
    for n in range(12):
        passage = sentence(rng, words, rng.randint(51, 120))
        for k in range(rng.randint(2, 4)):
            text = passage.split(" ")
            if n % 3 == 0:  # changed, left out and put in words
                text[20] = "changed"
                del text[35]
                text.insert(len(text) - 15, "more")
            ident = 100 + 10 * n + k
            rows.append((ident, f"{fill(0, 200)} {' '.join(text)} {fill(0, 200)}", "en", "a"))
            if n % 3 or len(text) > 60:
                planted.add(ident)
    line = sentence(rng, words, 25)
    rows += [(300 + i, f"{fill(30, 90)} {line} {fill(30, 90)}", "en", "b") for i in range(20)]
    return rows, planted


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_are_found_and_nothing_else(spark, seed):
    rows, planted = passage_documents(random.Random(seed))
    got = {r.doc_id: r for r in substring.find_passages(frame(spark, rows)).collect()}
    assert planted <= set(got)
    assert not [i for i in got if i < 100 or i >= 300]
    for ident, r in got.items():
        assert all(0 <= p.start < p.end <= r.n_words and p.end - p.start >= 51 for p in r.passages)
        assert r.repeated_words == sum(p.end - p.start for p in r.passages)


def test_passages_of_odd_documents(spark, docs):
    rows = [*docs, (900, "las " * 3000, None, "a")]
    got = {r.doc_id: r for r in substring.find_passages(frame(spark, rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    holders = defaultdict(set)
    for ident, *_ in rows:
        words = WORD.findall((text[ident] or "").translate(FOLD))
        for k in range(len(words) - 50):
            holders[tuple(words[k : k + 51])].add(ident)
    exact = {i for ids in holders.values() if len(ids - {None}) > 1 for i in ids - {None}}
    assert exact <= set(got) and None not in got
    assert got[900].repeated_words == 3000
    assert substring.find_passages(frame(spark, rows).limit(0)).count() == 0


def test_a_short_equal_stretch_does_not_hide_a_longer_changed_one():
    settings = substring.Passages()
    a = np.arange(110)
    same = np.ones(110, bool)
    same[40:55] = False
    same[[60, 70, 80, 90, 100]] = False
    at = np.flatnonzero(same)
    assert [(at[f], at[x]) for f, x in substring.dense(at, at, settings)] == [(55, 109)]
    # 41 of 51 words agree although the stretch of highest gain is only 40 words long.
    at = a[[*range(40), 50]]
    assert [(at[f], at[x]) for f, x in substring.dense(at, at, settings)] == [(0, 50)]
    assert substring.dense(np.arange(50), np.arange(50), settings) == []


def changed_copies(rng, size, share, settings, kinds):
    """Two texts of word numbers with a passage of which a share of words is changed, deleted or followed by another, and that agrees enough."""
    word = lambda n: rng.integers(1, 2**62, n).astype(np.uint64)
    while True:
        a = word(size)
        chosen = dict(zip(rng.choice(size, round(share * size), replace=False).tolist(), rng.choice(kinds, round(share * size)).tolist()))
        b = [w for n, x in enumerate(a) for w in {"change": word(1), "delete": word(0), "insert": [x, *word(1)]}.get(chosen.get(n), [x])]
        b = np.array(b, np.uint64)
        at_a = np.flatnonzero(np.isin(a, b))
        at_b = np.flatnonzero(np.isin(b, a))
        if substring.dense(at_a, at_b, settings):
            return np.concatenate([word(80), a, word(80)]), np.concatenate([word(80), b, word(80)])


@pytest.mark.parametrize("kinds", [["change"], ["delete"], ["insert"], ["change", "delete", "insert"]], ids="-".join)
@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.19])
def test_changed_passages_are_recalled(share, kinds):
    rng, settings, found, count = np.random.default_rng(7), substring.Passages(), 0, 0
    for size in (65, 80, 100, 120):
        for _ in range(25):
            a, b = changed_copies(rng, size, share, settings, kinds)
            (seeds_a, at_a), (seeds_b, at_b) = (substring.sampled(t, settings.k, settings.window) for t in (a, b))
            i, j = np.nonzero(seeds_a[:, None] == seeds_b[None, :])
            chains = substring.chains(at_a[i], at_b[j], settings) if len(i) else []
            found += any(substring.dense(*substring.align(c, a, b, settings), settings) for c in chains)
            count += 1
    assert found >= 0.93 * count


def test_common_words_are_a_longest_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, rng.integers(2, 9), rng.integers(0, 25)).astype(np.uint64) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j] + (a[i] == b[j]), best[i, j + 1], best[i + 1, j])
        x, y = substring.common(a, b)
        assert (a[x] == b[y]).all() and len(x) == best[-1, -1] and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_runs_that_an_earlier_document_has_leave_no_seeds(spark):
    """But only seeds that the earlier document surely has as well: all keys of both are still there."""
    rng = random.Random(9)
    words = vocabulary(rng, ENGLISH, 3000)
    shared = sentence(rng, words, 90)
    texts = [f"{sentence(rng, words, 50)} {shared} {sentence(rng, words, 50)}" for _ in range(2)]
    rows = [(1, texts[0], None), (2, texts[1], [(50, 140)])]
    body = spark.createDataFrame(rows, "id bigint, text string, known array<struct<start:int,end:int>>")
    settings = substring.Passages()
    with_known = {(r.id, r.key) for r in substring._short_seeds(body, settings).collect()}
    without = {(r.id, r.key) for r in substring._short_seeds(body.withColumn("known", F.lit(None).cast(body.schema["known"].dataType)), settings).collect()}
    assert with_known < without and {k for _, k in with_known} == {k for _, k in without}


def test_documents_between_share_a_passage_of_frequent_lines(spark):
    rng = random.Random(11)
    words = vocabulary(rng, ENGLISH, 4000)
    fill = lambda: sentence(rng, words, 40)
    one, other = sentence(rng, words, 30), sentence(rng, words, 30)
    middle = " ".join([*one.split()[-14:], *other.split()[:14]])
    rows = [(i, f"{fill()} {part} {fill()}", "en", "a") for at in (0, 90) for i, part in enumerate([one, other, middle] * 3, at)]
    rows += [(i, f"{fill()} {one} {other} {fill()}", "en", "a") for i in (50, 51)]
    got = {r.doc_id: r for r in substring.find_passages(frame(spark, rows)).collect()}
    assert set(got) == {50, 51}
    assert all(60 <= r.repeated_words <= 64 for r in got.values())


def test_copies_with_another_last_sentence_are_found(spark):
    rng = random.Random(5)
    words = vocabulary(rng, ENGLISH, 2000)
    first = [sentence(rng, words, 12) for _ in range(4)]
    prose = ". ".join(first) + "."
    asked = sentence(rng, words, 20)
    items = [(1, f"{prose} thes inth er."), (2, f"{asked}? {sentence(rng, words, 9)}.")]
    fill = lambda: sentence(rng, words, 60)
    rows = [(i, f"{fill()} {text} {fill()}", "en", "a") for i, text in enumerate([f"{prose} thes inth oder.", prose, f"{asked}?", fill()])]
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_items(frame(spark, rows), tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 1)}


def test_toxic_passages_late_in_long_texts_are_learned(spark):
    rng = random.Random(8)
    words, bad = vocabulary(rng, ENGLISH), [w + "zzq" for w in vocabulary(rng, "bfgkvwxyz", 40)]
    rows = [(i, sentence(rng, words, 3000), "en", "a") for i in range(120)]
    rows = [(i, f"{text} {sentence(rng, bad, 8)}" if i % 3 == 0 else text, *rest) for i, text, *rest in rows]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    docs = frame(spark, rows)
    model = toxicity.learn(docs, labels, F.col("doc_id") < 90)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(90, 120))


def test_pieces_are_spread_over_the_whole_text():
    settings = toxicity.Settings(train_chars=100, piece_chars=20)
    text = " ".join(str(n) for n in range(1000, 3000))
    found = toxicity.spread(text, settings).split()
    assert found[0] == "1000" and found[-1] == "2999" and set(found) <= set(text.split())
    assert toxicity.spread("ab cd", settings) == "ab cd"


def test_only_seeds_of_several_documents_are_written(spark):
    rng = random.Random(21)
    words = vocabulary(rng, ENGLISH, 3000)
    shared = sentence(rng, words, 60)
    texts = [f"{sentence(rng, words, 80)} {shared if i < 2 else ''} {sentence(rng, words, 80)}" for i in range(6)]
    rows = [(i, text, None) for i, text in enumerate([*texts, texts[5]])] + [(5, texts[5], None)]
    rows = [r for r in rows if r[0] != 6]  # the id 5 comes twice and is one document
    body = spark.createDataFrame(rows, "id bigint, text string, known array<struct<start:int,end:int>>")
    settings, holders = substring.Passages(), defaultdict(set)
    every = substring._short_seeds(body, settings).collect()
    for r in every:
        holders[r.key].add(r.id)
    scratch = Scratch(spark, "seeds-test")
    got = {tuple(r) for r in substring._several(body, settings, scratch).collect()}
    assert got == {tuple(r) for r in every if len(holders[r.key]) > 1} and got
    names = [path.name.partition("-")[2] for path in Path(scratch.root.removeprefix("file:")).iterdir()]
    assert sum(spark.read.parquet(str(path)).count() for path in Path(scratch.root.removeprefix("file:")).iterdir()) < len(every)
    assert sorted(names) == ["several", "short"]
    scratch.drop()


@pytest.mark.parametrize("others", [20, 150])
def test_a_changed_passage_around_a_frequent_line_is_found_between_other_holders(spark, others):
    """All seeds that the two share are in the line that the others have as well: by first and last holder they never meet."""
    rng = random.Random(31)
    words = vocabulary(rng, ENGLISH, 4000)
    line, before, after = sentence(rng, words, 14).split(), sentence(rng, words, 25).split(), sentence(rng, words, 25).split()
    changed = lambda text, mark: [f"{mark}{n}" if n % 5 == 0 else w for n, w in enumerate(text)]
    fill = lambda low, high: sentence(rng, words, rng.randint(low, high))
    rows = [(i if i < others // 2 else 1000 + i, f"{fill(60, 90)} {' '.join(line)} {fill(60, 90)}", "en", "a") for i in range(others)]
    for ident, mark in ((500, "one"), (501, "other")):
        passage = " ".join([*changed(before[::-1], mark)[::-1], *line, *changed(after, mark)])
        rows.append((ident, f"{fill(60, 90)} {passage} {fill(60, 90)}", "en", "a"))
    got = {r.doc_id: r for r in substring.find_passages(frame(spark, rows)).collect()}
    assert set(got) == {500, 501}
    assert all(51 <= r.repeated_words <= 66 for r in got.values())


def test_tiles_find_what_alignment_of_every_pair_finds():
    rng, settings = np.random.default_rng(3), substring.Passages()
    side = settings.min_words - settings.k
    rows = rng.integers(1, 60, (24, 2 * side + settings.k)).astype(np.uint32)
    rows[:, side - 6 : side + 8] = np.arange(100, 114)
    for n in range(1, 24, 2):  # a copy of the one before, with changes that may be too many
        rows[n] = np.where(rng.random(rows.shape[1]) < rng.uniform(0.1, 0.4), rng.integers(1000, 2000, rows.shape[1]), rows[n - 1])
        rows[n, side : side + settings.k] = rows[n - 1, side : side + settings.k]
    rows[4, : side - 10] = rows[5, : side - 10] = 0
    other = ~np.eye(24, dtype=bool)
    truth = set()
    for n, m in zip(*np.nonzero(other)):
        a, b = rows[n], rows[m]
        chain = [(side - int((a[:side] == 0).sum()), side - int((b[:side] == 0).sum()))]
        if substring.dense(*substring.align(chain, a[a != 0], b[b != 0], settings), settings):
            truth.add((int(n), int(m)))
    got = substring.met(rows, rows, settings, other)
    assert set(got) <= truth and {n for n, _ in got} == {n for n, _ in truth}
    assert 0 < len(got) < 24
