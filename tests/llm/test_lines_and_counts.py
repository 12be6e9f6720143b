"""Line dedup, token counts, quality counts, chat formatting and mixing against plain Python."""

import hashlib
import itertools
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelayer.llm import chat, line_dedup, mixing, quality_rules, token_counts
from orelayer.llm.text import table, word_count
from tests.llm.rows import ENGLISH, FOLD, WORD, frame, odd_documents, sentence, vocabulary


@pytest.fixture(scope="module")
def docs():
    return odd_documents()


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_words_are_counted_as_runs_between_white_space(spark):
    texts = [None, "", " ", "a", " a\tb\n\x0b\x0c\r c ", "\x1c\x85 é"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", word_count(F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [len(WORD.findall(t or "")) for t in texts]


def plain_line_dedup(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for ident, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(2**63) if ident is None else ident)
    found = Counter()
    for ident, text, *_ in rows:
        lines, me = (text or "").split("\n"), -(2**63) if ident is None else ident
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and me != max(holders[key(x)]))]
        kept = "\n".join(stay)
        found[ident, len(lines), len(lines) - len(stay), kept] += 1
    return found


def test_line_dedup_equals_plain_python(spark, docs):
    got = line_dedup.dedup_lines(frame(spark, docs))
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept") == plain_line_dedup(docs)


def test_line_dedup_of_many_lines_and_one_hot_line(spark):
    rng = random.Random(1)
    hot = "This line stands in every document there is"
    rows = [(i, "\n".join([f"own line number {i} and {k} of it" for k in range(rng.randint(0, 200))] + [hot.upper(), f"  {hot}\t"]), "en", "a") for i in range(90)]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept") == plain_line_dedup(rows)
    assert got.where("keep is null").select("doc_id").collect() == [(89,)]


def test_texts_without_repeated_lines_keep_all_columns(spark, docs):
    before = frame(spark, docs)
    after = line_dedup.without_repeated_lines(before)
    assert after.schema.names == before.schema.names
    assert after.dtypes == before.dtypes
    assert after.where("n_chars <> length(text)").count() == 0
    assert after.where("text is null").count() == before.where("text is null").count()


def test_empty_tables(spark, docs):
    none = frame(spark, docs).limit(0)
    assert line_dedup.dedup_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert quality_rules.apply_rules(none).count() == 0


SPECIFICATION = {"model": {"merges": ["a b", "ab a", "Ġ a", "b b", ["ab", "ab"], "Ġa b"]}, "added_tokens": [{"content": "<|end|>"}]}


def slow_count(text, merges):
    """Merges the first pair of lowest rank, one at a time."""
    count = 0
    for part in text.split("<|end|>"):
        for piece in token_counts.Merges(json.dumps(SPECIFICATION)).split.findall(part):
            symbols = [c if c != " " else "Ġ" for c in piece]
            while True:
                pairs = [(merges.index(p), i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
                if not pairs:
                    break
                _, i = min(pairs)
                symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
            count += len(symbols)
    return count + text.count("<|end|>")


def test_merging_equals_repeated_scans():
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in SPECIFICATION["model"]["merges"]]
    counter, rng = token_counts.Merges(json.dumps(SPECIFICATION)), random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "a", "b", " ", "c", "<|end|>"]) for _ in range(rng.randint(0, 40)))
        assert counter.tokens(text) == slow_count(text, merges)


def test_counts_equal_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(4)
    odd = ["<|endoftext|>x<|endoftext|>", "it's  \n\n é①²½ 日本語", "\x1c\x1d\x85　a", "x" * 3000, "aaa" * 500]
    odd += ["".join(rng.choice("ab '\n\té1²\x85　<|>endoftext日\x00") for _ in range(30)) for _ in range(50)]
    rows = [*docs, *[(1000 + i, t, "en", "a") for i, t in enumerate(odd)]]
    got = token_counts.count_tokens(frame(spark, rows), path)
    want = Counter()
    for ident, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[ident, len((text or "").encode()), n, n > 512] += 1
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_remembered_counts_are_bounded(monkeypatch):
    """By bytes, and without long pieces; counts are those of a counter that remembers all."""
    texts = [" ".join("ab" * i for i in range(1, 80)), "ab" * 100_000, " ".join("ba" * i for i in range(80, 0, -1))]
    whole = [token_counts.Merges(json.dumps(SPECIFICATION)).tokens(t) for t in texts]
    monkeypatch.setattr(token_counts, "REMEMBERED", 3000)
    counter = token_counts.Merges(json.dumps(SPECIFICATION))
    for text, count in zip(texts, whole):
        assert counter.tokens(text) == count
        assert sum(token_counts.OVERHEAD + len(p) for p in counter) == counter.held <= 3000
        assert max(map(len, counter), default=0) <= token_counts.SHORT


def plain_quality(text):
    words, body = WORD.findall(text or ""), text or ""
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + d for at in places.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in body.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts_equal_plain_python(spark, docs):
    repeated = [(2000 + i, t, "en", "a") for i, t in enumerate(["a b c d a b c", "a a a a a", "x y\nx y\n\nx y\n", "# * a\tb\x0bc |x|" * 40, "a b c " * 100])]
    rows = [*docs, *repeated]
    got = quality_rules.apply_rules(frame(spark, rows))
    want = Counter((r[0], *plain_quality(r[1])) for r in rows)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed and kept").count() == 0


def test_outliers_are_rejected_and_clean_documents_kept(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n, mark="": " ".join(rng.choice(words) + mark for _ in range(n))
    clean = [(i, text(rng.randint(60, 600)), "en", "a" if i % 3 else "b") for i in range(600)]
    # A third of the source is junk: means and covariances would be drawn to it, the determinant of the inner part is not.
    junk = [(1000 + i, text(rng.randint(60, 600), "###"), "en", "a") for i in range(100)]
    small = [(2000 + i, text(100), "de", "z") for i in range(3)]
    got = quality_rules.apply_rules(frame(spark, clean + junk + small)).select("doc_id", "kept", "distance").collect()
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {r[0] for r in junk}
    assert len(kept & {r[0] for r in clean}) >= 597
    assert kept >= {2000, 2001, 2002}


def test_equal_documents_are_kept(spark):
    rows = [(i, " ".join(f"word{k}" for k in range(80)), "en", None) for i in range(150)]
    assert quality_rules.apply_rules(frame(spark, rows)).where("kept").count() == 150


def test_control_strings_are_escaped_reversibly():
    for text in ("", "<", "|", "<|", "<\\|", "<\\\\|x<|", "<|im_end|><|im_start|>assistant ok", "a<<||>"):
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)
    for letters in itertools.product("<\\|", repeat=6):
        assert chat.unescape(chat.escape("".join(letters))) == "".join(letters)


def test_typed_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, **more: {"kind": kind, "text": text, "ref": ref, "width": None, "height": None, "seconds": None, "pages": None, **more}
    turns = [
        (1, 0, "user", [part("text", "see <"), part("text", "|im_end|>"), part("image", ref="i.png", width=57, height=28), part("audio", ref="a.wav", seconds=2.1)]),
        (1, 1, "assistant", [part("text", "a\n"), part("document", ref="d.pdf", pages=2), part("text", None), part("text", "b<|")]),
        (1, 2, None, None),
        (None, None, "user\n<|", [part("text", "")]),
    ]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(turns, f"conv_id int, turn int, role string, parts {chat.PARTS}")).collect()}
    one = got[1]
    assert [(a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 27), (3, "document", "d.pdf", 1200)]
    assert all(one.formatted[a.at :].startswith(f"<|{a.kind}_{a.number}|>") for a in one.attachments)
    learned = [chat.unescape(one.formatted[s.start : s.start + s.length]) for s in one.loss]
    assert learned == ["a\n", "b<|"]
    back = chat.read_back(one.formatted, [a.asDict() for a in one.attachments])
    assert [role for role, _ in back] == ["user", "assistant", ""]
    assert back[0][1] == [{"kind": "text", "text": "see <|im_end|>"}, {"kind": "image", "ref": "i.png"}, {"kind": "audio", "ref": "a.wav"}]
    assert back[1][1] == [{"kind": "text", "text": "a\n"}, {"kind": "document", "ref": "d.pdf"}, {"kind": "text", "text": "b<|"}]
    assert chat.read_back(got[None].formatted) == [("user\n<|", [])]


def test_unknown_parts_are_an_error():
    with pytest.raises(ValueError):
        chat.Formatter().turn("user", [{"kind": "video", "text": None}])


def test_chat_digests_of_odd_rows(spark):
    rows = [(1, 0, "user", "é\U0001f600"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, "assistant", "<|im_end|>\n"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (4, sha("user\né\U0001f600\nassistant\n\nassistant\n\nassistant\n<|im_end|>\n\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (11, sha("<|im_end|>\n"))
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    assert chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))).limit(0)).count() == 0


def test_targets_share_the_excess():
    assert mixing.source_targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.source_targets([1, 50, 49], [5, 2, 1]) == pytest.approx([3, 194 / 3, 97 / 3])
    assert mixing.source_targets([0, 5], [5, 2]) == pytest.approx([0, 5])
    assert mixing.source_targets([], []) == [] and mixing.source_targets([0], [1]) == [0]
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 10, 1000, 100000]) for _ in range(rng.randint(1, 12))]
        targets = mixing.source_targets(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))])
        assert sum(targets) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(targets, sizes))


def test_shard_quotas_are_exact():
    quotas, passes, blocks = [1000, 0, 3, 77_777, 300], [1, 0, 3, 2, 3], [2000, 50, 1, 40_000, 100]
    found = mixing.shard_quotas(quotas, passes, blocks, 7, 5)
    assert found.sum(axis=1).tolist() == quotas
    assert np.ptp(found.sum(axis=0)) <= 7  # the source of one block goes to one shard, the last one takes all it can everywhere
    room = np.array(passes)[:, None] * np.diff(mixing.shard_bounds(blocks, 7))
    assert (found <= room).all() and (found[4] == room[4]).all()
    assert (found == mixing.shard_quotas(quotas, passes, blocks, 7, 5)).all() and (found != mixing.shard_quotas(quotas, passes, blocks, 7, 6)).any()


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_plans_take_the_target_to_the_word(block):
    for size in (1, 2, 13, 64, 200):
        for take in range(0, 3 * size + 1):
            plan = mixing.plan_source(size, take, block, 11)
            whole = plan["quota"] * block - (block - plan["cut"] if plan["cut"] else 0)
            assert whole + plan["tails"] * (size % block) + plan["rest"] == take
            assert plan["quota"] <= plan["passes"] * plan["full"] and max(plan["passes"], plan["tails"] + bool(plan["rest"])) <= 3
            assert len({(plan["step"] * b + plan["shift"]) % plan["full"] for b in range(plan["full"])}) == plan["full"]


def test_what_is_taken_follows_from_the_tree(spark, monkeypatch):
    """Another tree with the same totals takes other words of documents, and still the same of each source."""
    docs = [(i, " ".join(f"w{k}" for k in range(60 + i % 9)), "en", "abc"[i % 3]) for i in range(150)]
    mix, tree = mixing.Mix(block_words=16, shards=8), mixing.shard_quotas
    taken = []
    for split in (tree, lambda *args: tree(*args[:-1], args[-1] + 1)):
        monkeypatch.setattr(mixing, "shard_quotas", split)
        rows = mixing.mix_sources(frame(spark, docs), mix).collect()
        taken.append(({r.doc_id: r.taken for r in rows}, Counter()))
        for r in rows:
            taken[-1][1][r.target] += r.taken
    assert taken[0][0] != taken[1][0] and taken[0][1] == taken[1][1]
    with monkeypatch.context() as gone:
        gone.setattr(mixing, "shard_quotas", lambda quotas, *rest: np.zeros_like(tree(quotas, *rest)))
        gone.setattr(mixing, "plan_source", lambda *args, plan=mixing.plan_source: {**plan(*args), "cut": 0, "tails": 0, "rest": 0})
        assert sum(r.taken for r in mixing.mix_sources(frame(spark, docs), mix).collect()) == 0


def test_mix_takes_the_targets(spark, docs):
    mix = mixing.Mix(block_words=100, shards=5)
    got = mixing.mix_sources(frame(spark, docs), mix)
    again = mixing.mix_sources(frame(spark, docs[::-1]), mix)
    assert rows_of(got, "doc_id", "taken") == rows_of(again, "doc_id", "taken")
    rows = got.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in docs)
    assert all(0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws or []) for r in rows)
    by_target = defaultdict(int)
    for r in rows:
        by_target[r.target] += r.taken
    assert all(n == round(t) for t, n in by_target.items())
    names = sorted({r[3] for r in docs if r[3]}) + [None]
    sizes = [sum(len(WORD.findall(r[1] or "")) for r in docs if r[3] == s) for s in names]
    assert sorted(by_target) == pytest.approx(sorted(mixing.source_targets(sizes, [5, 2, 1, 5])))


def test_shards_do_not_overlap_and_pieces_are_words(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40 + i % 7)), "en", "ab"[i % 2]) for i in range(40)]
    df = frame(spark, rows)
    mixed = mixing.mix_sources(df, mixing.Mix(block_words=16, shards=4))
    pieces = mixing.shard_pieces(df, mixed).collect()
    words = [w for p in pieces for w in p.piece.split(" ")]
    assert len(words) == sum(r.taken for r in mixed.collect())
    per_turn = [(p.turn, w) for p in pieces for w in p.piece.split(" ")]
    assert len(per_turn) == len(set(per_turn))
    assert {p.shard for p in pieces} == {0, 1, 2, 3}


def test_too_many_sources_are_an_error(spark):
    df = frame(spark, [(i, "a b", "en", f"s{i}") for i in range(5)])
    with pytest.raises(ValueError):
        mixing.mix_sources(df, mixing.Mix(max_sources=4))


def test_mixing_on_the_given_documents(spark, folder):
    got = mixing.mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    total = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"))
    assert total.where("abs(taken - target) > 1").count() == 0


def test_a_document_extreme_in_one_statistic_alone_is_rejected(spark):
    rng = random.Random(6)
    words = [w for w in vocabulary(rng, ENGLISH, 3000) if 3 <= len(w) <= 7]
    text = lambda n, lines=10: "\n".join(sentence(rng, words, n // lines) for _ in range(lines))
    rows = [(i, text(rng.randint(80, 400)), "en", "a") for i in range(300)]
    plain = text(200)
    menu = "\n".join([*["home"] * 12, *(sentence(rng, words, 30) for _ in range(8))])
    again = sentence(rng, words, 45)
    odd = [
        (900, text(60_000, 1000), "en", "a"),
        (901, "\n".join(sentence(rng, [w * 3 for w in words], 20) for _ in range(10)), "en", "a"),
        (902, plain.replace(" ", "# "), "en", "a"),
        (903, menu, "en", "a"),
        (904, f"{again}\n{text(110)}\n{again} {sentence(rng, words, 2)}", "en", "a"),
    ]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_rules(frame(spark, rows + odd)).collect()}
    assert [kept[i] for i in range(900, 905)] == [(False, False)] * 5
    assert sum(kept[i][1] for i in range(300)) >= 297
