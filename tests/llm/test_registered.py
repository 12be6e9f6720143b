"""The registered text queries against their SQL, the pipeline against plain Python, and the guard of the entry file."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from orelayer.llm import language
from orelayer.llm.oracle import ORACLE
from orelayer.llm.queries import QUERIES
from orelayer.llm.text import table
from tests.compare import database, differences
from tests.llm.rows import FOLD, WORD, frame, odd_documents
from tests.llm.test_lines_and_counts import plain_line_dedup
from tests.llm.test_models_and_joins import plain_components

ROOT = Path(__file__).resolve().parents[2]


def test_every_operator_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert names >= {*QUERIES, "pipeline"} and set(__spark_entry__.oracle_sql()) >= set(ORACLE)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, folder, name):
    got = QUERIES[name](spark, folder).toArrow()
    assert differences(got, database(folder).sql(ORACLE[name]).to_arrow_table()) == []


def test_queries_do_not_need_the_text_operators():
    """As if both folders and the pipeline were gone: the other queries can still be listed."""
    for names in ("orelayer.llm", "corpus_pipeline"):
        code = "\n".join(
            [
                "import importlib.abc, sys",
                "class Gone(importlib.abc.MetaPathFinder):",
                "    def find_spec(self, name, path=None, target=None):",
                f"        if name == {names!r} or name.startswith({names + '.'!r}):",
                "            raise ModuleNotFoundError(name, name=name)",
                "sys.meta_path.insert(0, Gone())",
                "import __spark_entry__ as e",
                "print([n for n in e.queries() if n.startswith('op') or n == 'pipeline'], len(e.queries()) > 80)",
            ]
        )
        said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert said.stdout.split("\n")[-2] == "[] True", said.stderr


def test_each_stage_keeps_what_it_should(spark, tmp_path):
    """Every stage on odd rows, held against plain Python on the rows its predecessor kept."""
    items = [(1, odd_documents()[0][1].replace("\n", " ")[:150] + ". The end."), (2, "not to be found anywhere at all. No.")]
    rows = [*odd_documents(), (9000, "before " + items[0][1] + " after that", "en", "a")]
    docs = frame(spark, rows)
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, columns = str(tmp_path), docs.columns

    def plain(df):
        return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]

    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    first = steps["language_id"](spark, docs, folder)
    assert first.columns == columns
    no_letter = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in first.collect() if r.doc_id is not None} >= {r[0] for r in rows if r[2] and r[0] is not None} - no_letter
    assert not {r.doc_id for r in first.where("doc_id is not null").collect()} & no_letter

    before = plain(first)
    second = steps["line_dedup"](spark, first, folder)
    want = plain_line_dedup(before)
    assert sorted((i, t) for i, t, *_ in plain(second) if i is not None) == sorted((i, kept) for i, _, _, kept in want.elements() if i is not None)

    third = steps["jaccard_join"](spark, second, folder)
    gone = {i for i, _, label in plain_components(plain(second)) if i != label}
    assert third.columns == columns
    assert {i for i, *_ in plain(third)} == {i for i, *_ in plain(second)} - gone

    fourth = steps["decontamination"](spark, third, folder)
    assert {r.doc_id for r in third.collect()} - {r.doc_id for r in fourth.collect()} == {9000} & {r.doc_id for r in third.collect()}
    last = steps["mixing"](spark, fourth, folder)
    taken = defaultdict(int)
    for r in last.collect():
        taken[r.target] += r.taken
    assert all(abs(n - t) <= 1 for t, n in taken.items())
    assert last.count() == fourth.count()


def test_pipeline_on_the_given_documents(spark, folder):
    """Stage by stage in plain Python, with the library's language verdicts: its model has no plain twin."""
    docs = table(spark, folder, "documents")
    languages = language.learn(docs, docs["doc_id"].isNotNull())
    rows = [tuple(r) for r in language.keep_identified(docs, languages).select("doc_id", "text").collect()]
    texts = [(i, kept) for i, _, _, kept in plain_line_dedup(rows).elements()]
    linked = {i for i, _, label in plain_components(texts) if i != label}
    items = [r.text.translate(FOLD) for r in table(spark, folder, "benchmark").collect()]
    clean = [(i, t) for i, t in texts if i not in linked and not any(item in t.translate(FOLD) for item in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) <= {i for i, _ in clean} and len(got) >= 0.98 * len(clean)
    sizes = dict(clean)
    assert all(r.size == len(WORD.findall(sizes[i])) for i, r in got.items())


def test_empty_documents_pass_through(spark, folder):
    empty = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0
