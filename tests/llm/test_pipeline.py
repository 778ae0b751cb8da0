"""The pipeline: stages keep their contracts, decisions take effect, nothing clean is lost."""

from collections import defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from conftest_llm import SMALL
from tessera.llm import pii_tagger, quality_classifier, string_tiling
from tessera.llm.common import documents, table


def _shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module", autouse=True)
def short_training():
    """The tagger's skill is tested elsewhere."""
    keep, pii_tagger.STEPS = pii_tagger.STEPS, 20
    yield
    pii_tagger.STEPS = keep


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), documents(spark, SMALL), [documents(spark, SMALL)]
    for name, stage in P.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_queries_are_registered():
    q, o = E.queries(), E.oracle_sql()
    assert [sum(1 for k in q if k.startswith(f"op{n}_")) for n in range(1, 11)] == [1] * 10
    assert q["pipeline"] is P.run and "pipeline" not in o and 4 <= len(P.STAGES) <= 5


def test_columns_stay(steps):
    for x in steps[1:-1]:
        assert x.dtypes == steps[0].dtypes


def test_quality_drops_what_the_classifier_rejects(spark, steps):
    scores = {r.doc_id: r.predicted for r in quality_classifier.classify(steps[0], table(spark, SMALL, "labels")).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {k for k, v in scores.items() if v}


def test_one_of_each_group_stays(steps):
    before = {r.doc_id: _shingles(r.text) for r in steps[1].collect()}
    after = {r.doc_id for r in steps[2].collect()}
    near, ids = defaultdict(set), sorted(before)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if before[a] and 5 * len(before[a] & before[b]) >= 4 * len(before[a] | before[b]):
                near[a].add(b)
                near[b].add(a)
    seen, want = set(), set()
    for i in ids:
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    assert after == want and len(want) < len(ids)


def test_contaminated_documents_go(spark, steps):
    bad = {r.doc_id for r in string_tiling.contaminated(steps[2], table(spark, SMALL, "benchmark")).collect()}
    assert bad and {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in steps[2].collect()} - bad


def test_personal_data_is_masked_and_the_rest_is_as_it_was(steps):
    before, after = {r.doc_id: r for r in steps[3].collect()}, {r.doc_id: r for r in steps[4].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text) or r.text == before[i].text
        if not pii_tagger.base_spans(before[i].text) and r.text != before[i].text:
            assert any(f"<{k}>" in r.text for k in pii_tagger.KINDS)
        assert not [s for s in pii_tagger.base_spans(r.text) if s[1] == 0]


def test_packing_holds_every_document_left(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in steps[4].collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_and_awkward_tables(spark, awkward, steps):
    ran = sorted((r.doc_id, r.piece, r.length) for r in P.run(spark, SMALL).collect())
    assert ran == sorted((r.doc_id, r.piece, r.length) for r in steps[5].collect())
    for docs in (awkward, awkward.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SMALL)
            rows = out.count()
            if name != "packing":
                assert out.columns == docs.columns and rows <= docs.count()
            if name in ("personal_data", "packing"):
                assert rows >= docs.count()
