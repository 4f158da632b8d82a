"""Registered queries and the pipeline's stages, on the smallest tables."""

import pytest

import corpus_pipeline
from gaugework.llm.queries import ORACLE_SQL, QUERIES
from tests.agreement import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert not compare(spark, connect(SF), QUERIES[name], ORACLE_SQL[name], SF)[1]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = got[name] = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in got.items()}
    predicted = QUERIES["op4_ftrl_quality"](spark, SF).filter("predicted = 1").collect()
    assert ids["quality"] == {r.doc_id for r in predicted}

    from tests.llm.test_jaccard_join import brute
    from tests.llm.test_secrets_leaks import allowed, nearest, read

    rows = [(r.doc_id, r.text) for r in got["quality"].collect()]
    near = brute(rows, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert ids["near_duplicates"] == {c for _, _, c in near}
    items = [read(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for r in got["near_duplicates"].collect():
        words = read(r.text)
        near = [i for i in items if len(set(i) & set(words)) >= len(set(i)) - allowed(len(i))]
        if not any(nearest(i, words) <= allowed(len(i)) for i in near):
            clean.add(r.doc_id)
    assert ids["decontamination"] == clean
    assert ids["secrets"] == clean == ids["packing"]
    from gaugework.llm.credential_links import redact, scan
    before = {r.doc_id: r.text for r in got["decontamination"].collect()}
    for r in got["secrets"].collect():
        assert r.text == redact(before[r.doc_id], scan(before[r.doc_id])[1]) and r.n_chars == len(r.text)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "sequence_id" in out.columns


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, frame, odd_rows, empty):
    """Nulls, repeated rows and ids, very long texts and columns of other names; each stage keeps all columns but the last."""
    rows = [] if empty else odd_rows
    docs = frame(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        if name == "near_duplicates" and not empty:
            kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
            assert sum(i is None for i, _ in kept) == sum(i is None for i, _ in odd_rows)
            assert {i for i, _ in kept} == {None, 1, 2, 3, 4, 5, 7, 8, 10} or {i for i, _ in kept} >= {None, 1, 2, 4, 5, 7, 8, 10}
            assert len([i for i, _ in kept if i == 5]) == len([i for i, _ in kept if i == 7]) == 1
        if name != "packing":
            assert docs.columns == columns
    assert docs.count() == 0 if empty else docs.count() >= 9
