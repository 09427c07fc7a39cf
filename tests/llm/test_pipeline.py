import pytest

import corpus_pipeline
from peakloom.llm import language, pieces

from . import test_decontaminate, test_linededup, test_simhash


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(f(spark, out[-1], sf).collect(), f(spark, out[-1], sf).schema))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(0 < b.count() <= a.count() for a, b in zip(stages, stages[1:]))


def test_language(stages):
    docs, kept = stages[:2]
    model = language.Model.fit(language.sample(docs))
    want = {}
    for d, t in texts(docs).items():
        if t and any(c.isalpha() for c in t):
            _, score, rate = model.classify([t.encode()])
            if score[0] >= 0.5 and rate[0] < 8:
                want[d] = t
    assert texts(kept) == want


def test_lines(spark, stages):
    rows = list(texts(stages[1]).items())
    test_linededup.order_of(spark, rows)
    kept = test_linededup.brute(rows)
    want = {}
    for d, t in rows:
        lines = t.split("\n")
        if (d, t) in kept:
            want[d] = "\n".join(x for k, x in enumerate(lines) if k in kept[d, t] or not x.strip(" "))
    assert texts(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicates(stages):
    before = texts(stages[2])
    groups = test_simhash.brute_components([(d, test_simhash.brute_fingerprint(t)) for d, t in before.items()])
    assert set(texts(stages[3])) == {c for *_, c in groups}


def test_benchmark(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = test_decontaminate.brute(texts(stages[3]).items(), items)
    assert set(texts(stages[4])) == {d for d, x in found.items() if not x[4]}


def test_pieces(stages):
    before = texts(stages[4])
    rows = stages[5].collect()
    v = pieces.vocabulary(pieces.model_path())
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        assert r.lossless and r.n_pieces == len(r.piece_ids)
        assert b"".join(v.texts[i] for i in r.piece_ids)[1:].decode() == before[r.doc_id]


def test_run_does_the_same(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, tuple(r.piece_ids)) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1])


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0
