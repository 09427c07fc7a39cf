import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import language

SAMPLES = {"xx": [b"abab abab ababab", b"ba"], "yy": [b"the cat", b"the bat the rat"], "zz": ["é à ç".encode()]}


def brute_bits(text, texts, order):
    """PPM with escape method C, one byte at a time."""
    counts = [Counter() for _ in range(order + 1)]
    pad = b"\n" * order
    for t in texts:
        t = pad + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][t[i - k : i + 1]] += 1
    total = 0.0
    text = pad + text
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            context, gram = text[i - k : i], text[i - k : i + 1]
            seen = {g: n for g, n in counts[k].items() if g[:-1] == context}
            n, q = sum(seen.values()), len(seen)
            if gram in seen:
                total -= math.log2(seen[gram] / (n + q))
                break
            if n:
                total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths(order):
    model = language.Model.fit(SAMPLES, order)
    texts = [b"", b"a", b"abab the cat", b"", b"zzz\x00\xff", "éé bat".encode(), b"ababababab" * 9, b"\n\n\nab"]
    got = model.bits(texts)
    for i, name in enumerate(sorted(SAMPLES)):
        for k, t in enumerate(texts):
            assert got[i, k] == pytest.approx(brute_bits(t, SAMPLES[name], order), abs=1e-6), (name, t)


def test_parts_change_nothing(monkeypatch):
    model = language.Model.fit(SAMPLES)
    texts = [b"the cat sat" * k for k in range(30)] + [b"qqq \x80", b""]
    whole = model.bits(texts)
    assert np.allclose(whole, np.column_stack([model.bits([t])[:, 0] for t in texts]))
    monkeypatch.setattr(language, "CHUNK_BYTES", 7)
    assert np.allclose(whole, model.bits(texts))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 !?", "en"), (None, "the dog", "en"), (7, "the", None), (7, "the", None), (8, "日本" * 9, None), (10, "le chat", "fr"), (12, "the cat", "en")]
    df = spark.createDataFrame([(*r, "s", 0.5, "x") for r in rows], "doc_id bigint, text string, lang string, score string, p double, lang_pred string")
    got = {(r.doc_id, i): r for i, r in enumerate(language.identify(df).orderBy("doc_id").collect())}
    by = {k[0]: r for k, r in got.items()}
    assert by[1].lang_pred == "en" and by[2].lang_pred == "fr" and by[7].lang_pred == "en"
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (3, 4, 5))
    assert by[None].held_out is False and by[None].lang_pred == "en"
    kept = language.keep_identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, None, 10, 12} and not {r.doc_id for r in kept.collect()} & {3, 4, 5}
    assert language.identify(df.limit(0)).count() == 0
    none = language.identify(df.withColumn("lang", df.lang.substr(9, 1)).filter("false").union(df.selectExpr("doc_id", "text", "cast(null as string)", "score", "p", "lang_pred"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.text.encode() for r in docs.filter(language.held_out(docs.doc_id)).collect()}
    learned = {r.text.encode() for r in docs.filter(~language.held_out(docs.doc_id)).collect()}
    got = language.sample(docs, total=200_000)
    assert set(got) == {"de", "en", "es", "fr"}
    for texts in got.values():
        assert 0 < sum(map(len, texts)) <= 50_000 or len(texts) == 1
        assert all(t in learned for t in texts) and not all(t in held for t in texts)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "ROW_BYTES", 500)
    rows = [(k, f"w{k % 100}q" * 40, f"l{k % 100}") for k in range(2000)] + [(5000 + k, "zzyx " * 1000, "long") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.sample(df, total=1 << 16)
    assert set(got) == {f"l{k}" for k in range(100)} | {"long"} and all(got.values())
    assert all(sum(map(len, x)) <= max(500, (1 << 16) * 64 // 101 // 101) for x in got.values())
    found = language.identify(df.filter("doc_id < 100 or doc_id >= 5000")).collect()
    assert len(found) == 103


def test_a_repeated_row_is_drawn_once(spark):
    one = spark.range(20_000).select(F.lit(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5)).cast("bigint").alias("doc_id"), F.lit("the same text " * 20).alias("text"), F.lit("en").alias("lang"))
    assert language.sample(one) == {"en": [b"the same text " * 20]}
