import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peakloom.llm import sharding


def brute_shard(spark, keys, weights):
    """From the hashes of Spark, the scores in Python."""
    n = len(weights)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", F.array(*[F.xxhash64("k", F.lit(i)) for i in range(n)]).alias("h"))
    out = {}
    for r in df.collect():
        u = [((h % (1 << 64)) >> 12) + 0.5 for h in r.h]
        out[r.k] = max(range(n), key=lambda i: (-weights[i] / math.log(u[i] / (1 << 52)), -i))
    return out


def test_shard_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, grown = brute_shard(spark, texts, [1.0] * 16), brute_shard(spark, texts, [1.0] * 17)
    rows = sharding.shard_table(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "key", want[r.doc_id], grown[r.doc_id])
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))


def test_weights_draw_records(spark):
    ids = spark.range(20000)
    count = Counter(r.s for r in ids.select(sharding.shard_of(F.col("id"), [1.0, 2.0, 1.0]).alias("s")).collect())
    assert abs(count[1] / 20000 - 0.5) < 0.02 and abs(count[0] / 20000 - 0.25) < 0.02
    moved = ids.select(sharding.shard_of(F.col("id"), [1.0] * 4).alias("a"), sharding.shard_of(F.col("id"), [1.0, 1.0, 1.0, 1.5]).alias("b")).filter("a <> b")
    assert {r.b for r in moved.collect()} == {3}
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [1.0, 0.0])


def test_odd_rows(spark):
    rows = [(None, None), (None, "x"), (1, None), (1, ""), (2, "é")] + [(9, "same")] * 20000
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "doc_id bigint, text string, shard string, slot int")
    got = sharding.shard_table(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == {1: 1, 2: 3, 9: 5}.get(r.doc_id, r.size)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sum(r.text_crc32 is None for r in got) == 2
    assert sharding.shard_table(df.limit(0)).count() == 0
