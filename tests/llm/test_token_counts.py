import random

import numpy as np
import pytest

from peakloom.llm import token_counts as tc


def brute(tokens, eod):
    out, start = [], 0
    for k, t in enumerate(tokens):
        if t == eod:
            out.append((len(out), start, k - start, True))
            start = k + 1
    if start < len(tokens):
        out.append((len(out), start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize(("block", "span", "width"), [(1, 2, 2), (7, 3, 2), (64, 256, 4), (1 << 19, 256, 2)])
def test_files_match_brute_force(spark, tmp_path, block, span, width):
    rng = random.Random(block)
    files = {
        "a": [rng.choice([9, 9, 1, 2]) for _ in range(300)],
        "b": [1] * 100 + [9] + [2] * 50,
        "c": [9, 9, 9],
        "d": [5] * 40,
        "e": [],
        "f": [9],
    }
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, f"<u{width}").tobytes())
    blocks = tc.read_files(spark, str(tmp_path), width, block)
    got = tc.stitch(tc.find_separators(blocks, 9, width), span).collect()
    by = {name: [] for name in files}
    for r in got:
        by[r.file.rsplit("/", 1)[1]].append((r.ordinal, r.start, r.n_tokens, r.closed))
    assert {k: sorted(x) for k, x in by.items()} == {k: brute(x, 9) for k, x in files.items()}


def test_one_file_over_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 50, 200_000).astype("<u2")
    tokens[60_000:130_000] = 7  # a document longer than many blocks
    (tmp_path / "a file").write_bytes(tokens.tobytes())
    blocks = tc.read_files(spark, str(tmp_path), 2, 1000, task_bytes=50_000)
    assert blocks.rdd.getNumPartitions() == 8
    sizes = [len(x) for x in blocks.select("block").rdd.glom().collect()]
    assert sum(sizes) == 200 and max(sizes) < 60
    got = sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in tc.count_tokens(blocks, 9).collect())
    assert got == brute(tokens.tolist(), 9)


def test_a_file_of_over_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 4096
    with open(tmp_path / "big", "wb") as f:  # sparse: zeros take no room on disk
        f.truncate(size)
        for at in (0, 1 << 20, size - 2):
            f.seek(at)
            f.write(np.array([9], "<u2").tobytes())
    rows = tc.count_tokens(tc.read_files(spark, str(tmp_path), block=1 << 22), 9).orderBy("ordinal").collect()
    assert [(r.start, r.n_tokens, r.closed) for r in rows] == [(0, 0, True), (1, (1 << 19) - 1, True), ((1 << 19) + 1, size // 2 - (1 << 19) - 2, True)]


@pytest.mark.parametrize("path", ["file:/a/b c", "file:///a/b c", "hdfs://h:1/a/b c", "s3a://bucket/a/b c"])
def test_names_of_files(path):
    scheme, authority, rest = tc._split(path)
    assert (scheme, rest) == (path.split(":")[0], "/a/b c") and authority == {"hdfs": "h:1", "s3a": "bucket"}.get(scheme, "")


def test_half_a_token_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        tc.read_files(spark, str(tmp_path)).collect()


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "long " * 5000, "x")], docs.schema)
    docs = docs.union(extra)
    coder = tc._encoding(tc.ranks_path())
    want = {r.doc_id: len(coder.encode_ordinary(r.text or "")) for r in docs.collect()}
    for block in (1000, tc.BLOCK_TOKENS):
        rows = tc.stitch(tc.find_separators(tc.flatten(docs, block=block)), span=4).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
        assert all(r.closed for r in rows)
    assert tc.count_tokens(tc.flatten(docs.limit(0))).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b", "x"), (None, None, "x"), (3, "a b", "y"), (3, "a b", "y"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, file string").coalesce(1)
    n = len(tc._encoding(tc.ranks_path()).encode_ordinary("a b"))
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tc.count_tokens(tc.flatten(docs, block=2)).collect())
    assert got == [(0, 0), (0, n), (3, 0), (3, n), (3, n)]
