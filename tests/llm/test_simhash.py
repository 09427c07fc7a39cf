import random
import re

import numpy as np
import pytest
import xxhash

from peakloom.llm import graph, simhash


def brute_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    """rows: (doc_id, fingerprint); the smallest doc_id each can reach."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


TEXTS = [None, "", "  \n", "One", "one", "a b", "a b c", "A B C d", "x " * 4000, "ÄÖ ä ö é", "no break space here too", "the cat sat on the mat " * 3, "a b c a b c a b c"]


def test_fingerprints():
    got = simhash.fingerprints_of([t if t is None else t.encode() for t in TEXTS])
    assert got.tolist() == [brute_fingerprint(t) for t in TEXTS]


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "cat", "ÖÄ", "x" * 30, "a\u00a0b"]) for _ in range(n)) + rng.choice(["", " \n", "\t"]) for n in (3, 4, 5, 50, 400)] + [" " * 300, "one" + " " * 300 + "two", "y" * 500]
    want = [brute_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 16)
    assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == want
    assert [simhash.fingerprints_of([t.encode()])[0] for t in texts] == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_close_pairs_match_popcount(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    fps = np.sort(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, k % 6))) for k in range(20)]))
    group = np.sort(rng.integers(0, 5, len(fps)))
    got = set(zip(*[x.tolist() for x in simhash.close_pairs(fps, group, radius)]))
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert got


def test_components_on_near_copies_and_hot_keys(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # a dense ball, one hot key
    fps += [fps[1] ^ (1 << 63), fps[1] ^ (1 << 63) ^ 7, 0, (1 << 64) - 1]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp bigint")
    for block in (512, 16):
        found = {r.node: r.root for r in graph.components(simhash.links(df, block=block)).collect()}
        signed = sorted(f - (1 << 64) if f >> 63 else f for f in set(fps))
        want = brute_components([(f, f % (1 << 64)) for f in signed])
        assert sorted(((f, f"{f % (1 << 64):016x}", found.get(f, f)) for f in signed), key=str) == want


def test_near_duplicates_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    assert rows_of(simhash.near_duplicates(docs)) == want
    assert any(int(d) != c for d, _, c in want)


def test_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a b c"), (None, "only here, no id"), (3, "One"), (3, "One")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id bigint, text string, fp string, hits string")
    assert rows_of(simhash.near_duplicates(df)) == brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = {c for *_, c in brute_components([(d, brute_fingerprint(t)) for d, t in rows])}
    assert kept.count() == len(groups)
    assert rows_of(simhash.near_duplicates(df.limit(0))) == []
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}
