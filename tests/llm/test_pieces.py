import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import pieces

ODD = ["", None, "a", " ", "  a  b ", "▁x▁ ▁", "日本語 ퟿ text\n\n\t tab", "héllo wörld 😀😀 \u0000 end", "a\n\nb c", "x" * 700, "▁", "\r\n();\r", "the quick brown fox " * 30]


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.model_path())


def sampled(texts, v, keys=None, alpha=1.0):
    keys = np.arange(len(texts)) if keys is None else np.array(keys)
    ids, counts = pieces.encode_batch(texts, keys.astype(np.uint64), v, alpha)
    stops = np.r_[0, np.cumsum(counts)]
    return [ids[a:b].tolist() for a, b in zip(stops, stops[1:])]


def test_lossless(v):
    rng = random.Random(1)
    alphabet = "ab  ▁\n\t\réö日😀the"
    texts = [t if t is None else t.encode() for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))).encode() for _ in range(300)]
    texts += [b"\xff\xfe abc \x80", b"\xed\xa0\x80 x", b"\xe2\x96", bytes(range(256))]
    ids, counts = pieces.encode_batch(texts, np.arange(len(texts)).astype(np.uint64), v)
    assert pieces.decode_batch(ids, counts, v) == [t or b"" for t in texts]


def test_depends_on_key_and_text_only(v, monkeypatch):
    texts = [t.encode() for t in ODD if t]
    whole = sampled(texts, v)
    assert whole == [sampled([t], v, [k])[0] for k, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "CHUNK", 50)
    assert whole == sampled(texts, v)
    assert sampled([texts[-1]] * 2, v, [1, 2])[0] != sampled([texts[-1]] * 2, v, [1, 2])[1]
    assert sampled([texts[-1]] * 2, v, [1, 1])[0] == sampled([texts[-1]] * 2, v, [1, 1])[1]


def brute(text, v, alpha):
    """Every segmentation of a short text with its exact probability."""
    cps = "▁" + text.replace("▁", "\U0010ffff").replace(" ", "▁")
    by = {}
    for i, t in enumerate(v.texts):
        if v.weight[i] > -1e8:
            by[t.decode().replace(" ", "▁")] = i
    out = {}

    def walk(at, ids, w):
        if at == len(cps):
            out[tuple(ids)] = out.get(tuple(ids), 0) + math.exp(w)
            return
        for n in range(1, 17):
            if at + n <= len(cps) and cps[at : at + n] in by:
                i = by[cps[at : at + n]]
                walk(at + n, [*ids, i], w + alpha * v.weight[i])
        if cps[at] not in by:
            raw = cps[at].replace("\U0010ffff", "▁").encode()
            walk(at + 1, [*ids, *v.byte_ids[list(raw)].tolist()], w + pieces.BYTE_WEIGHT * len(raw))

    walk(0, [], 0.0)
    total = sum(out.values())
    return {k: p / total for k, p in out.items()}


@pytest.mark.parametrize(("text", "alpha"), [("the", 1.0), ("ther e", 0.3), ("a\nb▁", 0.5), ("intention", 0.2)])
def test_samples_follow_the_lattice(v, text, alpha):
    want = brute(text, v, alpha)
    n = 20000
    got = Counter(map(tuple, sampled([text.encode()] * n, v, range(n), alpha)))
    assert set(got) <= set(want)
    for k, p in want.items():
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-4, (k, p, got[k] / n)


def test_columns(spark, v):
    df = spark.createDataFrame([(None if k == 3 else k, t, "z") for k, t in enumerate(ODD)], "doc_id bigint, text string, ids string")
    got = df.withColumn("out", pieces.encode(F.col("text"), F.col("doc_id"))).withColumn("back", pieces.decode(F.col("out"))).collect()
    assert all(r.back == r.text and (r.out is None) == (r.text is None) for r in got)
    checked = df.select("doc_id", pieces.encode_checked(F.col("text"), F.col("doc_id")).alias("p")).collect()
    assert {r.doc_id: r.p and r.p.ids for r in checked} == {r.doc_id: r.out for r in got} and all(r.p.lossless for r in checked if r.p)
    trips = {r.doc_id: r for r in pieces.round_trips(df).collect()}
    assert all(r.lossless for k, r in trips.items() if k != 1) and trips[1].n_pieces is None and trips[0].n_pieces == 0
    assert {r.doc_id: len(r.out) for r in got if r.out is not None} == {k: r.n_pieces for k, r in trips.items() if k != 1}
    assert pieces.round_trips(df.limit(0)).count() == 0
    again = df.repartition(3).withColumn("out", pieces.encode(F.col("text"), F.col("doc_id"))).collect()
    assert {r.text: r.out for r in again} == {r.text: r.out for r in got}


def test_unknown_piece_is_an_error(v):
    with pytest.raises(ValueError):
        pieces.decode_batch(np.array([10**6]), np.array([1]), v)


def test_parts_without_spaces(v, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(900)).encode() for a in ("ab\n", "日本語文字", "aé日\n ", "a▁\t", "x", "\r \n日a")]
    texts += [b"\xff\n" * 300, b"\x80\xe6\x97" * 200 + "日".encode() * 90]
    whole = sampled(texts, v)
    for chunk in (7, 40, 64, 333):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        assert whole == sampled(texts, v), chunk
        for t in texts:
            parts = list(pieces._parts(t, v))
            assert b"".join((b" " if lead and k else b"") + p for k, (p, lead) in enumerate(parts)) == t
    assert len(list(pieces._parts(texts[1], v))) > 3


def test_a_long_text_without_spaces_takes_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, numpy as np
from peakloom.llm import pieces
v = pieces.vocabulary(pieces.model_path())
text = "日本語のテキスト\\n1234567890abcdef\\n".encode() * 600_000
ids, counts = pieces.encode_batch([text], np.zeros(1, np.uint64), v)
assert pieces.decode_batch(ids, counts, v) == [text]
print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    size, peak = map(int, out.stdout.split())
    assert size > 20 << 20 and peak < 1500, (size, peak)
