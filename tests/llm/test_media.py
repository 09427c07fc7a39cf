import io
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from peakloom.llm import media


def song(seed, notes=40, note=512):
    rng = random.Random(seed)
    t = np.arange(note) / media.RATE
    parts = [np.sin(2 * np.pi * 220 * 2 ** (rng.randrange(24) / 12) * t) for _ in range(notes)]
    return np.concatenate(parts) * 0.6


def pcm(x):
    return np.round(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def wav(x, rate=media.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm(np.repeat(x, channels)))
    return out.getvalue()


def brute_int(image, at):
    """One position, rectangle by rectangle."""
    wide = np.concatenate([image, image], axis=1)
    box = lambda t, y, w, h: wide[at + t : at + t + w, y : y + h].sum()
    out = 0
    for kind, y, h, w in media.filters():
        a, b = w // 2, h // 2
        if kind == "pitch":
            p, q = box(0, y, w, b), box(0, y + b, w, h - b)
        elif kind == "time":
            p, q = box(0, y, a, h), box(a, y, w - a, h)
        elif kind == "checker":
            p, q = box(0, y, a, b) + box(a, y + b, w - a, h - b), box(0, y + b, a, h - b) + box(a, y, w - a, b)
        else:
            e = w // 4
            p, q = box(e, y, w - 2 * e, h), box(0, y, e, h) + box(w - e, y, e, h)
        r = np.log((p + 0.05) / (q + 0.05))
        out = out << 2 | (0, 1, 3, 2)[sum(r >= x for x in media.LEVELS)]
    return out


def test_integral_image_matches_plain_sums():
    image = np.random.default_rng(0).random((20, 12))
    got = media.fingerprint_frames(image[None])[0]
    assert got.tolist() == [brute_int(image, k) for k in range(20 - media.SPAN + 1)]


def test_pitch_classes():
    t = np.arange(4096) / media.RATE
    for k in range(12):
        assert (media.chroma(np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t)).argmax(axis=-1) == k).all()
    assert media.chroma(np.zeros(4096)).max() == 0 and media.chroma(np.zeros(10)).shape == (0, 12)


def test_formats_agree():
    x = song(1)
    plain, rate = media.samples(pcm(x))
    for data in (wav(x), wav(x, channels=2)):
        got, r = media.samples(data)
        assert r == rate and np.allclose(got, plain)


def test_alignment(spark):
    rng = np.random.default_rng(3)
    base = song(0, 80)
    rows = {
        0: base,
        1: base.copy(),  # an exact copy
        2: base[512 * 20 :],  # starts later
        3: np.concatenate([song(50, 10), base]),  # starts earlier
        4: base + rng.normal(0, 0.02, len(base)),  # noisy
        5: base * 0.3,  # quieter
        6: song(6, 80),
        7: song(7, 80),
        8: np.zeros(512 * 80),
        9: np.zeros(100),
    }
    data = [(k, pcm(x)) for k, x in rows.items()] + [(10, None), (None, pcm(base)), (100, pcm(song(7, 80)[512 * 8 :]))]
    df = spark.createDataFrame(data, "id bigint, audio binary").withColumn("offset", F.lit("x"))
    got = media.align(df.select("id", media.fingerprint(F.col("audio")).alias("fp")), F.col("id") % 100 == 0).collect()
    member = {r.id: r.class_id for r in got if r.kind == "member"}
    assert len([r for r in got if r.kind == "member"]) == len(data)
    assert member[1] == 0 and member[None] == 0 and member[9] == member[10] == 9 and member[6] == 6
    match = {(r.id, r.class_id): r for r in got if r.kind == "match"}
    assert {c for q, c in match if q == 0} >= {2, 3, 4} and not {c for q, c in match if q == 0} & {6, 7, 8, 9, 100}
    assert match[0, 2].offset == -20 and match[0, 3].offset == 10 and match[0, 4].offset == 0
    assert match[0, 2].ber < 0.05 and (100, 7) in match and match[100, 7].offset == 8
    fp = {r.id: np.array(r.fp, np.int32) for r in df.select("id", media.fingerprint(F.col("audio")).alias("fp")).collect()}
    for (q, c), r in match.items():
        a, b = fp[q][max(0, -r.offset) :], fp[c][max(0, r.offset) :]
        n = min(len(a), len(b))
        assert (r.overlap, r.bit_errors) == (n, int(np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum()))
    assert media.align(spark.createDataFrame([], "id bigint, fp array<int>"), F.col("id") % 100 == 0).count() == 0


def test_vectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    twin = vectors.filter("vec_id = 0").withColumn("vec_id", F.lit(10**6 + 1).cast("bigint"))
    odd = spark.createDataFrame([(10**6 + 2, None, None), (10**6 + 3, [], 1), (10**6 + 4, [0.1, None, float("nan")], 1), (None, [0.5] * 64, 1)], vectors.schema)
    rows = media.align_vectors(vectors.union(twin).union(odd)).collect()
    member = {r.id: r.class_id for r in rows if r.kind == "member"}
    assert member[10**6 + 1] == 0 and len(member) == vectors.count() + 5
    assert media.align_vectors(vectors.limit(0)).count() == 0


def test_alignment_is_exhaustive(spark):
    """Every pair within MAX_BER of each other at some offset is found, whether or not any integer is the same."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 32, int(n), dtype=np.uint32) for n in (16, 20, 33, 56, 56, 130)]
    rows = {100 * k: x for k, x in enumerate(base)}
    for k in range(90):
        x = base[k % 6]
        cut = int(rng.integers(0, len(x) - 15))
        rate = (0.05, 0.15, 0.19, 0.2, 0.21)[k % 5]
        x = np.concatenate([rng.integers(0, 1 << 32, int(rng.integers(0, 9)), dtype=np.uint32), x[cut:]])
        flips = rng.random((len(x), 32)) < rate
        if k % 4 == 0:
            flips[:, 0] |= ~flips.any(axis=1)  # no integer stays the same
        rows[1000 + 7 * k + 1] = x ^ np.packbits(flips, axis=1).view(">u4").ravel().astype(np.uint32)
    queries = [k for k in rows if k % 100 == 0]
    want = {}
    for q in queries:
        for c in rows:
            if q != c:
                for o in range(16 - len(rows[q]), len(rows[c]) - 15):
                    a, b = rows[q][max(0, -o) :], rows[c][max(0, o) :]
                    n = min(len(a), len(b))
                    errors = int(np.bitwise_count(a[:n] ^ b[:n]).sum())
                    if n >= media.MIN_OVERLAP and round(errors / (32 * n), 6) <= media.MAX_BER:
                        want.setdefault((q, c), {})[o] = n, errors, int((a[:n] == b[:n]).sum())
    assert sum(max(v for _, _, v in w.values()) < 3 for w in want.values()) > 20
    df = spark.createDataFrame([(k, x.view(np.int32).tolist()) for k, x in rows.items()], "id bigint, fp array<int>")
    match = {(r.id, r.class_id): r for r in media.align(df, F.col("id") % 100 == 0).collect() if r.kind == "match"}
    assert set(match) == set(want)
    for pair, r in match.items():
        best = min(want[pair].items(), key=lambda x: (-x[1][2], x[1][1] / x[1][0], abs(x[0]), x[0]))
        assert (r.offset, (r.overlap, r.bit_errors, r.votes)) == best
