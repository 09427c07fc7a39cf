import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.functions import codecs
from peakloom.functions import transforms as T

TYPES = ("<f4", "<f8")


def model(x, name, s):
    """Quantised values one by one, in plain Python floats and single precision where the codec has it."""
    f = np.float32
    clip = lambda v, bits: int(min(max(v, 0), (1 << bits) - 1))
    if name == "cast16":
        return [clip(math.trunc(float(v * x.dtype.type(f(s)))), 16) for v in x]
    if name == "log":
        return [clip(math.floor(float(np.log2(float(v + x.dtype.type(1)))) * float(f(s))), 16) for v in x]
    if name.startswith("delta"):
        return [clip(math.floor(float(f(b - a) * f(s))), int(name[5:])) for a, b in zip(x, x[1:])]
    if name == "bitpack":
        return [clip(math.trunc(min(1.0, float(v / x.dtype.type(f(s)))) * ((1 << 27) - 1)), 27) for v in x]
    raise KeyError(name)


@pytest.mark.parametrize("dtype", TYPES)
@pytest.mark.parametrize("name", ["cast16", "log", "delta16", "delta24", "delta32", "bitpack"])
def test_payload_holds_the_models_integers(name, dtype):
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(500) * 300).astype(dtype)
    s = T.default_scale(name)
    body = T.TRANSFORMS[name].pack(x, s)
    want = model(x, name, s)
    if name == "bitpack":
        bits, size = struct.unpack_from("<BI", body)
        got = T.unpack_bits(body[5 : 5 + size], len(x), bits).tolist()
    else:
        rest = body[x.itemsize :] if name.startswith("delta") else body
        if name == "delta24":
            got = [int.from_bytes(rest[k : k + 3], "big") for k in range(0, len(rest), 3)]
        else:
            got = np.frombuffer(rest, {"delta32": "<u4"}.get(name, "<u2")).tolist()
    assert got == want


@pytest.mark.parametrize("dtype", TYPES)
@pytest.mark.parametrize("name", list(T.TRANSFORMS))
@pytest.mark.parametrize("case", ["empty", "one", "equal", "zero", "long", "sorted"])
def test_round_trips(name, dtype, case):
    rng = np.random.default_rng(2)
    x = {"empty": np.zeros(0), "one": np.array([123.5]), "equal": np.full(9, 7.25), "zero": np.zeros(5), "long": np.sort(rng.random(70_000)) * 900, "sorted": np.sort(rng.random(300)) * 400}[case].astype(dtype)
    y = T.decode(T.encode(x, name), name, dtype)
    assert y.dtype == x.dtype and len(y) == len(x)
    if name == "lossless" or len(x) == 0:
        assert (x == y).all()
        return
    relative = {"cast": 1e-6, "log": 0.012}.get(name, 0)
    step = {"cast16": 1 / 11.801 + 1e-4, "bitpack": 1e-3, "vbr": 0.15}.get(name, 0)
    if "delta" in name:  # each step loses up to one unit, and sums add up
        unit = float(1 / T.adaptive_scale(x, int(name[6:]))) if name.startswith("v") else 1 / T.default_scale(name)
        step = (unit + 3e-4) * len(x)
    assert np.abs(x.astype(float) - y).max() <= step + relative * (1 + np.abs(x.astype(float)).max())


def test_nothing_wraps():
    x = np.array([-5.0, 1e9, np.nan, np.inf, 3.0])
    for name in ("cast16", "log", "bitpack", "delta16", "delta24", "delta32"):
        y = T.decode(T.encode(x, name), name, "<f8")
        assert len(y) == 5
    assert T.decode(T.encode(np.array([-5.0, 3.0]), "cast16"), "cast16", "<f8")[0] == 0
    assert T.decode(T.encode(np.array([9.0, 3.0]), "delta16"), "delta16", "<f8").tolist() == [9.0, 9.0]  # a step down is none


def test_rules():
    with pytest.raises(ValueError):
        T.transform("delta8")
    with pytest.raises(TypeError):
        T.encode(np.arange(3), "cast")
    with pytest.raises(ValueError):
        T.encode(np.zeros(70_000), "log", strict=True)
    assert T.transform("cast", "<f4").name == "lossless" and T.transform(4700004).name == "delta16"
    assert T.parse_scale("1.5") == 1.5
    for bad in ("", "-1", "1e3", "1.2.3", "."):
        with pytest.raises(ValueError):
            T.parse_scale(bad)
    assert [T.bits_needed(p, 1.0) for p in (0.5, 1, 3, 4, 255, 256)] == [2, 2, 2, 3, 8, 9]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 40) - 1), max_size=40), st.integers(1, 52))
def test_bits(values, bits):
    x = np.array([v % (1 << bits) for v in values], np.uint64)
    packed = T.pack_bits(x, bits)
    assert len(packed) == -(-len(x) * bits // 8)
    assert T.unpack_bits(packed, len(x), bits).tolist() == x.tolist()
    whole = sum(int(v) << bits * k for k, v in enumerate(x))
    assert int.from_bytes(packed, "little") == whole


@pytest.mark.parametrize("name", ["zstd", "lz4", "none", "nocomp"])
def test_block_codecs(name):
    for data in (b"", b"a", bytes(range(256)) * 100):
        packed = codecs.compressor(name)(data)
        assert codecs.decompressor(name)(packed, len(data)) == data
    with pytest.raises(Exception):  # noqa: B017
        codecs.decompressor(name)(codecs.compressor(name)(b"abc"), 2)


def test_codec_rules():
    with pytest.raises(ValueError):
        codecs.compressor("gzip")
    for name, level in (("zstd", 23), ("zstd", 0), ("lz4", 13)):
        with pytest.raises(ValueError):
            codecs.check_level(name, level)


@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i4", "<i8", "<f2"])
@pytest.mark.parametrize("compression", [codecs.ZLIB, codecs.NO_COMPRESSION])
def test_binary_text(dtype, compression):
    x = np.arange(50).astype(dtype)
    assert (codecs.decode_binary(codecs.encode_binary(x, compression), dtype, compression) == x).all()
    assert codecs.encode_binary(x[:0], compression) == b"" and len(codecs.decode_binary(b"", dtype, compression)) == 0


def test_column_forms_agree_with_the_codec(spark):
    x = np.sort(np.random.default_rng(3).random(200) * 400)
    df = spark.createDataFrame([(k, float(v), float(x[k - 1]) if k else None) for k, v in enumerate(x)], "k int, v double, p double")
    v, p = F.col("v"), F.col("p")
    forms = {"cast16": T.cast16_column(v, T.MZ_SCALES["cast16"]), "log": T.log_column(v, 72.0), "delta32": T.delta32_column(v, p, T.MZ_SCALES["delta32"]), "bitpack": T.bitpack_column(v, 10000.0)}
    rows = df.select("k", *[c.alias(n) for n, c in forms.items()]).orderBy("k").collect()
    for n in forms:
        got = [r[n] for r in rows if r[n] is not None]
        assert got == model(x, n, 72.0 if n == "log" else T.default_scale(n)), n


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("select cast16_decode(cast16_encode(array(1D, 2.5D))) a, lossless_decode(lossless_encode(array(1D, cast(0.1 as double)))) b").first()
    assert row.b == [1.0, 0.1] and abs(row.a[1] - 2.5) < 0.1
