"""Array transforms: one table of lossy and lossless codecs, each with four faces.

    quantise / restore   numpy on one array: integers and back
    pack / unpack        the payload's bytes, little-endian unless noted
    column form          the same arithmetic as SQL expressions over rows or arrays (`*_column`)

Arrays are float32 or float64. Quantised values are clipped to what their width holds (nothing wraps, nothing is undefined), and
lengths take 32 bits, unless `strict` asks for the 16-bit lengths of the older layout, which then refuses longer arrays.
Empty arrays have an empty payload.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accession of each transform, and default scale factors for m/z and intensity.
ACCESSIONS = {
    "lossless": 4700000,
    "cast": 4700002,
    "log": 4700003,
    "delta16": 4700004,
    "delta24": 4700005,
    "delta32": 4700006,
    "vbr": 4700007,
    "bitpack": 4700008,
    "vdelta16": 4700009,
    "vdelta24": 4700010,
    "cast16": 4700011,
}
MZ_SCALES = {"delta16": 127.998046875, "delta24": 65536.0, "delta32": 262143.99993896484, "vbr": 0.1, "bitpack": 10000.0, "cast16": 11.801}
INTENSITY_SCALES = {"log": 72.0, "vbr": 1.0}
#: Scales of transforms on a stream for which none is fixed above.
OTHER_SCALE = 1000.0
BITPACK_BITS = 27
#: Bits of a variable-bit-rate value beyond which doubles hold no more.
MOST_BITS = 52

f32 = np.float32


def default_scale(name: str, stream: str = "mz") -> float:
    own, other = (MZ_SCALES, INTENSITY_SCALES) if stream == "mz" else (INTENSITY_SCALES, MZ_SCALES)
    return own.get(name, other.get(name, OTHER_SCALE))


def parse_scale(text: str) -> float:
    """Digits and dots only, as on the command line."""
    if not text or text.count(".") > 1 or set(text) - set("0123456789.") or text == ".":
        raise ValueError(f"no scale factor: {text!r}")
    return float(text)


# -- bits -------------------------------------------------------------------------------------------------------------


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Unsigned values of `bits` bits each, least significant bit first."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()


def bits_needed(peak: float, threshold: float) -> int:
    """Bits that steps of `threshold` up to `peak` take: 2 at least, MOST_BITS at most."""
    return int(min(MOST_BITS, max(2, np.ceil(np.log2(peak / threshold + 1)))))


def _u24(q: np.ndarray) -> bytes:
    """Three bytes each, most significant first."""
    return q.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def _from_u24(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint32)
    return raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]


def _clip(x: np.ndarray, top: int) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=top, neginf=0), 0, top).astype(np.uint64)


# -- the table --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transform:
    """pack(array, scale) -> payload body; unpack(body, n, dtype, scale) -> array. Lengths are the frame's business."""

    name: str
    pack: Callable[[np.ndarray, float], bytes]
    unpack: Callable[[bytes, int, np.dtype, float], np.ndarray]
    lossless: bool = False

    @property
    def accession(self) -> int:
        return ACCESSIONS[self.name]


def _identity() -> Transform:
    return Transform("lossless", lambda x, s: x.tobytes(), lambda b, n, t, s: np.frombuffer(b, t)[:n].copy(), True)


def _cast() -> Transform:
    return Transform("cast", lambda x, s: x.astype("<f4").tobytes(), lambda b, n, t, s: np.frombuffer(b, "<f4")[:n].astype(t))


def _cast16() -> Transform:
    def pack(x: np.ndarray, s: float) -> bytes:
        return _clip(np.trunc(x * f32(s)), 65535).astype("<u2").tobytes()

    return Transform("cast16", pack, lambda b, n, t, s: (np.frombuffer(b, "<u2")[:n].astype(f32) / f32(s)).astype(t))


def _log() -> Transform:
    def pack(x: np.ndarray, s: float) -> bytes:
        one = x.dtype.type(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return _clip(np.floor(np.log2((x + one).astype(float)) * f32(s)), 65535).astype("<u2").tobytes()

    return Transform("log", pack, lambda b, n, t, s: (np.exp2(np.frombuffer(b, "<u2")[:n] / float(f32(s))) - 1).astype(t))


def _steps(x: np.ndarray) -> np.ndarray:
    return x[1:] - x[:-1]


def _delta(name: str, width: int) -> Transform:
    """The first value as it is, then differences in steps of 1 / scale; differences and products in float32."""
    top = (1 << width) - 1

    def pack(x: np.ndarray, s: float) -> bytes:
        q = _clip(np.floor(_steps(x).astype(f32) * f32(s)).astype(float), top)
        return x[:1].tobytes() + (_u24(q) if width == 24 else q.astype(f"<u{width // 8}").tobytes())

    def unpack(b: bytes, n: int, t: np.dtype, s: float) -> np.ndarray:
        first, rest = np.frombuffer(b, t, 1), b[t.itemsize :]
        q = _from_u24(rest) if width == 24 else np.frombuffer(rest, f"<u{width // 8}")
        step = q[: n - 1].astype(f32) / f32(s) if width == 24 else q[: n - 1] / t.type(f32(s))
        return np.cumsum(np.concatenate([first.astype(t), step.astype(t)]), dtype=t)

    return Transform(name, pack, unpack)


def adaptive_scale(x: np.ndarray, width: int) -> np.float32:
    """The scale that makes the largest positive difference the largest integer; 1 if there is none."""
    most = f32(_steps(x).max(initial=0))
    return f32(f32((1 << width) - 1) / most) if most > 0 else f32(1)


def _vdelta(name: str, width: int) -> Transform:
    """Differences with a scale of the array's own, which goes before them; the first value in float32."""
    top = (1 << width) - 1

    def pack(x: np.ndarray, s: float) -> bytes:
        own = adaptive_scale(x, width)
        kind = x.dtype.type if width == 16 else np.float64
        q = _clip(np.floor(_steps(x).astype(kind) * kind(own)).astype(float), top)
        return x[:1].astype("<f4").tobytes() + own.astype("<f4").tobytes() + (_u24(q) if width == 24 else q.astype("<u2").tobytes())

    def unpack(b: bytes, n: int, t: np.dtype, s: float) -> np.ndarray:
        first, own = np.frombuffer(b, "<f4", 2)
        q = _from_u24(b[8:]) if width == 24 else np.frombuffer(b[8:], "<u2")
        step = q[: n - 1].astype(f32) / own if width == 24 else q[: n - 1] / t.type(own)
        return np.cumsum(np.concatenate([[t.type(first)], step.astype(t)]), dtype=t)

    return Transform(name, pack, unpack)


def _vbr() -> Transform:
    """As many bits a value as the largest value needs in steps of the threshold; peak and width go before the bits."""

    def pack(x: np.ndarray, s: float) -> bytes:
        peak = x.dtype.type(x.max(initial=0))
        bits = bits_needed(float(peak), s) if peak > 0 else 2
        top = (1 << bits) - 1
        q = _clip(np.trunc((x / peak if peak > 0 else x * 0).astype(float) * top), top)
        body = pack_bits(q, bits)
        return peak.tobytes() + struct.pack("<BI", bits, len(body)) + body

    def unpack(b: bytes, n: int, t: np.dtype, s: float) -> np.ndarray:
        peak = np.frombuffer(b, t, 1)[0]
        bits, size = struct.unpack_from("<BI", b, t.itemsize)
        q = unpack_bits(b[t.itemsize + 5 : t.itemsize + 5 + size], n, bits)
        return (q.astype(float) * float(peak) / ((1 << bits) - 1)).astype(t)

    return Transform("vbr", pack, unpack)


def _bitpack() -> Transform:
    """27 bits a value, of what it is to the scale; values above the scale count as the scale, below 0 as 0."""
    top = (1 << BITPACK_BITS) - 1

    def pack(x: np.ndarray, s: float) -> bytes:
        y = np.minimum((x / x.dtype.type(f32(s))).astype(float), 1.0)
        body = pack_bits(_clip(np.trunc(y * top), top), BITPACK_BITS)
        return struct.pack("<BI", BITPACK_BITS, len(body)) + body

    def unpack(b: bytes, n: int, t: np.dtype, s: float) -> np.ndarray:
        bits, size = struct.unpack_from("<BI", b)
        return (unpack_bits(b[5 : 5 + size], n, bits).astype(float) * float(f32(s)) / top).astype(t)

    return Transform("bitpack", pack, unpack)


TRANSFORMS: dict[str, Transform] = {
    x.name: x
    for x in (_identity(), _cast(), _cast16(), _log(), *[_delta(f"delta{w}", w) for w in (16, 24, 32)], *[_vdelta(f"vdelta{w}", w) for w in (16, 24)], _vbr(), _bitpack())
}
BY_ACCESSION = {x.accession: x for x in TRANSFORMS.values()}


def transform(name: str | int, dtype: np.dtype | str | None = None) -> Transform:
    """By name or accession. A cast of float32 arrays to float32 is lossless."""
    out = BY_ACCESSION.get(name) if isinstance(name, int) else TRANSFORMS.get(name)
    if out is None:
        raise ValueError(f"unknown transform: {name!r}; one of {', '.join(TRANSFORMS)}")
    if out.name == "cast" and dtype is not None and np.dtype(dtype).itemsize == 4:
        return TRANSFORMS["lossless"]
    return out


def encode(x: np.ndarray, name: str, scale: float | None = None, strict: bool = False) -> bytes:
    """The framed payload of one array: its length (32 bits, or 16 if strict), then the body. Empty: no bytes at all."""
    x = np.ascontiguousarray(x)
    if x.dtype not in (np.dtype("<f4"), np.dtype("<f8")):
        raise TypeError(f"arrays of {x.dtype}")
    if not len(x):
        return b""
    t = transform(name, x.dtype)
    if strict and len(x) > 65535:
        raise ValueError(f"{len(x)} values don't fit a 16-bit length")
    return struct.pack("<H" if strict else "<I", len(x)) + t.pack(x, default_scale(name) if scale is None else scale)


def decode(data: bytes, name: str, dtype: np.dtype | str, scale: float | None = None, strict: bool = False) -> np.ndarray:
    """The array of a framed payload."""
    dtype = np.dtype(dtype)
    if not data:
        return np.zeros(0, dtype)
    (n,) = struct.unpack_from("<H" if strict else "<I", data)
    return transform(name, dtype).unpack(data[2 if strict else 4 :], n, dtype, default_scale(name) if scale is None else scale)


# -- column forms -----------------------------------------------------------------------------------------------------


def cast32_column(x: Column) -> Column:
    return x.cast("float").cast("double")


def cast16_column(x: Column, scale: float) -> Column:
    """The scale is rounded to float32 first, as in the codec."""
    return F.least(F.lit(65535).cast("bigint"), F.floor(x * F.lit(float(f32(scale)))).cast("bigint"))


def log_column(x: Column, scale: float) -> Column:
    return F.floor(F.log2(x + 1) * F.lit(float(scale))).cast("bigint")


def log_inverse_column(q: Column, scale: float) -> Column:
    return F.pow(F.lit(2.0), q / F.lit(float(scale))) - 1


def delta_column(x: Column, previous: Column, scale: float, width: int) -> Column:
    """Clipped differences; null where there is no previous value."""
    top = F.lit((1 << width) - 1).cast("bigint")
    return F.least(top, F.greatest(F.lit(0).cast("bigint"), F.floor((x - previous) * F.lit(float(scale))).cast("bigint")))


def delta32_column(x: Column, previous: Column, scale: float) -> Column:
    """Difference and product in float32, as in the codec."""
    return F.floor((x - previous).cast("float") * F.lit(float(scale)).cast("float")).cast("bigint")


def adaptive_scale_column(most: Column, width: int) -> Column:
    """float32 of the quotient of two float32; without a positive difference 1."""
    quotient = (F.lit(float((1 << width) - 1)).cast("float") / most.cast("float")).cast("float")
    return F.when(most > 0, quotient).otherwise(F.lit(1.0).cast("float"))


def bits_column(peak: Column, threshold: float) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.log2(peak / F.lit(float(threshold)) + 1)).cast("int"))


def vbr_column(x: Column, peak: Column, bits: Column) -> Column:
    return F.floor(x / peak * (F.pow(F.lit(2.0), bits) - 1)).cast("bigint")


def vbr_inverse_column(q: Column, peak: Column, bits: Column) -> Column:
    return q * peak / (F.pow(F.lit(2.0), bits) - 1)


def bitpack_column(x: Column, scale: float) -> Column:
    return F.floor(F.least(F.lit(1.0), x / F.lit(float(scale))) * F.lit(float((1 << BITPACK_BITS) - 1))).cast("bigint")


def bitpack_inverse_column(q: Column, scale: float) -> Column:
    return q * F.lit(float(scale)) / F.lit(float((1 << BITPACK_BITS) - 1))


def array_delta_column(a: Column) -> Column:
    """Differences of neighbours of an array column."""
    return F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda j: F.get(a, j) - F.get(a, j - 1))


# -- Arrow functions --------------------------------------------------------------------------------------------------


def encode_udf(name: str, dtype: str = "<f8", scale: float | None = None):
    """array -> binary payload, an Arrow function."""
    t = np.dtype(dtype)

    @F.arrow_udf("binary")
    def encoded(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False).astype(t)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        stops = np.r_[0, np.cumsum(sizes)]
        ok = column.is_valid().to_pylist()
        return pa.array([encode(values[a:b], name, scale) if v else None for a, b, v in zip(stops, stops[1:], ok)], pa.binary())

    return encoded


def decode_udf(name: str, dtype: str = "<f8", scale: float | None = None):
    """binary payload -> array<double> (or float), an Arrow function."""
    t = np.dtype(dtype)
    kind = pa.float32() if t.itemsize == 4 else pa.float64()

    @F.arrow_udf(f"array<{'float' if t.itemsize == 4 else 'double'}>")
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x, name, t, scale) for x in column.to_pylist()], pa.list_(kind))

    return decoded


def register(spark) -> None:
    """SQL functions `<name>_encode` and `<name>_decode` (float64) for every transform."""
    for name in TRANSFORMS:
        spark.udf.register(f"{name}_encode", encode_udf(name))
        spark.udf.register(f"{name}_decode", decode_udf(name))
