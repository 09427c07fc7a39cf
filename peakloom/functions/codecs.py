"""Byte codecs: base64 and zlib of documents, block compression of containers."""

from __future__ import annotations

import base64
import binascii
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# Accessions of element types, source compressions and block codecs.
ELEMENT_TYPES = {1000519: "<i4", 1000520: "<f2", 1000521: "<f4", 1000522: "<i8", 1000523: "<f8"}
ZLIB, NO_COMPRESSION = 1000574, 1000576
BLOCK_CODECS = {"zstd": 4700001, "lz4": 4700012, "none": 4700012}
#: `none` and `lz4` share an accession in the layout above; this engine's own containers tell them apart by name.
LEVELS = {"zstd": (1, 22), "lz4": (1, 12), "none": (0, 22)}
DEFAULT_LEVEL = 3


def codec_name(name: str) -> str:
    name = {"nocomp": "none"}.get(name, name)
    if name not in BLOCK_CODECS:
        raise ValueError(f"unknown codec: {name!r}; one of zstd, lz4, none (nocomp)")
    return name


def check_level(name: str, level: int) -> int:
    low, high = LEVELS[codec_name(name)]
    if not low <= level <= high:
        raise ValueError(f"{name} has levels {low} to {high}, not {level}")
    return level


def compressor(name: str, level: int = DEFAULT_LEVEL) -> Callable[[bytes], bytes]:
    """A function that compresses blocks; make one for each partition, its context is reused."""
    name = codec_name(name)
    check_level(name, level)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress
    if name == "lz4":
        return lambda data: pa.compress(data, codec="lz4_raw", asbytes=True)
    return bytes


def decompressor(name: str) -> Callable[[bytes, int], bytes]:
    """(compressed, original size) -> data; a wrong size is an error."""
    name = codec_name(name)
    if name == "zstd":
        import zstandard

        context = zstandard.ZstdDecompressor()
        raw = lambda data, size: context.decompress(data, max_output_size=size)
    elif name == "lz4":
        raw = lambda data, size: pa.decompress(data, decompressed_size=size, codec="lz4_raw", asbytes=True) if size else b""
    else:
        raw = lambda data, size: bytes(data)

    def checked(data: bytes, size: int) -> bytes:
        out = raw(data, size)
        if len(out) != size:
            raise ValueError(f"a block has {len(out)} bytes, not {size}")
        return out

    return checked


def decode_binary(text: bytes | str, dtype: str, compression: int = NO_COMPRESSION) -> np.ndarray:
    """The numbers of a <binary> element: base64, perhaps zlib. Empty text: no numbers."""
    try:
        raw = base64.b64decode(text, validate=False)
    except binascii.Error as e:
        raise ValueError(f"bad base64: {e}") from None
    if compression == ZLIB and raw:
        raw = zlib.decompress(raw)
    return np.frombuffer(raw, dtype)


def encode_binary(values: np.ndarray, compression: int = NO_COMPRESSION) -> bytes:
    """The text of a <binary> element; no numbers: empty."""
    raw = values.tobytes()
    if not raw:
        return b""
    return base64.b64encode(zlib.compress(raw) if compression == ZLIB else raw)


def decode_binary_udf(dtype: str, compression: int = NO_COMPRESSION):
    """Text of a <binary> element -> array<double>."""

    @F.arrow_udf("array<double>")
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode_binary(x, dtype, compression).astype(float) for x in column.to_pylist()], pa.list_(pa.float64()))

    return decoded


def encode_binary_udf(dtype: str, compression: int = NO_COMPRESSION):
    """array -> text of a <binary> element."""

    @F.arrow_udf("string")
    def encoded(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encode_binary(np.array(x, dtype), compression).decode() for x in column.to_pylist()], pa.string())

    return encoded


def compress_udf(name: str, level: int = DEFAULT_LEVEL):
    """binary -> compressed binary."""

    @F.arrow_udf("binary")
    def compressed(column: pa.Array) -> pa.Array:
        run = compressor(name, level)
        return pa.array([None if x is None else run(x) for x in column.to_pylist()], pa.binary())

    return compressed


def decompress_udf(name: str):
    """(compressed binary, original size) -> binary."""

    @F.arrow_udf("binary")
    def plain(column: pa.Array, size: pa.Array) -> pa.Array:
        run = decompressor(name)
        return pa.array([None if x is None else run(x, n) for x, n in zip(column.to_pylist(), size.to_pylist())], pa.binary())

    return plain
