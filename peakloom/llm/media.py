"""Media columns: chroma fingerprints of audio, and alignment of recordings by them.

1. Audio (WAV bytes, or raw 16-bit mono PCM) becomes frames of FRAME samples, half of them new each time; the power
   spectrum folds into 12 pitch classes, and each frame is scaled to unit length.
2. Over the frames x 12 image an integral image is kept, so that the sum of any rectangle takes four lookups. Sixteen
   filters (rectangle against rectangle, in time, in pitch, or in a checkerboard; sizes by rule) compare log sums; each
   gives two bits (Gray code of four levels). Together they pack into one 32-bit integer for every frame position.
3. Equal fingerprints collapse to a class (its smallest id). The queries are broadcast, in slices; every query meets every
   class at every offset, as a cross-correlation of their bits by Fourier transforms, so no alignment is missed.
4. What comes near the limit is counted exactly: bit errors over the overlap of both fingerprints, at most MAX_BER of the
   bits, the overlap at least MIN_OVERLAP. Of a pair's alignments the one with most votes (identical integers) stays.

Work grows with queries times classes; rows don't. Null or too short audio has an empty fingerprint, is a class of its own
kind and matches nothing. Ties between offsets go to the smaller share of bit errors, then to the smaller absolute, then
smaller, offset. A null id is kept as a member, never a query.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship
from .common import checkpoint, text_batches

RATE = 4000
FRAME = 1024
#: Levels between which a filter's log ratio falls, and the longest filter in frames.
LEVELS = (-0.35, 0.0, 0.35)
SPAN = 8
MIN_OVERLAP = 16
MAX_BER = 0.2
#: Positions of queries that are broadcast at once, and numbers that the correlation works on at once.
SLICE = 1 << 22
CHUNK = 1 << 21
#: Audio takes much room: rows in an Arrow batch that carries it.
AUDIO_ROWS = 256

_LOW = 110.0  # lowest pitch that counts, in Hz


def samples(data: bytes | None, rate: int = RATE) -> tuple[np.ndarray, int]:
    """Mono samples in -1 .. 1, and their rate. Channels of a WAV are averaged."""
    if not data:
        return np.zeros(0), rate
    if data[:4] == b"RIFF":
        with wave.open(io.BytesIO(data)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
        if width == 1:
            x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        elif width in (2, 4):
            x = np.frombuffer(raw, f"<i{width}").astype(float) / (1 << 8 * width - 1)
        else:
            raise ValueError(f"{8 * width}-bit WAV")
        return x.reshape(-1, channels).mean(axis=1), rate
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(float) / 32768, rate


def chroma(x: np.ndarray, rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Frames x 12 pitch classes (0 is A), each frame of unit length (silence: zeros). x: samples, or rows of samples."""
    hop = frame // 2
    n = (x.shape[-1] - frame) // hop + 1
    if n < 1:
        return np.zeros((*x.shape[:-1], 0, 12))
    windows = np.lib.stride_tricks.sliding_window_view(x, frame, axis=-1)[..., ::hop, :] * np.hanning(frame)
    power = np.abs(np.fft.rfft(windows)) ** 2
    pitch = np.arange(frame // 2 + 1) * rate / frame
    use = pitch >= _LOW
    fold = np.zeros((len(pitch), 12))
    fold[np.flatnonzero(use), np.round(12 * np.log2(pitch[use] / 440)).astype(int) % 12] = 1
    out = power @ fold
    size = np.sqrt((out**2).sum(axis=-1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def filters() -> list[tuple[str, int, int, int]]:
    """(kind, pitch class, height, width) of the sixteen filters, by rule."""
    kinds = ("pitch", "time", "checker", "middle")
    return [(kinds[k % 4], 3 * k % 12 if k % 4 else k % 12, (2, 4, 6, 12)[(k + k // 4) % 4] if k % 4 != 3 else 3 + k // 4, (SPAN, SPAN // 2, SPAN, SPAN // 2)[k // 4]) for k in range(16)]


def fingerprint_frames(image: np.ndarray) -> np.ndarray:
    """Packed integers (rows x positions, uint32) of chroma images (rows x frames x 12)."""
    rows, n, _ = image.shape
    m = n - SPAN + 1
    if m < 1:
        return np.zeros((rows, 0), np.uint32)
    wide = np.concatenate([image, image], axis=2)  # pitch classes go round
    total = np.zeros((rows, n + 1, 25))
    total[:, 1:, 1:] = wide.cumsum(axis=1).cumsum(axis=2)

    def box(t: int, y: int, width: int, height: int) -> np.ndarray:
        part = total[:, t : t + m], total[:, t + width : t + width + m]
        return part[1][..., y + height] - part[0][..., y + height] - part[1][..., y] + part[0][..., y]

    out = np.zeros((rows, m), np.uint32)
    for kind, y, height, width in filters():
        half, low = width // 2, height // 2
        if kind == "pitch":
            a, b = box(0, y, width, low), box(0, y + low, width, height - low)
        elif kind == "time":
            a, b = box(0, y, half, height), box(half, y, width - half, height)
        elif kind == "checker":
            a = box(0, y, half, low) + box(half, y + low, half, height - low)
            b = box(0, y + low, half, height - low) + box(half, y, half, low)
        else:
            third = width // 4
            a, b = box(third, y, width - 2 * third, height), box(0, y, third, height) + box(width - third, y, third, height)
        level = np.digitize(np.log((a + 0.05) / (b + 0.05)), LEVELS)
        out = out << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[level]
    return out


def fingerprint(audio: Column, rate: int = RATE) -> Column:
    """Fingerprint (array of int) of an audio column; empty for null and for audio shorter than the filters."""

    @F.arrow_udf("array<int>")
    def packed(column: pa.Array) -> pa.Array:
        loaded = [samples(x, rate) for x in column.to_pylist()]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(loaded)
        by: dict[tuple[int, int], list[int]] = {}
        for k, (x, r) in enumerate(loaded):
            by.setdefault((len(x), r), []).append(k)
        for (_, r), members in by.items():
            for a in range(0, len(members), 32):  # equally long recordings go through the transforms together
                own = members[a : a + 32]
                made = fingerprint_frames(chroma(np.stack([loaded[k][0] for k in own]), r))
                for k, f in zip(own, made):
                    out[k] = f.view(np.int32)
        return pa.array(out, pa.list_(pa.int32()))

    return packed.asNondeterministic()(audio)


def _spectra(prints: list[np.ndarray], n: int) -> np.ndarray:
    """Transforms (frequencies x fingerprints x 32) of the bits as -1 and 1, zero past the end."""
    bits = np.zeros((len(prints), n, 32), np.float32)
    for k, p in enumerate(prints):
        bits[k, : len(p)] = 2.0 * np.unpackbits(p.view(np.uint8)).reshape(-1, 32) - 1
    return np.fft.rfft(bits, axis=1).transpose(1, 0, 2)


def _chunks(prints: list[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """Numbers of fingerprints long enough to align, by length: up to `most`, fewer if long, none over twice as long as another."""
    size = np.array([len(p) for p in prints], int)
    held: list[int] = []
    for k in np.argsort(size, kind="stable").tolist():
        if size[k] < MIN_OVERLAP:
            continue
        if held and (len(held) >= most or size[k] > 2 * size[held[0]] or (len(held) + 1) * size[k] * 64 > 2 * CHUNK):
            yield np.array(held)
            held = []
        held.append(k)
    if held:
        yield np.array(held)


def alignments(asked: list[np.ndarray], others: list[np.ndarray], max_ber: float = MAX_BER) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(number in asked, number in others, offset, votes, overlap, bit errors) of each pair that aligns, at its best offset.

    All offsets are tried. The correlation over an overlap of L integers is 32 L less twice the bit errors; it selects with a
    margin far above its rounding, and what it selects is counted bit by bit."""
    for left in _chunks(asked, 128):
        size_a = np.array([len(asked[k]) for k in left])
        for right in _chunks(others, 128):
            size_b = np.array([len(others[k]) for k in right])
            n = 1 << int(size_a[-1] + size_b[-1] - 1).bit_length()
            low, high = int(size_a[-1]) - MIN_OVERLAP, int(size_b[-1]) - MIN_OVERLAP
            offset = np.arange(-low, high + 1)
            spectra = _spectra([others[k] for k in right], n)
            step = max(1, CHUNK // (n * len(right)))
            for first in range(0, len(left), step):
                own = left[first : first + step]
                product = np.matmul(_spectra([asked[k] for k in own], n).conj(), spectra.transpose(0, 2, 1))
                corr = np.fft.irfft(product, n, axis=0)[offset % n]
                la, lb = (x[:1] if x[0] == x[-1] else x for x in (size_a[first : first + step], size_b))
                overlap = np.minimum((la + np.minimum(offset, 0)[:, None])[:, :, None], (lb - np.maximum(offset, 0)[:, None])[:, None])
                least = 32 * (1 - 2 * max_ber) * overlap - 1 - 1e-3 * 32 * min(size_a[-1], size_b[-1])
                near = corr >= np.where(overlap >= MIN_OVERLAP, least, np.inf).astype(np.float32)
                best: dict[tuple[int, int], tuple] = {}
                for o, i, j in np.argwhere(near).tolist():
                    at = int(offset[o])
                    x, y = asked[own[i]][max(-at, 0) :], others[right[j]][max(at, 0) :]
                    length = min(len(x), len(y))
                    x = x[:length] ^ y[:length]
                    errors, votes = int(np.bitwise_count(x.view(np.uint32)).sum(dtype=np.int64)), length - int(np.count_nonzero(x))
                    if round(errors / (32 * length), 6) <= max_ber:
                        rank = votes, -errors / length, -abs(at), -at, length, errors
                        best[i, j] = max(best.get((i, j), rank), rank)
                for (i, j), (votes, _, _, back, length, errors) in best.items():
                    yield int(own[i]), int(right[j]), -back, votes, length, errors


def search(classes: DataFrame, max_ber: float = MAX_BER) -> DataFrame:
    """(asked, class_id, offset, votes, overlap, bit_errors) of every query among the classes (columns class_id, query, fp)."""
    spark = classes.sparkSession
    ship(spark)
    usable = classes.filter(F.size("fp") >= MIN_OVERLAP)
    wanted = usable.filter("query")
    slices = -(-(wanted.agg(F.sum(F.size("fp"))).first()[0] or 0) // SLICE)
    kind = classes.schema["class_id"].dataType.simpleString()
    schema = f"asked {kind}, class_id {kind}, offset int, votes bigint, overlap int, bit_errors bigint"
    tasks = max(2 * spark.sparkContext.defaultParallelism, classes.rdd.getNumPartitions())
    usable = usable.select("class_id", "fp").repartition(tasks)

    def prints(column: pa.Array) -> list[np.ndarray]:
        flat = column.flatten().to_numpy()
        return np.split(flat, np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []

    def slice_of(k: int) -> DataFrame:
        table = wanted.filter(F.pmod(F.xxhash64("class_id"), F.lit(slices)) == k).select("class_id", "fp").toArrow().combine_chunks()
        names = table.column(0).to_pylist()
        held = spark.sparkContext.broadcast((names, prints(table.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = held.value
            for batch in batches:
                own = batch.column(0).to_pylist()
                found = [(names[i], own[j], *rest) for i, j, *rest in alignments(asked, prints(batch.column(1)), max_ber) if names[i] != own[j]]
                types = [batch.schema.field(0).type] * 2 + [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                columns = zip(*found) if found else [()] * len(types)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["asked", "class_id", "offset", "votes", "overlap", "bit_errors"])

        return usable.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for k in range(slices):
        out = out.unionByName(slice_of(k))
    return out


def align(recordings: DataFrame, queries: Column, max_ber: float = MAX_BER) -> DataFrame:
    """Matches of the queries among all recordings (columns id, fp).

    Rows: (kind, id, class_id, offset, votes, overlap, bit_errors, ber). kind `member`: recording `id` belongs to class
    `class_id` (equal fingerprints, named by the smallest id). kind `match`: class `id`, which holds a query, aligns with class
    `class_id` if moved by `offset` positions."""
    rows = checkpoint(recordings.select("id", "fp", queries.alias("query")))
    key = F.xxhash64("fp", F.lit(1)), F.xxhash64("fp", F.lit(2))
    rows = rows.withColumn("k1", key[0]).withColumn("k2", key[1])
    classes = rows.filter("id is not null").groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.max(F.coalesce("query", F.lit(False))).alias("query"), F.any_value("fp").alias("fp"))
    classes = checkpoint(classes)
    members = rows.join(classes.select("k1", "k2", "class_id"), ["k1", "k2"], "left").select("id", "class_id")

    pairs = search(classes, max_ber).withColumn("ber", F.round(F.col("bit_errors") / (F.col("overlap") * 32), 6))
    null = lambda t: F.lit(None).cast(t)
    return members.select(F.lit("member").alias("kind"), "id", "class_id", *[null(t).alias(n) for n, t in (("offset", "int"), ("votes", "bigint"), ("overlap", "int"), ("bit_errors", "bigint"), ("ber", "double"))]).unionByName(
        pairs.select(F.lit("match").alias("kind"), F.col("asked").alias("id"), "class_id", "offset", "votes", "overlap", "bit_errors", "ber")
    )


def sonify(vector: Column, note: int = 512, rate: int = RATE) -> Column:
    """A media column made of vectors: element k sounds for `note` samples as a tone whose pitch is its value.

    16-bit mono PCM; 24 semitones from 220 Hz up cover -0.3 .. 0.3, which is where elements of 64-dimensional unit vectors
    lie; null and empty vectors are silence of no length."""

    @F.arrow_udf("binary")
    def audio(column: pa.Array) -> pa.Array:
        t = np.arange(note) / rate
        pitch = 220 * 2 ** (np.arange(24) / 12)
        tones = 0.6 * np.sin(2 * np.pi * pitch[:, None] * t) + 0.2 * np.sin(4 * np.pi * pitch[:, None] * t)
        table = np.round(tones * 32767).astype("<i2")
        out = []
        for v in column.to_pylist():
            values = np.array([0.0 if x is None or x != x else x for x in v or ()])
            step = np.clip(np.floor((values + 0.3) * 40), 0, 23).astype(int)
            out.append(table[step].tobytes())
        return pa.array(out, pa.binary())

    return audio.asNondeterministic()(vector)


def align_vectors(embeddings: DataFrame) -> DataFrame:
    """Sonify every vector, fingerprint the audio, and align the recordings whose id is divisible by 100 with all."""
    spark = embeddings.sparkSession
    text_batches(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > AUDIO_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(AUDIO_ROWS))
    media = embeddings.select(F.col("vec_id").alias("id"), sonify(F.col("embedding")).alias("audio"))
    return align(media.select("id", fingerprint(F.col("audio")).alias("fp")), F.col("id") % 100 == 0)
