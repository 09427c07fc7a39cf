"""SimHash near-duplicates: exact search within a Hamming radius by bit-sliced comparison.

1. Fingerprints: words are runs of non-space bytes after A-Z is lower-cased; shingles of `width` words
   joined by one space (fewer words: the whole sequence; none: fingerprint 0); XXH64 with seed 42; a
   bit is set if set in over half of the hashes, repeats included.
2. Equal fingerprints collapse to one row (partial aggregate, so groups of copies shuffle as a few rows).
3. Candidates by nested pigeonhole. Two fingerprints within `radius` = 3 bits agree on one of four 16-bit blocks,
   and on one of four 12-bit slices of the other 48 bits. So 16 keys of 28 bits each lose no pair.
4. A key with more than BLOCK fingerprints is dealt into chunks, and each pair of chunks is a group of its
   own: no task ever gets more than about 2 BLOCK fingerprints of a key at once, and none is dropped.
5. Within sorted partitions the fingerprints stand as vertical bit planes, 64 to a machine word. A query
   is compared with 64 of them at once: XOR with its bit, carry-save add into a two-bit counter, overflow means
   over the radius. Every 8 planes, (query, block) pairs of which all lanes are over the radius are abandoned.
6. Each group yields a spanning star of links, not all pairs; components settle by star contraction.

Null or empty texts have fingerprint 0 and link like any other. A null doc_id is kept; component_id is the
smallest non-null doc_id of the component (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, blobs, boundaries, checkpoint, chunks, free_name, text_batches
from .graph import components

RADIUS = 3
#: Fingerprints of one key that one group holds; larger keys are dealt into pairs of chunks.
BLOCK = 512
SEED = 42
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bit_sums(hashes: list[int], first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, from each of the `first` places to the next."""
    all_hashes = np.array(hashes, np.uint64)
    sums = np.zeros((len(first), 64), np.int64)
    for j in range(8):  # one byte of the hashes at a time keeps the unpacked bits small
        byte = (all_hashes >> np.uint64(8 * j)).astype(np.uint8)
        bits = np.unpackbits(byte[:, None], axis=1, bitorder="little")
        sums[:, 8 * j : 8 * j + 8] = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return sums


def _shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """Hashes of all runs of `width` words."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def _long_fingerprint(text: bytes, width: int) -> np.uint64 | None:
    """The fingerprint of a long text, a part at a time; None if it has no more words than a shingle."""
    sums, n, at, held = np.zeros(64, np.int64), 0, 0, []
    while at < len(text):
        stop = min(len(text), at + CHUNK_BYTES)
        while stop < len(text) and not text[stop : stop + 1].isspace():
            stop += 1
        words = held + text[at:stop].lower().split()
        at = stop
        if len(words) >= width:
            hashes = _shingle_hashes(words, width)
            sums += _bit_sums(hashes, np.zeros(1, np.int64))[0]
            n += len(hashes)
        held = words[max(0, len(words) - width + 1) :]
    return np.packbits(2 * sums > n, bitorder="little").view("<u8")[0] if n else None


def _fingerprint_chunk(texts: list[bytes], width: int) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_BYTES and (long := _long_fingerprint(texts[0], width)) is not None:
        return np.array([long], np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= width:
            hashes.append(digest(b" ".join(words), SEED))
            counts[k] = 1
            continue
        hashes += _shingle_hashes(words, width)
        counts[k] = len(words) - width + 1
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        sums = _bit_sums(hashes, np.r_[0, np.cumsum(counts[full])[:-1]])
        over = (2 * sums > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints of UTF-8 texts."""
    whole = [t or b"" for t in texts]
    parts = [_fingerprint_chunk(whole[a:b], width) for a, b in chunks(whole)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def simhash(text: Column, width: int = 3) -> Column:
    """Fingerprint of a text column, as a signed bigint."""

    @F.arrow_udf("bigint")
    def fingerprint(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints_of(blobs(column), width).view(np.int64))

    return fingerprint.asNondeterministic()(text)


def _keys(fp: Column) -> list[Column]:
    """The 16 keys: number (4 bits), 16-bit block, 12-bit slice of the rest."""
    out = []
    for a in range(4):
        block = F.shiftrightunsigned(fp, 16 * a).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * a) - 1) if a else F.lit(0).cast("bigint")
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * (a + 1)), 16 * a)) if a < 3 else low
        for b in range(4):
            piece = F.shiftrightunsigned(rest, 12 * b).bitwiseAND(0xFFF)
            out.append(F.shiftleft(block, 16).bitwiseOR(F.shiftleft(piece, 4)).bitwiseOR(F.lit(4 * a + b)))
    return out


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of one group within the radius. Rows of a group stand together.

    The bit-sliced kernel; radius 0 to 3 (counters have two bits)."""
    if not 0 <= radius <= 3:
        raise ValueError("the counters hold radii up to 3")
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fps
    planes = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.ascontiguousarray(np.packbits(planes, axis=1, bitorder="little")).view("<u8")  # (64, words)

    edges = boundaries(group)
    end_of = np.repeat(edges[1:], np.diff(edges))  # end of each row's group
    at = np.arange(n)
    first, last = (at + 1) // 64, (end_of - 1) // 64  # words with lanes of rows i + 1 .. end - 1
    many = np.where(end_of > at + 1, last - first + 1, 0)
    query = np.repeat(at, many)
    word = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + first[query]
    lo = np.clip(query + 1 - word * 64, 0, 63).astype(np.uint64)
    hi = np.clip(end_of[query] - word * 64, 1, 64).astype(np.uint64)
    alive = (_ONES << lo) & (_ONES >> (np.uint64(64) - hi))
    over = ~alive
    one = np.zeros(len(query), np.uint64)
    two = np.zeros(len(query), np.uint64)
    bits = fps[query]
    for b in range(64):
        mask = np.uint64(0) - ((bits >> np.uint64(b)) & np.uint64(1))
        differs = planes[b, word] ^ mask
        carry = one & differs
        one ^= differs
        over |= two & carry
        two ^= carry
        if b % 8 == 7:
            keep = over != _ONES
            if not keep.all():
                query, word, over, one, two, bits = (x[keep] for x in (query, word, over, one, two, bits))
                if not len(query):
                    break
    if radius < 3:
        bound = {0: one | two, 1: two, 2: two & one}[radius]
        over |= bound
    left = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(left)
    return query[pair], word[pair] * 64 + lane


def _stars(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a group joins: each row to the first row of its local component."""
    i, j = close_pairs(fps, group, radius)
    label = np.arange(len(fps))
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _link_batches(radius: int, rows: int = 1 << 15):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(final: bool) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
            table = np.concatenate(held)
            cut = boundaries(table[:, 0])
            # the last group may go on in the next batch
            stop = len(table) if final else int(cut[-2])
            keep = [table[stop:]]
            part, sizes = table[:stop], np.diff(cut if final else cut[:-1])
            part = part[np.repeat(sizes > 1, sizes)]
            if not len(part):
                return keep, None
            u, v = _stars(part[:, 1].view(np.uint64), part[:, 0], radius)
            return keep, pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += len(held[-1])
            if size >= rows:
                held, out = flush(False)
                size = len(held[0])
                if out is not None:
                    yield out
        if size:
            _, out = flush(True)
            if out is not None:
                yield out

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join whatever lies within the radius."""
    entries = distinct.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key"))
    hot = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = hot.select("key", F.ceil(F.col("n") / block).cast("int").alias("c"))
    dealt = entries.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("c")).cast("int")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda x: x != mine),
        lambda x: F.xxhash64(F.col("key"), F.least(x, mine), F.greatest(x, mine)),
    )
    group = F.explode(F.when(F.col("c").isNull(), F.array(F.xxhash64("key"))).otherwise(pairs))
    rows = dealt.select(group.alias("group"), "fp").repartition("group").sortWithinPartitions("group", "fp")
    return rows.mapInArrow(_link_batches(radius), "u bigint, v bigint")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row_hash, fingerprint, component_id, kept) for each row of df, as slim rows.

    component_id: the smallest doc_id reachable by links. kept: whether (doc_id, row_hash) is the one that
    stands for its component; identical rows share it. row_hash: XXH64 of the text."""
    text_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row_hash"), simhash(F.col(text), width).alias("fp"))
    rows = checkpoint(rows)
    classes = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_hash")).alias("least"))
    joined = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    named = rooted.join(heads, "root").select("fp", "head")
    out = rows.join(named, "fp")
    return out.select(
        "doc_id",
        "row_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row_hash") == F.col("head.row_hash"))).alias("kept"),
    )


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of near-duplicates, all columns unchanged.

    The text stays where it is until one semi join by (doc_id, hash of the text). Rows that repeat both are
    told apart only if there are any: then a second aggregate keeps the one whose other columns, as JSON, come first."""
    found = near_duplicates(df, text, doc_id)
    heads = found.filter("kept").groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    heads = checkpoint(heads)
    h = free_name(df, "_row_hash")
    out = df.withColumn(h, F.xxhash64(text))
    match = out[doc_id].eqNullSafe(heads["doc_id"]) & (out[h] == heads["row_hash"])
    out = out.join(heads, match, "left_semi")
    if not heads.filter("n > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        one = out.groupBy(F.col(doc_id).alias("_k"), F.col(h).alias("_h")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
        return one.select("_row.*")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
