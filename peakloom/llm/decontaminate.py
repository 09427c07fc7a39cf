"""Benchmark decontamination by a broadcast hash set of word windows.

Words are runs of digits, letters a-z (A-Z lower-cased first) and non-ASCII characters, so they can be found in
UTF-8 bytes. A benchmark item gives every window of `size` consecutive words; an item of fewer words, but not none,
is one window. Windows are held as sorted 64-bit hashes, with places in the items' bytes; a scan of the documents
looks rolling hashes up in vectors and verifies each hit byte by byte, so a hash collision changes nothing.

The benchmark is measured before it is broadcast. If it has more than `bound` bytes, it is cut into blocks of at most
that size, and the documents are scanned once for each block; hits and items add up to the same result. So
neither the driver nor a worker holds more than a block, which takes HELD times its text.

Null and empty texts have no words and no hits. Items with null ids count for hits, not as items; repeated item ids
count once. Equal items are fine, and so are repeated documents. Documents of any length are scanned whole, in pieces cut
between words. Other columns, whatever their names, pass through; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, blobs, free_name, text_batches

SIZE = 10
#: Bytes of benchmark text that one broadcast may hold, and how many bytes a window set has at most for each
#: (a word of one byte and its space: 24 of hash, place and item, 8 of word limits, and the text), besides its masks.
BOUND = 8 << 20
HELD = 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = 0xFF51AFD7ED558CCD
_CLASS = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    n = 1 << max(16, (n - 1).bit_length())
    if n not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        ones = [np.full(n + 1, x, np.uint64) for x in (_BASE, inverse)]
        for x in ones:
            x[0] = 1
        _powers[n] = tuple(np.cumprod(x, dtype=np.uint64) for x in ones)
    return _powers[n]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _CLASS[raw]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return starts, ends, h


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut a long text between words."""
    at, most = 0, 4 * CHUNK_BYTES
    while len(data) - at > most:
        cut = at + most
        while cut < len(data) and _CLASS[data[cut]]:
            cut += 1
        yield at, data[at:cut]
        at = cut
    yield at, data[at:] if at else data


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of each window of `size` words."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(_STEP)
        out += h[j : j + n]
    return out


class WindowSet:
    """The windows of a bounded block of benchmark items, by number of words and hash: arrays, one row a window."""

    def __init__(self, items: list[tuple[object, bytes | None]], size: int = SIZE):
        self.size = size
        self.ids: list[object] = []
        texts, starts, ends, hashes, first, owner = [], [], [], defaultdict(list), defaultdict(list), defaultdict(list)
        at = words = 0
        for item, text in items:
            data = (text or b"").lower()
            a, b, h = _words(data)
            if not len(h):
                continue
            n = min(size, len(h))
            x = _windows(h, n)
            hashes[n].append(x)
            first[n].append(words + np.arange(len(x), dtype=np.uint32))
            owner[n].append(np.full(len(x), len(self.ids), np.uint32))
            texts.append(data)
            starts.append((a + at).astype(np.uint32))
            ends.append((b + at).astype(np.uint32))
            at, words = at + len(data), words + len(h)
            self.ids.append(item)
        self.data = b"".join(texts)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (starts, ends))
        #: number of words -> sorted hashes, first words, items
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.masks: dict[int, np.ndarray] = {}
        for n in list(hashes):
            x = np.concatenate(hashes.pop(n))
            order = np.argsort(x, kind="stable")
            self.windows[n] = x[order], np.concatenate(first.pop(n))[order], np.concatenate(owner.pop(n))[order]
            mask = np.zeros(1 << 20, bool)
            mask[x >> np.uint64(44)] = True
            self.masks[n] = mask

    def nbytes(self) -> int:
        """What the arrays hold, without the masks (a MB for each number of words)."""
        return len(self.data) + self.starts.nbytes + self.ends.nbytes + sum(a.nbytes for found in self.windows.values() for a in found)

    def _same(self, window: int, words: list[bytes]) -> bool:
        rows = slice(window, window + len(words))
        return all(self.data[a:b] == w for a, b, w in zip(self.starts[rows].tolist(), self.ends[rows].tolist(), words))

    def hits(self, h: np.ndarray, doc: np.ndarray | None, word) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, number of words, items) of each verified window. doc: the document of each word."""
        for n, (keys, first, owner) in self.windows.items():
            x = _windows(h, n)
            maybe = np.flatnonzero(self.masks[n][x >> np.uint64(44)])
            if doc is not None and len(maybe):
                maybe = maybe[doc[maybe] == doc[maybe + n - 1]]
            low = np.searchsorted(keys, x[maybe])
            some = keys[np.minimum(low, len(keys) - 1)] == x[maybe]
            maybe, low = maybe[some], low[some]
            high = np.searchsorted(keys, x[maybe], "right")
            for k, a, b in zip(maybe.tolist(), low.tolist(), high.tolist()):
                words = [word(i) for i in range(k, k + n)]
                if items := {int(owner[r]) for r in range(a, b) if self._same(int(first[r]), words)}:
                    yield k, n, items


def scan(texts: list[bytes | None], windows: WindowSet) -> tuple[np.ndarray, list[np.ndarray | None], list[set[int]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of each text: number of words; mask of words that were hit, or None; items; and of texts with hits the words' byte ranges."""
    n_words = np.zeros(len(texts), np.int64)
    masks: list[np.ndarray | None] = [None] * len(texts)
    items: list[set[int]] = [set() for _ in texts]
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def mark(k: int, first: int, n: int, found: set[int], starts, ends) -> None:
        if masks[k] is None:
            masks[k] = np.zeros(len(starts), bool)
            spans[k] = (starts, ends)
        masks[k][first : first + n] = True
        items[k] |= found

    def together(members: list[int]) -> None:
        data = b"\n".join([texts[k].lower() for k in members])
        starts, ends, h = _words(data)
        limits = np.cumsum([0, *[len(texts[k]) + 1 for k in members]])
        first = np.searchsorted(starts, limits)
        n_words[members] = np.diff(first)
        doc = np.repeat(np.arange(len(members)), np.diff(first))
        for w, n, found in windows.hits(h, doc, lambda i: data[starts[i] : ends[i]]):
            d = int(doc[w])
            a, b = int(first[d]), int(first[d + 1])
            mark(members[d], w - a, n, found, starts[a:b] - limits[d], ends[a:b] - limits[d])

    waiting: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) > 4 * CHUNK_BYTES:  # word by word in pieces, windows over the whole text
            data = text.lower()
            parts = [(at, *_words(piece)) for at, piece in _pieces(data)]
            starts = np.concatenate([at + s for at, s, _, _ in parts])
            ends = np.concatenate([at + e for at, _, e, _ in parts])
            h = np.concatenate([x for *_, x in parts])
            n_words[k] = len(h)
            for w, n, found in windows.hits(h, None, lambda i: data[starts[i] : ends[i]]):
                mark(k, w, n, found, starts, ends)
            continue
        if size and size + len(text) > CHUNK_BYTES:
            together(waiting)
            waiting, size = [], 0
        waiting.append(k)
        size += len(text) + 1
    if waiting:
        together(waiting)
    return n_words, masks, items, spans


def without_spans(text: bytes, mask: np.ndarray, span: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The text without the hit runs of words, and without the space that would be left double."""
    starts, ends = span
    turn = np.diff(np.r_[0, mask.view(np.int8), 0])
    out, at = [], 0
    for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
        if out[-1].endswith((b" ", b"\n")) and text[at : at + 1] == b" ":
            at += 1
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, item_id: str, text: str, bound: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark's rows in blocks of at most `bound` bytes (or one item)."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if total <= bound:
        yield [(r.i, bytes(r.t)) for r in rows.collect()]
        return
    parts = int(2 * total // bound) + 1
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(parts)))
    for b in range(parts):
        yield [(r.i, bytes(r.t)) for r in rows.filter(F.col("b") == b).select("i", "t").collect()]


def contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, bound: int = BOUND, clean: bool = False) -> DataFrame:
    """The documents with one more column: hits, a struct of n_words, n_hit, item_ids (sorted strings) and, with
    `clean`, the text without the hit spans. The column is named `hits`, or `hits_` if that is taken."""
    spark = documents.sparkSession
    text_batches(spark)
    name = free_name(documents, "hits")
    out, before = documents, None
    for block in _blocks(benchmark, item_id, item_text, bound):
        held = spark.sparkContext.broadcast(WindowSet(block, size))

        @F.arrow_udf("struct<n_words: bigint, n_hit: bigint, item_ids: array<string>, hit: array<int>, clean: binary>")
        def hits(column: pa.Array, earlier: pa.Array) -> pa.Array:
            texts = blobs(column)
            n_words, masks, items, spans = scan(texts, held.value)
            ids, hit, cleaned = [], [], []
            for k, past in enumerate(earlier.to_pylist()):
                mask, own = masks[k], {held.value.ids[i] for i in items[k]} - {None}
                if past and past["hit"]:
                    mask = np.zeros(n_words[k], bool) if mask is None else mask
                    mask[past["hit"]] = True
                ids.append(sorted(own | set(past["item_ids"] if past else ())))
                hit.append(None if mask is None else np.flatnonzero(mask).astype(np.int32))
                if clean and mask is not None:
                    span = spans.get(k) or tuple(map(np.concatenate, zip(*[(at + s, at + e) for at, p in _pieces(texts[k].lower()) for s, e, _ in [_words(p)]])))
                    cleaned.append(without_spans(texts[k], mask, span))
                else:
                    cleaned.append(texts[k] if clean else None)
            n_hit = [0 if x is None else len(x) for x in hit]
            return pa.StructArray.from_arrays(
                [pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(hit, pa.list_(pa.int32())), pa.array(cleaned, pa.binary())],
                ["n_words", "n_hit", "item_ids", "hit", "clean"],
            )

        past = F.lit(None).cast("struct<item_ids: array<string>, hit: array<int>>") if before is None else F.struct(f"{name}.item_ids", f"{name}.hit")
        out = out.withColumn(name, hits.asNondeterministic()(F.col(text), past))
        before = True
    fields = [F.col(f"{name}.{c}") for c in ("n_words", "n_hit", "item_ids")]
    if clean:
        fields.append(F.col(f"{name}.clean").cast("string").alias("clean"))
    return out.withColumn(name, F.struct(*fields))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    slim = contamination(documents.select("doc_id", "text"), benchmark)
    ids = F.col("hits.item_ids")
    return slim.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark window; columns unchanged."""
    found = contamination(documents, benchmark)
    return found.filter(F.col(f"{found.columns[-1]}.n_hit") == 0).select(*[f"`{c}`" for c in documents.columns])


def remove_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the hit spans cut out of their texts; columns unchanged."""
    found = contamination(documents, benchmark, text, clean=True)
    name = found.columns[-1]
    return found.select(*[F.col(f"{name}.clean").alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns])


def items_digest(ids: list[str]) -> str:
    """What items_sha256 holds for these item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
