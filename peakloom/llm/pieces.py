"""SentencePiece segmentations: sampled from the piece lattice, and decoded without loss.

Encoding: spaces become U+2581 and one stands before the text, as SentencePiece does it. Every way to cover the text
with pieces is a path of a lattice. A piece of merge rank r has log-probability -ln(r + 2.7) (Zipf's law; the
vocabulary's own scores are only ranks), times `alpha`. Forward filtering sums the weights of all paths to every
position; backward sampling then draws a path from the end, each edge with its exact conditional probability. A character
without a piece of its own can fall back to its UTF-8 bytes, at a cost.

No piece reaches over the start of a run of spaces, nor over a character that only ever stands alone (a line feed, say), so
the lattice falls apart into segments. Each distinct segment is filtered once per chunk; all occurrences
are sampled together in vectors. The uniform numbers are a hash of (row key, place of the segment in the
text, step), so a row's segmentation depends on its key and text only: not on batch, partition or retry.

Decoding: the pieces' bytes in order, U+2581 back to a space, without the first. A literal U+2581 in a text is always
encoded as its three bytes, and bytes that aren't UTF-8 as byte pieces, so decode(encode(text)) is the text, for any text.

Null texts give null; empty texts give no pieces; null keys are a key like any other, rows with equal key and text get
equal segmentations. Texts of any length are encoded whole, long ones in parts that end between segments, which changes nothing.
Only one unbroken segment (no space, no line feed, no other character that stands alone) is filtered in one go, whatever its
length. Columns other than id and text aren't read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, text_batches

#: The public 32k model; any SentencePiece model with byte fallback will do.
MODEL = "piece_bpe_32k.model"
#: Code points that one chunk of texts has, about.
CHUNK = 1 << 18
ALPHA = 1.0
#: Natural log of what a fallback to bytes weighs, for each byte.
BYTE_WEIGHT = -14.0

_SPACE = 0x2581
_LITERAL = 0x110000  # stands for a U+2581 of the text itself
_RAW = 0xDC00  # surrogateescape: bytes that aren't UTF-8


def model_path(name: str = MODEL) -> str:
    """Where the installed public vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _slots(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


class Vocabulary:
    """Pieces as a trie, its edges in a hash table that is stepped in vectors; and as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.texts: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        pieces: list[tuple[str, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.texts[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.texts[i] = piece.replace(chr(_SPACE), " ").encode()
                pieces.append((piece, i))
        rank = {i: -sp.get_score(i) for _, i in pieces}
        self.weight = np.full(n, -1e9)
        for i, r in rank.items():
            self.weight[i] = -math.log(max(r, 0) + 2.7)
        self.longest = max(len(p) for p, _ in pieces)
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        for p, i in pieces:
            at = 0
            for c in p:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        self.first = np.full(_LITERAL + 1, -1, np.int32)
        for c, k in children[0].items():
            self.first[ord(c)] = k
        edges = sorted((s << 21 | ord(c), k) for s in range(1, len(children)) for c, k in children[s].items())
        self.edge_keys = np.array([e for e, _ in edges], np.uint64)
        self.edge_to = np.array([k for _, k in edges], np.int32)
        self._hash_edges()
        # characters that stand alone: in no piece of two or more
        joined = {c for p, _ in pieces if len(p) > 1 for c in p}
        self.alone = np.ones(_LITERAL + 1, bool)
        self.alone[[ord(c) for c in joined]] = False
        self.own = np.zeros(_LITERAL + 1, bool)  # has a piece of its own
        self.own[[ord(p) for p, _ in pieces if len(p) == 1]] = True
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)

    def _hash_edges(self) -> None:
        bits = max(4, int(8 * len(self.edge_keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.zeros(1 << bits, np.uint64)
        self.slot_to = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(self.edge_keys))
        at = _slots(self.edge_keys, self.shift)
        while len(left):
            free = np.flatnonzero(self.slot_to[at] < 0)
            _, k = np.unique(at[free], return_index=True)
            put = free[k]
            self.slot_key[at[put]], self.slot_to[at[put]] = self.edge_keys[left[put]], self.edge_to[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) % len(self.slot_to)

    def step(self, state: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """The next trie nodes, or -1."""
        key = state.astype(np.uint64) << np.uint64(21) | cp.astype(np.uint64)
        at = _slots(key, self.shift)
        out = self.slot_to[at]
        todo = np.flatnonzero((self.slot_key[at] != key) & (out >= 0))
        out[todo] = -1
        at = at[todo]
        while len(todo):
            at = (at + 1) % len(self.slot_to)
            found = self.slot_to[at]
            same = (self.slot_key[at] == key[todo]) & (found >= 0)
            out[todo[same]] = found[same]
            on = ~same & (found >= 0)
            todo, at = todo[on], at[on]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lattice(cp: np.ndarray, start: np.ndarray, size: np.ndarray, v: Vocabulary, alpha: float):
    """Forward filtering over distinct segments, which stand one after the other in cp.

    Of each node (a segment of n characters has n + 1): the cumulative probabilities of its incoming edges by
    length, and the pieces by length (-2 - position in cp: fallback to bytes)."""
    n = len(cp)
    seg_of = np.repeat(np.arange(len(start)), size)
    to_end = (start + size)[seg_of] - np.arange(n)
    deepest = int(min(v.longest, size.max()))
    piece = np.full((deepest, n), -1, np.int32)  # [length - 1, first character]
    at = np.arange(n)
    state = v.first[cp]
    for t in range(deepest):
        if t:
            live = to_end[at] > t
            at, state = at[live], state[live]
            state = v.step(state, cp[at + t])
        live = state >= 0
        at, state = at[live], state[live]
        if not len(at):
            piece = piece[: max(t, 1)]
            break
        piece[t, at] = v.ends[state]
    bare = np.flatnonzero(piece[0] < 0)
    piece[0, bare] = -2 - bare
    deepest = len(piece)
    # node of character i: i + segment; incoming edges of length t + 1 start t + 1 nodes earlier
    node = np.arange(n) + seg_of
    nodes = n + len(start)
    into = np.full((nodes, deepest), -1, np.int32)
    gain = np.full((nodes, deepest), -np.inf, np.float32)
    for t in range(deepest):  # one length at a time: weights of all lengths at once would take more than all else
        some = np.flatnonzero(piece[t] != -1)
        own = piece[t, some]
        into[node[some] + t + 1, t] = own
        gain[node[some] + t + 1, t] = alpha * v.weight[np.maximum(own, 0)]
    width = np.where(cp[bare] == _LITERAL, 3, np.where(cp[bare] < 0x80, 1, np.where(cp[bare] < 0x800, 2, np.where(cp[bare] < 0x10000, 3, 4))))
    gain[node[bare] + 1, 0] = BYTE_WEIGHT * width
    del piece
    total = np.zeros(nodes)
    first = start + np.arange(len(start))
    order = np.argsort(-size, kind="stable")
    first, longest = first[order], size[order]
    many = len(first)
    for j in range(1, int(longest[0]) + 1):
        while longest[many - 1] < j:
            many = int(np.searchsorted(-longest, -j, "right"))
        here = first[:many] + j
        reach = min(j, deepest)
        ways = gain[here, :reach] + total[here[:, None] - np.arange(1, reach + 1)]
        top = ways.max(axis=1)
        ways = np.exp(ways - top[:, None])
        summed = np.cumsum(ways, axis=1)
        total[here] = top + np.log(summed[:, -1])
        gain[here, :reach] = summed / summed[:, -1:]
        gain[here, reach:] = 1.0
    return gain, into, (start + size) + np.arange(len(start))


def _encode_chunk(texts: list[bytes], keys: np.ndarray, places: np.ndarray, v: Vocabulary, alpha: float, lead: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts one after the other, how many each text has, and how many segments. places: of their first segments.
    lead: whether a space is to stand before them; without it there is one text."""
    decoded = [t.decode("utf-8", "surrogateescape") for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in decoded), np.int64, len(decoded))
    cp = np.frombuffer(((" " if lead else "") + " ".join(decoded)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not lead:
        sizes -= 1
    ends = np.cumsum(sizes)
    begins = ends - sizes
    cp[cp == _SPACE] = _LITERAL
    cp[cp == 0x20] = _SPACE
    n = len(cp)
    space, alone = cp == _SPACE, v.alone[cp]
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[begins] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.r_[start, n])
    # distinct segments, by a rolling hash that is then verified
    base = np.uint64(0x9E3779B97F4A7C15)
    up = np.full(n + 1, base)
    up[0] = 1
    up = np.cumprod(up, dtype=np.uint64)
    down = np.full(n + 1, pow(int(base), -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.cumprod(down, dtype=np.uint64)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[:-1], out=acc[1:])
    h = _mix((acc[start + size] - acc[start]) * down[start]) ^ size.astype(np.uint64)
    del up, down, acc
    _, pick, kind = np.unique(h, return_index=True, return_inverse=True)
    inside = np.arange(n) - np.repeat(start, size)
    if (size[pick][kind] != size).any() or (cp[np.repeat(start[pick][kind], size) + inside] != cp).any():
        pick = kind = np.arange(len(start))  # a collision of 64-bit hashes: take every segment for itself
    u_size = size[pick]
    u_start = np.cumsum(u_size) - u_size
    source = np.repeat(start[pick] - u_start, u_size) + np.arange(int(u_size.sum()))
    chance, into, last = _lattice(cp[source], u_start, u_size, v, alpha)

    # backward sampling of all segments of all texts
    doc = np.searchsorted(ends, start, "right")
    heads = np.searchsorted(start, begins)
    place = np.arange(len(start)) - heads[doc] + places[doc]
    seed = _mix(_mix(keys[doc]) ^ place.astype(np.uint64))
    who, at, left = np.arange(len(start)), last[kind], size.copy()
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(start), np.int64)
    while len(who):
        u = ((_mix(seed + np.uint64(len(steps) + 1)) >> np.uint64(40)) / np.float32(1 << 24)).astype(np.float32)
        t = (chance[at] <= u[:, None]).sum(axis=1)  # u < 1, and the last edge there is ends at 1
        piece = into[at, t]
        steps.append((who, piece))
        count[who] += 1
        at = at - t - 1
        left = left - t - 1
        live = left > 0
        who, at, left, seed = who[live], at[live], left[live], seed[live]
    past = np.cumsum(count)
    out = np.empty(int(past[-1]), np.int64)
    for k, (who, piece) in enumerate(steps):
        out[past[who] - 1 - k] = piece
    doc_count = np.add.reduceat(count, np.searchsorted(start, begins))

    # fallbacks become the bytes of their characters
    bare = np.flatnonzero(out < -1)
    if len(bare):
        code = cp[source[-2 - out[bare]]]
        lone = (code >= _RAW + 0x80) & (code <= _RAW + 0xFF)
        made = [bytes([c - _RAW]) if raw else "▁".encode() if c == _LITERAL else chr(c).encode() for c, raw in zip(code.tolist(), lone.tolist())]
        width = np.ones(len(out), np.int64)
        width[bare] = [len(b) for b in made]
        spread = np.repeat(out, width)
        where = (np.cumsum(width) - width)[bare]
        flat = np.frombuffer(b"".join(made), np.uint8)
        w = width[bare]
        spread[np.repeat(where, w) + np.arange(len(flat)) - np.repeat(np.cumsum(w) - w, w)] = v.byte_ids[flat]
        edges = np.r_[0, np.cumsum(width)]
        stops = np.r_[0, np.cumsum(doc_count)]
        doc_count = np.diff(edges[stops])
        out = spread
    return out.astype(np.int32), doc_count, np.diff(np.r_[heads, len(start)])


def _parts(text: bytes, v: Vocabulary) -> Iterator[tuple[bytes, bool]]:
    """A long text, cut where segments begin, and whether a space is to stand before the part: at a run of spaces, without the
    first of them, or at a character that stands alone."""
    at, lead = 0, True
    while len(text) - at > 2 * CHUNK:
        low = at + CHUNK
        while True:  # look through the text in steps
            high = min(low + CHUNK, len(text))
            cut = text.find(b" ", low, high)
            while cut > 0 and text[cut - 1 : cut] == b" ":
                cut = text.find(b" ", cut + 1, high)
            if cut >= 0:
                yield text[at:cut], lead
                at, lead = cut + 1, True
                break
            a, b = low, high  # whole characters
            while a < b and text[a] & 0xC0 == 0x80:
                a += 1
            while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
                b -= 1
            window = text[a:b].decode("utf-8", "surrogateescape")
            cp = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            found = np.flatnonzero(v.alone[cp] & (cp != 0x20) & ((cp < _RAW) | (cp > _RAW + 0x3FF)))
            if len(found):
                cut = a + len(window[: found[0]].encode("utf-8", "surrogateescape"))
                yield text[at:cut], lead
                at, lead = cut, False
                break
            if high == len(text):
                yield text[at:], lead
                return
            low = high
    yield text[at:], lead


def encode_batch(texts: list[bytes | None], keys: np.ndarray, v: Vocabulary, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids and their number for each text (none for null and empty)."""
    done, counts = [], np.zeros(len(texts), np.int64)
    some = [k for k, t in enumerate(texts) if t]
    at = 0
    while at < len(some):
        stop, size = at, 0
        while stop < len(some) and (stop == at or size + len(texts[some[stop]]) <= CHUNK):
            size += len(texts[some[stop]])
            stop += 1
        own = some[at:stop]
        place = np.zeros(len(own), np.int64)
        for part, lead in [([texts[k] for k in own], True)] if len(own) > 1 else (([x], lead) for x, lead in _parts(texts[own[0]], v)):
            ids, n, segments = _encode_chunk(part, keys[own], place, v, alpha, lead)
            done.append(ids)
            counts[own] += n
            place = place + segments
        at = stop
    return (np.concatenate(done) if done else np.zeros(0, np.int32)), counts


def decode_batch(ids: np.ndarray, counts: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts of flat piece ids."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(v.sizes)):
        raise ValueError("no such piece")

    def joined(own: np.ndarray) -> tuple[bytes, np.ndarray]:
        size = v.sizes[own]
        past = np.cumsum(size)
        return v.bytes[np.arange(int(past[-1]) if len(past) else 0) + np.repeat(v.starts[own] - past + size, size)].tobytes(), np.r_[0, past]

    out: list[bytes] = []
    stops = np.r_[0, np.cumsum(counts)]
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(stops, stops[a] + CHUNK, "right")) - 1)
        if b == a + 1:  # perhaps a long text: in parts
            cuts = [*range(int(stops[a]), int(stops[b]), CHUNK), int(stops[b])]
            out.append(b"".join(joined(ids[x:y])[0] for x, y in zip(cuts, cuts[1:]))[1:])
        else:
            data, past = joined(ids[stops[a] : stops[b]])
            edge = past[stops[a : b + 1] - stops[a]].tolist()
            out += [data[x + 1 : y] for x, y in zip(edge, edge[1:])]
        a = b
    return out


def row_key(key: Column, seed: int = 0) -> Column:
    return F.xxhash64(key, F.lit(seed))


def encode(text: Column, key: Column, model: str | None = None, seed: int = 0, alpha: float = ALPHA) -> Column:
    """Piece ids (array of int) of a sampled segmentation, null for null."""
    path = model or model_path()

    @F.arrow_udf("array<int>")
    def sampled(column: pa.Array, keys: pa.Array) -> pa.Array:
        texts = blobs(column)
        ids, counts = encode_batch(texts, keys.to_numpy(zero_copy_only=False).view(np.uint64), vocabulary(path), alpha)
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[[t is None for t in texts], False].astype(bool))
        return pa.ListArray.from_arrays(offsets, pa.array(ids))

    return sampled.asNondeterministic()(text, row_key(key, seed))


def encode_checked(text: Column, key: Column, model: str | None = None, seed: int = 0, alpha: float = ALPHA) -> Column:
    """A struct of ids, as `encode` gives them, and lossless: whether `decode` makes the text of them again. Null for null.

    In one Arrow function: ids and texts don't travel twice, and a task holds one worker instead of two."""
    path = model or model_path()

    @F.arrow_udf("struct<ids: array<int>, lossless: boolean>")
    def checked(column: pa.Array, keys: pa.Array) -> pa.Array:
        texts = blobs(column)
        v = vocabulary(path)
        ids, counts = encode_batch(texts, keys.to_numpy(zero_copy_only=False).view(np.uint64), v, alpha)
        back = decode_batch(ids, counts, v)
        null = np.array([t is None for t in texts], bool)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
        same = pa.array([x == y for x, y in zip(texts, back)], pa.bool_())
        return pa.StructArray.from_arrays([lists, same], ["ids", "lossless"], mask=pa.array(null))

    return checked.asNondeterministic()(text, row_key(key, seed))


def decode(ids: Column, model: str | None = None) -> Column:
    """The text of piece ids (array of int), null for null."""
    path = model or model_path()

    @F.arrow_udf("binary")
    def text(column: pa.Array) -> pa.Array:
        counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = decode_batch(column.flatten().to_numpy(zero_copy_only=False), counts, vocabulary(path))
        return pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())], pa.binary())

    return text.asNondeterministic()(ids).cast("string")


def round_trips(documents: DataFrame, seed: int = 0, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit), decoded_sha256, lossless of every document.

    Encodes and decodes in one pass, so ids and texts don't travel twice."""
    import hashlib

    text_batches(documents.sparkSession)
    path = model or model_path()

    @F.arrow_udf("struct<n_pieces: bigint, pieces_sha256: string, decoded_sha256: string, lossless: boolean>")
    def trip(column: pa.Array, keys: pa.Array) -> pa.Array:
        texts = blobs(column)
        v = vocabulary(path)
        ids, counts = encode_batch(texts, keys.to_numpy(zero_copy_only=False).view(np.uint64), v)
        back = decode_batch(ids, counts, v)
        flat, stops = ids.astype("<i4").tobytes(), np.r_[0, 4 * np.cumsum(counts)].tolist()
        null = [t is None for t in texts]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        rows = [(None, None, None, None) if no else (n, sha(flat[a:b]), sha(y), x == y) for no, n, a, b, x, y in zip(null, counts.tolist(), stops, stops[1:], texts, back)]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])

    return documents.select("doc_id", trip.asNondeterministic()(F.col("text"), row_key(F.col("doc_id"), seed)).alias("t")).select("doc_id", "t.*")
