"""Language ID by prediction by partial matching over bytes.

Each language has a context tree: for every context of 0 to ORDER bytes, how often each byte followed. A byte costs
-log2(count / (n + q)) bits in the longest context where it was seen (n bytes seen there, q different ones), after
-log2(q / (n + q)) bits for each longer known context it had to escape from (method C); a byte
seen nowhere costs 8 more. Statistics are frozen after fitting, so the cost of each (context, byte) is a
constant, worked out once for all languages, and scoring is a hash lookup per byte in vectors. The
language with the shortest exact code for the whole text wins; ties go to the first name.

Fitting uses a bounded sample: TRAIN_BYTES of text, shared evenly by the languages, in order of a hash of id and text,
equal rows once; of a row of over ROW_BYTES that many bytes are fitted on. Every language is learned, from one row at
least. The model has a cost for each context and language, so of more than MANY languages the sample shrinks in
proportion; that bounds the broadcast model. Prediction reads every whole text.

Null texts and texts without a letter get `und` and score 0, and so does everything if nothing was learned. Rows
with a null id are predicted but never learned from; rows that repeat an id are predicted row by row. Score: the winner's posterior under equal priors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, blobs, chunks, text_batches

ORDER = 4
TRAIN_BYTES = 8 << 20
ROW_BYTES = 1 << 20
MANY = 64
UNKNOWN = "und"
#: What stands before a text, so that its first bytes have contexts too.
START = b"\n" * ORDER


class Table:
    """Open addressing from 64-bit keys to row numbers, looked up in vectors."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys = np.zeros(size, np.uint64)
        self.rows = np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.rows[at[put]] = left[put]
            self.keys[at[put]] = keys[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._slot(keys)
        out = self.rows[at]
        todo = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        out[todo] = -1
        at, size = at[todo], len(self.rows)
        while len(todo):
            at = (at + 1) & (size - 1)
            row = self.rows[at]
            same = (self.keys[at] == keys[todo]) & (row >= 0)
            out[todo[same]] = row[same]
            on = ~same & (row >= 0)
            todo, at = todo[on], at[on]
        return out


def grams(texts: list[bytes], order: int = ORDER, before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts the byte with its `order` predecessors, as one integer; and the texts' lengths.

    before: what precedes each text, of `order` bytes; START by default."""
    before = before or [START[:order]] * len(texts)
    raw = np.frombuffer(b"".join(x for pair in zip(before, texts) for x in pair), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    key = np.zeros(max(0, len(raw) - order), np.uint64)
    for back in range(order + 1):
        key |= raw[order - back : len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    if len(texts) > 1:
        begins = np.cumsum(sizes + order)[:-1] - order
        keep = np.ones(len(key), bool)
        for k in range(order):
            keep[begins + k] = False
        key = key[keep]
    return key, sizes


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


@dataclass
class Model:
    """Costs in bits of (context, byte) pairs, and of escapes, by order, for all languages at once."""

    languages: list[str]
    order: int
    symbols: list[Table]  # [k]: a byte after k bytes
    costs: list[np.ndarray]  # [k]: languages x rows
    contexts: list[Table]
    escapes: list[np.ndarray]

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
        names = sorted(samples)
        full = []
        for name in names:
            key, _ = grams(samples[name], order)
            full.append(np.unique(key, return_counts=True))
        out = cls(names, order, [], [], [], [])
        for k in range(order + 1):
            by = []
            for keys, n in full:
                low, at = np.unique(keys & _mask(k + 1), return_inverse=True)
                by.append((low, np.bincount(at, n).astype(np.int64)))
            union = np.unique(np.concatenate([low for low, _ in by]))
            context = np.unique(union >> np.uint64(8))
            symbols, contexts = Table(union), Table(context)
            inside = contexts.find(union >> np.uint64(8))
            cost = np.zeros((len(names), len(union)))
            escape = np.zeros((len(names), len(context)))
            for i, (low, n) in enumerate(by):
                count = np.zeros(len(union))
                count[symbols.find(low)] = n
                total, kinds = np.bincount(inside, count, len(context)), np.bincount(inside, count > 0, len(context))
                known = total > 0
                escape[i, known] = -np.log2(kinds[known] / (total + kinds)[known])
                seen = count > 0
                cost[i, seen] = -np.log2(count[seen] / (total + kinds)[inside[seen]])
                lower = out.costs[k - 1][i, out.symbols[k - 1].find(union & _mask(k))] if k else 8.0
                cost[i, ~seen] = (escape[i, inside] + lower)[~seen]
            out.symbols.append(symbols)
            out.contexts.append(contexts)
            out.costs.append(cost)
            out.escapes.append(escape)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: languages x texts. Long texts are coded in parts, each with the bytes before it as context."""
        out = np.zeros((len(self.languages), len(texts)))
        owner, part, before = [], [], []
        for k, t in enumerate(texts):
            for at in range(0, max(len(t), 1), 2 * CHUNK_BYTES):
                owner.append(k)
                part.append(t[at : at + 2 * CHUNK_BYTES] if len(t) > 2 * CHUNK_BYTES else t)
                before.append(t[at - self.order : at] if at else START[: self.order])
        for a, b in chunks(part):
            np.add.at(out, (slice(None), np.array(owner[a:b])), self._bits(part[a:b], before[a:b]))
        return out

    def _bits(self, texts: list[bytes], before: list[bytes]) -> np.ndarray:
        out = np.zeros((len(self.languages), len(texts)))
        key, sizes = grams(texts, self.order, before)
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        begins = (np.cumsum(sizes) - sizes)[some]
        row = self.symbols[-1].find(key)
        new = np.flatnonzero(row < 0)
        text_of = np.searchsorted(np.cumsum(sizes), new, "right")
        row[new] = 0
        for i, cost in enumerate(self.costs[-1]):
            each = cost[row]
            each[new] = 0
            out[i, some] = np.add.reduceat(each, begins)
        key = key[new]
        add = lambda of, cost: np.bincount(of, cost, len(texts))
        for k in range(self.order, -1, -1):  # what no language has seen at this order escapes to the next
            if not len(key):
                return out
            if k < self.order:
                row = self.symbols[k].find(key & _mask(k + 1))
                hit = row >= 0
                for i, cost in enumerate(self.costs[k]):
                    out[i] += add(text_of[hit], cost[row[hit]])
                key, text_of = key[~hit], text_of[~hit]
            context = self.contexts[k].find((key >> np.uint64(8)) & _mask(k))
            known = context >= 0
            for i, escape in enumerate(self.escapes[k]):
                out[i] += add(text_of[known], escape[context[known]])
        return out + 8.0 * np.bincount(text_of, minlength=len(texts))

    def classify(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior, and bits per byte of its code."""
        bits = self.bits(texts)
        best = bits.argmin(axis=0)
        low = bits[best, np.arange(len(texts))]
        odds = np.exp2(np.maximum(low - bits, -1000)).sum(axis=0)
        size = np.maximum([len(t) for t in texts], 1)
        return [self.languages[i] for i in best], 1 / odds, low / size


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. Null ids: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(documents: DataFrame, total: int = TRAIN_BYTES, many: int = MANY) -> dict[str, list[bytes]]:
    """Texts to learn from, by language: at most `total` bytes, rows of the learning part, or one row of each language."""
    whole = F.col("text").cast("binary")
    learn = documents.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length(whole) > 0))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text")), 11) / F.lit(float(1 << 53))
    learn = learn.select(F.col("lang").cast("string").alias("lang"), draw.alias("draw"), F.substring(whole, 1, ROW_BYTES).alias("t"))
    sums = learn.groupBy("lang").agg(F.sum(F.length("t")).alias("n"), F.min("draw").alias("least")).collect()
    if not sums:
        return {}
    share = int(total * min(1.0, many / len(sums))) // len(sums)
    limits = documents.sparkSession.createDataFrame([(r.lang, max(r.least, 1.25 * share / r.n)) for r in sums], "lang string, most double")
    chosen = learn.join(F.broadcast(limits), "lang").filter("draw <= most").dropDuplicates(["lang", "draw"])
    out: dict[str, list[bytes]] = {r.lang: [] for r in sums}
    size = dict.fromkeys(out, 0)
    for r in sorted(chosen.select("lang", "draw", "t").collect(), key=lambda r: (r.draw, bytes(r.t))):
        if not size[r.lang] or size[r.lang] + len(r.t) <= share:
            size[r.lang] += len(r.t)
            out[r.lang].append(bytes(r.t))
    return out


def predict(text: Column, model: Model, spark) -> Column:
    """A struct of lang_pred, score and bits_per_byte for a text column."""
    held = spark.sparkContext.broadcast((model.languages, model.order, *[[vars(t) for t in x] for x in (model.symbols, model.contexts)], model.costs, model.escapes))
    cache: list[Model] = []

    def loaded() -> Model:
        if not cache:
            names, order, symbols, contexts, costs, escapes = held.value
            tables = [[Table.__new__(Table) for _ in x] for x in (symbols, contexts)]
            for made, state in zip((*tables[0], *tables[1]), (*symbols, *contexts)):
                vars(made).update(state)
            cache.append(Model(names, order, tables[0], costs, tables[1], escapes))
        return cache[0]

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    def classify(column: pa.Array, letters: pa.Array) -> pa.Array:
        texts = blobs(column)
        names, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
        at = np.flatnonzero(letters.to_numpy(zero_copy_only=False).astype(bool))
        if len(at) and loaded().languages:
            found, score[at], rate[at] = loaded().classify([texts[k] for k in at])
            for k, name in zip(at.tolist(), found):
                names[k] = name
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(rate)], ["lang_pred", "score", "bits_per_byte"])

    return classify.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def fit(documents: DataFrame, **bounds: int) -> Model:
    """Learn from the rows that aren't held out."""
    samples = sample(documents, **bounds)
    return Model.fit(samples) if samples else Model([], ORDER, [], [], [], [])


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    spark = documents.sparkSession
    text_batches(spark)
    found = predict(F.col("text"), fit(documents), spark)
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents in a language that was learned; columns unchanged.

    Rejected: texts that are null or have no letter, whose best posterior is under `least`, or whose best code
    isn't shorter than the plain bytes."""
    spark = documents.sparkSession
    text_batches(spark)
    found = predict(F.col("text"), fit(documents), spark)
    out = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), found.alias("p"))
    return out.filter((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least) & (F.col("p.bits_per_byte") < 8)).select("row.*")
