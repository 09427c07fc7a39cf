"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words (as they stand, split at spaces). A later line goes if an earlier line has a Jaccard
similarity of at least THRESHOLD percent with it; lines are ordered by (doc_id, two hashes of id and text, place in the text).

1. Words are counted over all lines in BINS hash bins; the order of words is by the level of the bin's count, then by hash.
   Any order shared by all lines gives the same result, so bins and levels only cost selectivity, and their table, the
   one thing that reaches the driver, is of fixed size.
2. Lines with equal sets collapse to a class with the position of its first line; copies are decided by that alone.
3. Prefix filter: of two similar sets the larger shares one of its rarest n - ceil(t n) + 1 words with the rarest
   m - ceil(2 t m / (1 + t)) + 1 words of the smaller. Each class emits those words with its size, the word's place, and a
   parity signature (one bit a word, XOR-ed): two signatures differ in no more bits than the sets differ in words. Two semi
   joins on the word under length, positional and signature filters leave the classes that have a candidate at all, and
   the words where they have it: first the larger (or equal) members, then the smaller ones, which only meet the former.
4. Only those lines are read again with all their words, and verified: against the earliest class of each word where
   they meet, one pair each; and what that leaves open by a second semi join on the same words, with the exact similarity
   as its condition. Semi joins look for one partner and stop: the pairs of a group are never emitted.

Both sides of each join come straight from a shuffle or a stored table, so adaptive execution can split the probing side
where a word is hot; the other side of a hot word is read again by each part, spilled where it doesn't fit, and never emitted.

Empty lines and lines of spaces are kept and never compared. Null and empty texts stay as they are. Rows that repeat id
and text are decided alike; rows that share an id, null ids included, are told apart by their texts. Null ids come first
in the order. Ids may be of any type that Spark orders and hashes. Other columns, whatever their names, pass through. A
document keeps its other lines; `text` without a single word left is dropped by `deduplicate`. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: Percent.
THRESHOLD = 80
BINS = 1 << 17
#: Sets of up to SHORT words have a signature of 64 bits, of up to LONG words one of 128 bits, larger ones of 256: as long as
#: half the bits are clearly more than two similar sets may differ in.
SHORT, LONG = 80, 192
#: The largest size.
MOST = (1 << 31) - 1
SIGNATURES = ("s1", "s2", "s3", "s4")
#: Bytes of slim rows that may be broadcast as keys, by their count; beyond that they are joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: Spark's setting for the rows that an aggregation's generated hash map holds, as a power of 2.
FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def _levels(documents: DataFrame, bins: int) -> Column:
    """A literal array: how frequent the words of each bin are, two levels for each doubling of their count."""
    words = documents.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(bins - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    conf = documents.sparkSession.conf
    was = conf.get(FAST_MAP)
    conf.set(FAST_MAP, str(min(30, max(int(was), bins.bit_length()))))  # all bins in the generated hash map
    try:
        found = counts.select("bin", F.floor(2 * F.log2(F.col("n") + 1)).cast("int").alias("level")).toArrow()
    finally:
        conf.set(FAST_MAP, was)
    level = np.zeros(bins, np.int64)
    level[found["bin"].to_numpy()] = found["level"].to_numpy()
    return F.from_json(F.lit(str(level.tolist())), "array<bigint>")


def _keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a row's id and text."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit("second"), doc_id, text)


def _lines(documents: DataFrame) -> DataFrame:
    """(at, line): every line that has a word, and its place in the order of all lines: doc_id, t1, t2, line_no."""
    t1, t2 = _keys(F.col("doc_id"), F.col("text"))
    whole = documents.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.split("text", "\n").alias("lines"))  # hashed once a text, not a line
    # outer: else Spark checks first that there is a line at all, and splits each text twice more for that; null texts go with the blank lines
    made = whole.select("doc_id", "t1", "t2", F.posexplode_outer("lines").alias("line_no", "line"))
    return made.filter(F.trim("line") != "").select(F.struct("doc_id", "t1", "t2", "line_no").alias("at"), "line")


def _words(line: Column, levels: Column, bins: int) -> Column:
    """The line's set as sorted integers, rarest first: level of the word's bin above, 56 bits of its hash below."""
    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    hashes = F.array_remove(hashes, F.xxhash64(F.lit("")))  # numbers are cheaper to compare than strings
    # without a null in its type the array is sorted as plain numbers; no casts: each is a call for every word
    level = lambda h: F.coalesce(levels[h.bitwiseAND(bins - 1)], F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(level(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _parity(words: Column) -> Column:
    one = F.lit(1).cast("bigint")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))))


def _signatures(words: Column, n: Column) -> list[Column]:
    """Parity of 64 places for sets of up to SHORT words, of 128 up to LONG, of 256 above: s1 .. s4, the rest 0.

    A word's place among fewer is its place among more, modulo their number, so longer signatures fold by XOR."""

    def part(k: int, size: int) -> Column:
        return _parity(F.filter(words, partial(lambda k, x: F.shiftrightunsigned(x, 6).bitwiseAND(size - 1) == k, k)))

    zero = F.lit(0).cast("bigint")
    least = [_parity(words), zero, zero, zero]
    return [F.when(n <= SHORT, least[k]).when(n <= LONG, part(k, 2) if k < 2 else zero).otherwise(part(k, 4)).alias(f"s{k + 1}") for k in range(4)]


def _positional(x: str, y: str, t: int) -> Column:
    """Whether sets that are similar meet at these places: within the prefixes that their sizes leave, and with enough words
    before and after in common."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(x, "n") + c(y, "n")
    prefixes = ((100 + t) * (c(x, "n") - c(x, "i")) >= t * both) & ((100 + t) * (c(y, "n") - c(y, "i")) >= t * both)
    most = F.least(c(x, "i"), c(y, "i")) + 1 + F.least(c(x, "n") - 1 - c(x, "i"), c(y, "n") - 1 - c(y, "i"))
    return prefixes & ((100 + t) * most >= t * both)


def _xor(side: str, names: tuple[str, ...]) -> Column:
    out = F.col(f"{side}.{names[0]}")
    for name in names[1:]:
        out = out.bitwiseXOR(F.col(f"{side}.{name}"))
    return out


def _close(x: str, y: str, t: int) -> Column:
    """Length and signature filters between two sets."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m, both = c(x, "n"), c(y, "n"), c(x, "n") + c(y, "n")
    length = (100 * m >= t * n) & (100 * n >= t * m)

    def fits(*parts: tuple[str, ...]) -> Column:
        bits = [F.bit_count(_xor(x, p).bitwiseXOR(_xor(y, p))) for p in parts]
        return (100 + t) * reduce(lambda a, b: a + b, bits) <= (100 - t) * both

    some = (n <= SHORT) | (m <= SHORT) | fits(("s1", "s3"), ("s2", "s4"))
    many = (n <= LONG) | (m <= LONG) | fits(("s1",), ("s2",), ("s3",), ("s4",))
    return length & fits(SIGNATURES) & some & many


def _prefix(words: Column, n: Column, t: int) -> Column:
    """The words that a set can meet a smaller or equal one at; none where no other set is similar enough."""
    least = -(-t // (100 - t)) if t < 100 else MOST
    return F.slice(words, 1, F.when(n < least, 0).otherwise(n - F.ceil(n * t / 100) + 1).cast("int"))


def _classes(documents: DataFrame, levels: Column, bins: int, t: int) -> DataFrame:
    """(k1, k2, first, n, signatures, p) of each distinct set: hash, first place, size, signatures, prefix."""
    made = _lines(documents).withColumn("w", _words(F.col("line"), levels, bins)).withColumn("n", F.size("w"))
    made = made.select(
        "at",
        F.xxhash64("w").alias("k1"),
        F.xxhash64(F.lit("second"), "w").alias("k2"),
        "n",
        *_signatures(F.col("w"), F.col("n")),
        _prefix(F.col("w"), F.col("n"), t).alias("p"),
    )
    made = made.groupBy("k1", "k2", "n", *SIGNATURES, "p").agg(F.min("at").alias("first"))
    return made.sortWithinPartitions("n")  # a band of sizes skips the pages of the others


def _similar(x: str, y: str, t: int) -> Column:
    """Jaccard similarity of two sets of at least t percent, in whole numbers."""
    return (100 + t) * F.size(F.array_intersect(x, y)) >= t * (F.size(x) + F.size(y))


def _small(rows: DataFrame, most: int) -> DataFrame:
    """Rows of fixed-width columns with a hint to broadcast them, if they were counted and take no more than `most` bytes."""
    return F.broadcast(rows) if rows.count() * (8 * len(rows.columns) + 48) <= most else rows


#: Bands of the smaller member's size, and the signatures that are compared in each: longer ones fold into shorter ones.
BANDS = (
    (1, SHORT, ("s1 ^ s2 ^ s3 ^ s4",)),
    (SHORT + 1, LONG, ("s1 ^ s3", "s2 ^ s4")),
    (LONG + 1, MOST, SIGNATURES),
)


def _meetings(classes: DataFrame, t: int, broadcast_bytes: int) -> DataFrame:
    """(k1, word) of the classes that have another one behind the filters, and the words where they meet.

    One band of sizes after the other, so that rows carry no more signatures than they need and shuffle files of one band
    at a time are on disk."""
    met = []
    for low, high, signatures in BANDS:
        own = [F.expr(x).alias(f"g{k}") for k, x in enumerate(signatures)]
        entries = classes.filter((F.col("n") >= low) & (F.col("n") <= min(MOST, 100 * high // t))).select("k1", "n", *own, F.posexplode("p").alias("i", "word"))
        short = entries.filter((F.col("n") <= high) & ((100 + t) * (F.col("n") - F.col("i")) >= 2 * t * F.col("n")))
        bits = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.g{k}").bitwiseXOR(F.col(f"y.g{k}"))) for k in range(len(own))])
        both = F.col("x.n") + F.col("y.n")
        meet = (F.col("x.word") == F.col("y.word")) & (F.col("x.k1") != F.col("y.k1")) & ((100 + t) * bits <= (100 - t) * both) & _positional("x", "y", t)
        larger = (F.col("y.n") <= F.col("x.n")) & (100 * F.col("y.n") >= t * F.col("x.n"))
        smaller = (F.col("y.n") > F.col("x.n")) & (t * F.col("y.n") <= 100 * F.col("x.n"))
        found = stored(entries.alias("x").join(short.alias("y"), larger & meet, "left_semi"))
        here = short.join(_small(found.select("word").distinct(), broadcast_bytes), "word", "left_semi")
        met += [found.select("k1", "word"), here.alias("x").join(found.alias("y"), smaller & meet, "left_semi").select("k1", "word")]
    return reduce(DataFrame.union, met).distinct()


def kept_lines(documents: DataFrame, threshold: int = THRESHOLD, bins: int = BINS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(t1, t2, kept): of each document with a kept line its keys (see _keys) and the numbers of its kept lines, ascending.

    Lines without a word aren't listed. Needs doc_id and text."""
    t = threshold
    documents = documents.select("doc_id", "text")
    levels = _levels(documents, bins)
    classes = stored(_classes(documents, levels, bins, t))
    met = stored(_meetings(classes, t, broadcast_bytes))

    # their lines again, now with all words
    found = stored(met.select("k1").distinct())
    place = [F.col(f"first.{c}").alias(c) for c in ("t1", "t2", "line_no")]
    wanted = stored(classes.join(_small(found, broadcast_bytes), "k1", "left_semi").select("k1", "k2", "n", *SIGNATURES, *place))
    mine = _small(wanted.select("t1", "t2").distinct(), broadcast_bytes)
    t1, t2 = _keys(F.col("doc_id"), F.col("text"))
    whole = documents.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.split("text", "\n").alias("lines")).join(mine, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    places = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("line_no", "k1", "k2", "n", *SIGNATURES)).alias("own"))
    full = whole.join(places, ["t1", "t2"]).select("doc_id", "t1", "t2", "lines", F.explode("own").alias("c"))
    full = full.select("c.k1", "c.k2", F.struct("doc_id", "t1", "t2", "c.line_no").alias("first"), "c.n", *[f"c.{x}" for x in SIGNATURES], F.get("lines", F.col("c.line_no")).alias("line"))
    full = stored(full.withColumn("line", _words(F.col("line"), levels, bins)).withColumnRenamed("line", "w"))

    # an earlier class that is really similar. The earliest class of a word is tried first: in a cluster that settles nearly
    # all with one pair each. What it leaves open, and has another candidate, is joined with all of them.
    slim = full.drop("w")
    sides = stored(met.join(slim, "k1"))
    words = full.select("k1", "k2", "w")

    def verified(pairs: DataFrame) -> DataFrame:
        """k1, k2 of the pairs' first members that are similar to the second."""
        mine = pairs.join(words.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("w").alias("xw")), ["x1", "x2"])
        both = mine.join(words.select(F.col("k1").alias("y1"), F.col("k2").alias("y2"), F.col("w").alias("yw")), ["y1", "y2"])
        return both.where(_similar("xw", "yw", t)).select(F.col("x1").alias("k1"), F.col("x2").alias("k2")).distinct()

    low = stored(sides.groupBy("word").agg(F.min(F.struct("first", "k1", "k2", "n", *SIGNATURES)).alias("low")).select("word", "low.*"))
    before = (F.col("x.word") == F.col("y.word")) & (F.col("y.first") < F.col("x.first")) & _close("x", "y", t)
    pairs = sides.alias("x").join(low.alias("y"), before).select(*[F.col(f"{s}.{k}").alias(f"{s}{k[1]}") for s in "xy" for k in ("k1", "k2")]).distinct()
    settled = stored(verified(pairs))
    rest = sides.join(settled, ["k1", "k2"], "left_anti")
    rest = stored(rest.alias("x").join(sides.alias("y"), before, "left_semi"))
    others = sides.join(rest.select("word").distinct(), "word", "left_semi").join(words, ["k1", "k2"])
    found = rest.join(words, ["k1", "k2"]).alias("x").join(others.alias("y"), before & _similar("x.w", "y.w", t), "left_semi").select("x.k1", "x.k2")
    later = stored(settled.union(found.distinct()))
    kept = classes.select("k1", "k2", *place).join(_small(later, broadcast_bytes), ["k1", "k2"], "left_anti")
    return kept.groupBy("t1", "t2").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, kept_lines of every document: its lines with a word, how many stay, their numbers."""
    own = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    t1, t2 = _keys(F.col("doc_id"), F.col("text"))
    rows = documents.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.when(F.col("text").isNull(), 0).otherwise(own).alias("n_lines"))
    out = rows.join(kept_lines(documents), ["t1", "t2"], "left")
    stays = F.coalesce("kept", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size(stays).cast("bigint").alias("n_kept"), F.array_join(stays.cast("array<string>"), ",").alias("kept_lines"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents without the lines that repeat an earlier one; those that lose all their words go. Columns unchanged."""
    names = [free_name(documents, c) for c in ("_t1", "_t2", "_kept", "_lines")]
    kept = kept_lines(documents).toDF(*names[:3])
    a, b, k, lines = (F.col(c) for c in names)
    t1, t2 = _keys(documents["doc_id"], documents["text"])
    out = documents.join(kept, (t1 == a) & (t2 == b), "left")
    out = out.withColumn(names[3], F.split(documents["text"], "\n"))  # a column: inside the lambdas it would be split for each line
    blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(F.get(lines, i)) == "")
    text = F.array_join(F.transform(F.sort_array(F.concat(k, blank)), lambda i: F.get(lines, i)), "\n")
    had = F.trim(F.replace(documents["text"], F.lit("\n"), F.lit(" "))) != ""
    out = out.filter(k.isNotNull() | ~F.coalesce(had, F.lit(False)))
    return out.select(*[F.when(k.isNotNull(), text).otherwise(documents[c]).alias(c) if c == "text" else documents[f"`{c}`"] for c in documents.columns])
