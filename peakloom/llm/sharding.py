"""Rendezvous hashing over weighted shards, with DataFrame functions only.

Each record scores every shard as -weight / ln(u), u a uniform hash of (key, shard), and goes
to the highest score. A record's place depends on its key and the shards alone, so another shard
takes records only into itself, and a heavier weight only draws records to its shard. Assignment is a narrow
projection: no shuffle, no state, the same on every retry.

Nulls: a null key is a key of its own (all null keys share a shard). Repeated keys share a shard. Empty
tables give empty results. Columns of the input are kept; names of new columns are the caller's choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins per shard that slots are numbered in: shards x BINS counts are broadcast, whatever the input.
BINS = 2048
#: Rows of one run of identical records that a task numbers at once.
RUN = 8192


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: arg max over shards k of -weights[k] / ln(u(key, k)); ties go to the lowest k.

    u comes from the upper 52 bits of XXH64 over the key and k, so it lies strictly between 0 and 1."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive, one for each shard")
    best = None
    for k, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        one = F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-k).alias("k"))
        best = one if best is None else F.greatest(best, one)
    return (-best["k"]).cast("int")


def number_slots(records: DataFrame, shard: str, slot: str, bins: int = BINS) -> DataFrame:
    """Number the records of each shard 0, 1, 2, ... without gaps, in order of a hash of the record.

    Equal records are counted first (a partial aggregate, so a record that holds a third of all rows shuffles
    as a few rows); bins of a shard get offsets from their counts, of which there are shards x bins whatever the
    input; runs of equal records then spread over tasks in pieces of RUN. Records must be slim (ids, digests)."""
    from pyspark.sql import Window as W

    cols = records.columns
    same = records.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    same = same.withColumn("_bin", F.pmod(F.xxhash64(*[F.col(c) for c in cols], F.lit("bin")), F.lit(bins)).cast("int"))
    sizes = same.groupBy(shard, "_bin").agg(F.sum("_n").alias("_size"))
    before = W.partitionBy(shard).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(shard).alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(shard, "_bin").orderBy(*[F.col(c).asc_nulls_first() for c in cols if c != shard]).rowsBetween(W.unboundedPreceding, -1)
    runs = same.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    runs = runs.join(F.broadcast(offsets), (F.col(shard) == F.col("_s")) & (F.col("_bin") == F.col("_b")))
    runs = runs.withColumn("_first", F.col("_off") + F.col("_at"))
    pieces = runs.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / RUN).cast("bigint"))))
    last = F.least(F.col("_n"), (F.col("_piece") + 1) * RUN) - 1
    return pieces.select(*cols, F.explode(F.sequence(F.col("_first") + F.col("_piece") * RUN, F.col("_first") + last)).alias(slot))


def shard_table(documents: DataFrame, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    weights = list(weights or [1.0] * shards)
    text = F.col("text")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
    )
    out = number_slots(rows, "shard", "slot")
    grown = shard_of(F.col("doc_id"), [*weights, 1.0])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))
