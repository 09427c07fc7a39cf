"""Prefix scans, numbering and partitions of a whole table, without sending it through one task.

A window over a whole table needs one task for all rows. Instead the (numeric) order key is cut into BINS ranges of
equal width; sums inside a range are a window over that range, sums of ranges a window over BINS rows at most, which are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1024


def _bin(df: DataFrame, key: str, bins: int) -> Column:
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return F.lit(0)
    # as doubles: never out of range, and in order, which is all that bins need
    place = (F.col(key).cast("double") - F.lit(float(low))) / F.lit(max(float(high) - float(low), 1e-300)) * bins
    return F.when(F.col(key).isNull(), -1).otherwise(F.least(F.floor(place), F.lit(bins - 1)).cast("int"))


def running_total(df: DataFrame, key: str, value: Column, name: str, ties: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """df with the sum of `value` over all rows before this one in order of key (then ties); nulls of key come first."""
    rows = df.withColumn("_bin", _bin(df, key, bins)).withColumn("_value", value)
    before = W.partitionBy("_bin").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    sums = rows.groupBy("_bin").agg(F.sum("_value").alias("_sum"))
    earlier = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_bin").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    out = rows.join(F.broadcast(sums), F.col("_bin") == F.col("_b"))
    return out.select(*df.columns, (F.col("_off") + F.col("_in")).cast("bigint").alias(name))


def global_index(df: DataFrame, key: str, name: str = "index", ties: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """df with 0, 1, 2, ... in order of key: the order of appearance."""
    return running_total(df, key, F.lit(1).cast("bigint"), name, ties, bins)


def equal_count_divisions(df: DataFrame, key: str, n: int, name: str = "division_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """n divisions of floor(N / n) rows each; the last takes the remainder. More divisions than rows: one row each."""
    total = df.count()
    n = max(1, min(n, total))
    rows = global_index(df, key, "_index", ties)
    return rows.select(*df.columns, F.least(F.lit(n - 1), F.floor(F.col("_index") / max(1, total // n))).cast("int").alias(name))


def byte_divisions(df: DataFrame, key: str, size: Column, target: int, name: str = "division_id") -> DataFrame:
    """Divisions of about `target` bytes: the prefix sum of sizes, divided."""
    return running_total(df, key, size, "_before").select(*df.columns, F.floor(F.col("_before") / target).cast("int").alias(name))
