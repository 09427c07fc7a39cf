"""Aggregates, window forms and joins over spectra and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total_and_base(peaks: DataFrame, by: list[str], intensity: str = "intensity") -> DataFrame:
    """Total ion current in hundredths, base peak (at least 0) and number of peaks of each group.

    Sums are of whole hundredths, so they don't depend on the order of rows."""
    cents = F.round(F.col(intensity) * 100).cast("bigint")
    return peaks.groupBy(*by).agg(F.sum(cents).alias("tic_cents"), F.greatest(F.lit(0.0), F.max(intensity)).alias("base_peak"), F.count(F.lit(1)).alias("n_peaks"))


def _ln(value: Column) -> Column:
    """The natural logarithm, -inf of zero and NaN below it: Spark's is null there, and a sum would leave the value out."""
    return F.when(value == 0, F.lit(float("-inf"))).when(value < 0, F.lit(float("nan"))).otherwise(F.ln(value))


def heat_map(peaks: DataFrame, mz: Column, rt: Column, value: Column) -> DataFrame:
    """Cells (rounded m/z, rt): cube root of the sum of logarithms, rounded; a cell with a value of zero is -inf."""
    cells = peaks.groupBy(mz.alias("mz_bin"), rt.alias("rt_bin")).agg(F.sum(_ln(value)).alias("s"), F.count(F.lit(1)).alias("n"))
    return cells.select("mz_bin", "rt_bin", F.round(F.cbrt("s"), 6).alias("cell"), "n")


def carry_forward(df: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The latest non-null value so far in each group."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def row_ranges(df: DataFrame, by: str, start: str = "first", end: str = "end") -> DataFrame:
    """The half-open range of rows that each key takes if keys stand in order: prefix sums of counts."""
    from .prefix import running_total

    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, by, F.col("n"), start).select(by, start, (F.col(start) + F.col("n")).alias(end))


def deltas(df: DataFrame, by: str, order: list[str], value: str, name: str = "previous") -> DataFrame:
    """The value before this one in its spectrum."""
    return df.withColumn(name, F.lag(value).over(W.partitionBy(by).orderBy(*order)))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Rows of points and intervals with low <= point < high.

    Both sides meet on buckets of `width`: an equi-join on the buckets that an interval covers, instead of a nested loop."""
    covered = intervals.where(F.col(high) > F.col(low)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    own = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return own.join(covered, "_bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def interleave(pieces: DataFrame, by: str, order: list[str], text: str = "piece") -> DataFrame:
    """The pieces of each key, put together in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return pieces.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x[text]), "").alias("text"))


def chunks(df: DataFrame, key: str, content: str, n: int) -> DataFrame:
    """(key, chunk, piece): content in n equal pieces, the remainder in the last (the external source)."""
    size = F.floor(F.length(content) / n).cast("int")
    rows = df.select(key, content, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"))
    take = F.when(F.col("chunk") == n - 1, F.length(content) - size * (n - 1)).otherwise(size)
    return rows.select(key, "chunk", F.substring(F.col(content), size * F.col("chunk") + 1, take).alias("piece"))


def validate(left: DataFrame, right: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """Compares tables by key: rows on one side only, and for each column the values further apart than its tolerance."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).withColumn("_a", F.lit(1))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]).withColumn("_b", F.lit(1))
    both = a.join(b, keys, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    apart = [count(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > t)).alias(f"{c}_apart") for c, t in columns.items()]
    return both.agg(F.count(F.lit(1)).alias("n_rows"), count(F.col("_b").isNull()).alias("only_left"), count(F.col("_a").isNull()).alias("only_right"), *apart)
