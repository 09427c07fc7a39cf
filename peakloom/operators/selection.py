"""Choosing spectra: by index, scan number or level, and range lists such as `[1-5,8]`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that one range list may name.
MOST = 1_000_000


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a list literal: digits, commas and spaces; `a-b` inside brackets is a range, outside two values.

    Values must increase strictly and number at most MOST; anything else raises ValueError."""
    out: list[tuple[int, int]] = []
    inside = False
    number = ""
    low: int | None = None

    def end() -> None:
        nonlocal number, low
        if number:
            high = int(number)
            first = high if low is None else low
            if first > high:
                raise ValueError(f"range {first}-{high} runs backwards")
            if out and first <= out[-1][1]:
                raise ValueError("values must increase strictly")
            out.append((first, high))
        elif low is not None:
            raise ValueError("a range has no end")
        number, low = "", None

    for c in text:
        if c.isascii() and c.isdigit():
            number += c
        elif c == "-" and inside:
            if not number or low is not None:
                raise ValueError("a range has no beginning")
            low, number = int(number), ""
        elif c in "[],- ":
            end()
            if c == "[" and inside or c == "]" and not inside:
                raise ValueError("brackets don't match")
            inside = c == "[" or inside and c != "]"
        else:
            raise ValueError(f"{c!r} in a range list")
    end()
    if inside:
        raise ValueError("brackets don't match")
    if sum(b - a + 1 for a, b in out) > MOST:
        raise ValueError(f"over {MOST} values")
    return out


def range_values(spark: SparkSession, ranges: list[tuple[int, int]], name: str) -> DataFrame:
    """One row for each value of the ranges, generated on executors."""
    rows = spark.createDataFrame(ranges or [], "lo bigint, hi bigint")
    return rows.select(F.explode(F.sequence("lo", "hi")).alias(name))


def in_ranges(column: Column, ranges: list[tuple[int, int]]) -> Column:
    """A predicate that reaches the scan, for a few ranges."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | (column.between(a, b) if a != b else column == a)
    return out


def by_ranges(df: DataFrame, column: str, ranges: list[tuple[int, int]], few: int = 64) -> DataFrame:
    """Rows whose column lies in the ranges: a pushed-down predicate for a few ranges, else a semi join.

    A list has at most MOST values, so its side is small enough to broadcast."""
    if len(ranges) <= few:
        return df.where(in_ranges(F.col(column), ranges))
    return df.join(F.broadcast(range_values(df.sparkSession, ranges, column)), column, "left_semi")


def by_scans(df: DataFrame, wanted: DataFrame, scan: str = "scan") -> DataFrame:
    """Rows whose scan is wanted; Catalyst picks the join by the size of the other side."""
    return df.join(wanted.select(scan).distinct(), scan, "left_semi")


def missing_scans(df: DataFrame, wanted: DataFrame, scan: str = "scan") -> DataFrame:
    """Wanted scans that no row has."""
    return wanted.select(scan).distinct().join(df, scan, "left_anti")


def by_level(df: DataFrame, level: int | str) -> DataFrame:
    """Rows of a level; "n" means above 2."""
    if level == "n":
        return df.where(F.col("ms_level") > 2)
    if not str(level).isdigit() or int(level) < 1:
        raise ValueError(f"no level: {level!r}")
    return df.where(F.col("ms_level") == int(level))


def select_spectra(df: DataFrame, indices: str | None = None, scans: str | None = None, level: int | str | None = None) -> DataFrame:
    """One selection at most; two or more raise ValueError, since no order among them is evident."""
    if sum(x is not None for x in (indices, scans, level)) > 1:
        raise ValueError("choose by indices, by scans or by level")
    if indices is not None:
        return by_ranges(df, "index", parse_ranges(indices))
    if scans is not None:
        return by_ranges(df, "scan", parse_ranges(scans))
    return by_level(df, level) if level is not None else df


def first_match(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window as W

    return df.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each key with their rank; Spark prunes to k rows before the shuffle."""
    from pyspark.sql import Window as W

    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("int")).where(F.col("rank") <= k)
