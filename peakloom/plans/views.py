"""Stand-in views: the driver's tables read as spectra, peaks and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum headers: scan, ms_level, rt_days, precursor, and the rest of an order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("scan"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("ms_level"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint").alias("rt_days"),
        (F.col("o_totalprice") / 200).alias("precursor"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


#: The same view for the oracle.
HEADERS_SQL = """(select o_orderkey as scan, cast(substr(o_orderpriority, 1, 1) as int) as ms_level,
  cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) as rt_days, o_totalprice / 200 as precursor,
  o_orderstatus as status, o_totalprice as price from orders)"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks: scan, mz, intensity, and what tells rows apart."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("scan"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")


PEAKS_SQL = "(select l_orderkey as scan, l_extendedprice as mz, l_quantity as intensity, l_partkey, l_suppkey, l_linenumber, l_shipdate from lineitem)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals: values of a user, which sorted by value make an m/z axis."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", F.col("ts"))
