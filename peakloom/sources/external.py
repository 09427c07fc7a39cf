"""Opaque files: cut into equal pieces, and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import file_type
from ..operators.analysis import chunks


def read_chunks(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, chunk, piece): every file in n equal pieces, the remainder in the last."""
    if n < 1:
        raise ValueError("at least one piece")
    return chunks(spark.read.format("binaryFile").load(path), "path", "content", n)


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind): document, container or external, of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", file_type(F.col("content")).alias("kind"))


def byte_range(df: DataFrame, content: str, offset: int, length: int) -> DataFrame:
    """`length` bytes of a binary column from `offset`."""
    return df.withColumn("bytes", F.substring(content, offset + 1, length))
