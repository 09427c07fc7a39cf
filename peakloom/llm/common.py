"""Helpers that the operators share: checkpoints on the shared folder, Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship

#: Rows in an Arrow batch that carries whole texts: a batch of long documents must fit a Python worker.
TEXT_BATCH_ROWS = "512"
#: Bytes of text that the vectorised kernels work on at once.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local master gets a temporary one; on a
    cluster that would be another folder on each machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="peakloom-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; else they wait for the driver's next
    garbage collection, and the steps of a long operator add up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder: computed once, columnar, lineage cut; deleted when the driver ends.

    With Spark's default codec: zstd's native buffers pile up outside the executors' heaps until a collection frees them."""
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark).rstrip('/')}/peakloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, for columns of whole texts; Python functions follow, so the package is sent too."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(TEXT_BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS)


def blobs(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, null as None; no decoding, so any bytes will do."""
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` bytes each; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def same_rows(df: DataFrame, fields: str) -> DataFrame:
    """An empty frame of this schema, for empty inputs."""
    return df.sparkSession.createDataFrame([], fields)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else touched, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't use yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def boundaries(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
