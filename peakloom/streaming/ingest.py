"""Streams: new documents of a folder as they appear, and ion currents in windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.session import ship
from ..sources import mzml

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of the documents in a folder, as a stream: each file is read once."""
    ship(spark)
    order = mzml.COLUMNS

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows = [{"file": file, **r, "index": k} for k, r in enumerate(mzml.scan_document(bytes(data)))]
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in order})

    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path)
    return files.select("path", "content").mapInPandas(run, mzml.SCHEMA)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is new in a folder to a Parquet table, then stop; run again for what came later."""
    rows = stream_documents(spark, path).drop("xml")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_current(events: DataFrame, ts: str, value: Column, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sum in hundredths and count by tumbling window; rows later than the watermark are dropped from a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, every).alias("w")).agg(F.sum(F.round(value * 100).cast("bigint")).alias("tic_cents"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("hour_start"), "tic_cents", "n")
