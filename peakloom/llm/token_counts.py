"""Token counts of documents in flat token files without an index.

A flat file is nothing but little-endian token ids, each document followed by the end-of-document id. Blocks of a
fixed number of tokens, cut wherever they fall, are searched for that id in one vector comparison each. A
block knows nothing of the blocks before it, so a prefix scan stitches them: from each block's number of
tokens and of separators and its last separator come the global offset, the ordinal of its first document and
where that began, perhaps many blocks earlier. The scan has two levels (blocks within a span of SPAN blocks, then
spans), so no task ever holds all blocks of a long file.

What follows the last separator of a file counts as one more document, `closed` false. Empty files have no
documents; a separator right after another closes a document of 0 tokens. A file of a length that isn't a
multiple of the token size raises an error.

Of a table of documents only `doc_id` (cast to bigint) and `text` are read, whatever other columns are called. Each row is a
document of its own: null and repeated ids and repeated texts give as many rows. An empty table has no documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blobs, checkpoint, text_batches

BLOCK_TOKENS = 1 << 19
SPAN = 256
#: Bytes of flat files that one task reads, about.
TASK_BYTES = 128 << 20
#: Hadoop's names of the file systems that Arrow opens by itself.
ARROW_SCHEMES = {"hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
#: The byte-level vocabulary, and the id that it leaves free for the end of a document.
RANKS = "byte_bpe_50k.tiktoken"
EOD = 50256

_BLOCKS = "file string, block bigint, payload binary, ids array<bigint>"
_FOUND = "file string, block bigint, n bigint, seps array<int>, ids array<bigint>"


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flatten(documents: DataFrame, ranks: str | None = None, eod: int = EOD, block: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as flat files, one for each input partition: rows (file, block, payload, ids), uint16 ids.

    `ids` lists the doc_ids whose separators lie in the block: a label for reports, which the scan doesn't use.
    A null or empty text is a document of no tokens."""
    path = ranks or ranks_path()
    text_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(path)
        file = f"part-{TaskContext.get().partitionId():06d}"
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("payload", pa.binary()), ("ids", pa.list_(pa.int64()))])
        held, size, at, names = [], 0, 0, []  # names: (doc_id, place of its separator in what is held)

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, size, at, names
            flat = np.concatenate(held)
            own, names = [d for d, p in names if p < n], [(d, p - n) for d, p in names if p >= n]
            held, size, at = [flat[n:]], size - n, at + 1
            return pa.record_batch([pa.array([file]), pa.array([at - 1]), pa.array([flat[:n].astype("<u2").tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                ids = coder.encode_ordinary(text.decode("utf-8", "replace")) if text else []
                held.append(np.array([*ids, eod], np.uint16))
                size += len(held[-1])
                names.append((doc, size - 1))
                if size >= 2 * block:
                    while size >= block:
                        yield cut(block)
        while size:
            yield cut(min(block, size))

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _BLOCKS)


def _split(path: str) -> tuple[str, str, str]:
    """Scheme, authority and path of a file's name as Spark lists it."""
    scheme, rest = path.split(":", 1)
    authority, rest = rest[2:].split("/", 1) if rest.startswith("//") else ("", rest.lstrip("/"))
    return scheme, authority, "/" + rest


def _open(path: str):
    """The file, read at any place; on object stores and HDFS by Arrow's file systems."""
    scheme, authority, rest = _split(path)
    if scheme == "file":
        return open(rest, "rb")
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}://{authority}/")
    return system.open_input_file(root.rstrip("/") + rest)


def read_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK_TOKENS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Flat token files of any size as the same rows: only names and lengths are listed, then each task reads its blocks'
    byte ranges, about task_bytes in all, one block at a time.

    Schemes that Arrow can't open (all but those of ARROW_SCHEMES and file) go through Spark's binaryFile source, a whole
    file a task, of up to 2 GB."""
    text_batches(spark)
    fields = ("file", "block", "payload", "ids")
    files = spark.read.format("binaryFile").load(path)

    def row(file: str, at: int, data: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([file]), pa.array([at], pa.int64()), pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=fields)

    def whole(file: str, size: int) -> None:
        if size % width:
            raise ValueError(f"{file}: {size} bytes are no whole number of tokens of {width} bytes")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(data.as_buffer())
                whole(file, len(raw))
                for k in range(0, len(raw), block * width):
                    yield row(file, k // (block * width), raw[k : k + block * width].tobytes())

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                whole(file, size)
                start = at * block * width
                with _open(file) as f:
                    f.seek(start)
                    data = f.read(min(block * width, size - start))
                if len(data) != min(block * width, size - start):
                    raise ValueError(f"{file}: changed while it was read")
                yield row(file, at, data)

    listed = files.select("path", "length").filter("length > 0")
    schemes = listed.groupBy(F.substring_index("path", ":", 1).alias("s")).agg(F.sum("length")).toArrow()
    if not set(schemes.column(0).to_pylist()) <= {"file", *ARROW_SCHEMES}:
        return files.select("path", "content").mapInArrow(contents, _BLOCKS)
    tasks = max(1, -(-sum(schemes.column(1).to_pylist()) // task_bytes))
    blocks = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / (block * width)))).alias("block"))
    return blocks.repartition(tasks, "path", "block").mapInArrow(ranges, _BLOCKS)


def find_separators(blocks: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """(file, block, n, seps, ids): tokens of each block and where separators are in it."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(p.as_buffer(), kind) if p.is_valid else np.zeros(0, kind) for p in batch.column(2)]
            seps = [np.flatnonzero(t == eod).astype(np.int32) for t in tokens]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(seps, pa.list_(pa.int32())), batch.column(3)],
                names=["file", "block", "n", "seps", "ids"],
            )

    return blocks.mapInArrow(run, _FOUND)


def stitch(found: DataFrame, span: int = SPAN) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed, doc_id) of every document, from the separators of the blocks."""
    rows = found.withColumn("span", F.floor(F.col("block") / span)).withColumn("k", F.size("seps"))
    rows = rows.withColumn("last", F.try_element_at("seps", F.lit(-1)).cast("bigint"))
    near = W.partitionBy("file", "span").orderBy("block")
    past = near.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("off", F.coalesce(F.sum("n").over(past), zero)).withColumn("before", F.coalesce(F.sum("k").over(past), zero))
    rows = rows.withColumn("prior", F.max(F.col("off") + F.col("last")).over(past))
    spans = rows.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("off") + F.col("last")).alias("last"))
    far = W.partitionBy("file").orderBy("span")
    past = far.rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("s_off", F.coalesce(F.sum("n").over(past), zero)).withColumn("s_before", F.coalesce(F.sum("k").over(past), zero))
    spans = spans.withColumn("s_prior", F.max(F.col("s_off") + F.col("last")).over(past)).withColumn("s_final", F.lead("span").over(far).isNull())
    spans = spans.select(F.col("file").alias("s_file"), F.col("span").alias("s_span"), "s_off", "s_before", "s_prior", "s_final")
    rows = rows.withColumn("final", F.lead("block").over(near).isNull())
    rows = rows.join(spans, (F.col("file") == F.col("s_file")) & (F.col("span") == F.col("s_span")))
    base = F.col("s_off") + F.col("off")
    rows = rows.select(
        "file",
        base.alias("base"),
        (F.col("s_before") + F.col("before")).alias("first"),
        F.coalesce(F.greatest(F.col("s_off") + F.col("prior"), F.col("s_prior")) + 1, zero).alias("begin"),
        "n",
        F.when(F.col("final") & F.col("s_final") & (F.coalesce(F.col("last"), F.lit(-1)) < F.col("n") - 1), F.concat("seps", F.array(F.col("n").cast("int")))).otherwise(F.col("seps")).alias("ends"),
        "seps",
        "ids",
    )
    docs = rows.select("*", F.posexplode("ends").alias("p", "end"))
    start = F.when(F.col("p") == 0, F.col("begin")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("p"), F.lit(1))) + 1)
    docs = docs.withColumn("start", start)
    return docs.select(
        "file",
        (F.col("first") + F.col("p")).alias("ordinal"),
        "start",
        (F.col("base") + F.col("end") - F.col("start")).alias("n_tokens"),
        (F.col("end") < F.col("n")).alias("closed"),
        F.when(F.col("ids").isNotNull(), F.try_element_at("ids", F.col("p") + 1)).alias("doc_id"),
    )


def count_tokens(blocks: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """One row for each document of the flat files. The blocks are searched once: what is found is checkpointed."""
    return stitch(checkpoint(find_separators(blocks, eod, width)))
