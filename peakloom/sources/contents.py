"""Files as rows (path, content), and steps over them.

A step on what another step made runs in that one's Python worker, a file at a time: a task has one worker, however many
steps, and files pass from step to step without Spark's buffers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..plans.session import ship

if TYPE_CHECKING:
    import pandas as pd

SCHEMA = "path string, content binary"
Change = Callable[[bytes], bytes]
Read = Callable[[str, bytes], Iterator["pd.DataFrame"]]
#: Runs a function over every file and gives its rows, of a schema.
Start = Callable[[Read, str], DataFrame]


def _row(path: str, data: bytes) -> Iterator[pd.DataFrame]:
    import pandas as pd

    yield pd.DataFrame({"path": [path], "content": [data]})


def _after(changes: tuple[Change, ...], read: Read) -> Read:
    def run(path, data):
        for f in changes:
            data = f(data)
        return read(path, data)

    return run


def _of_rows(files: DataFrame) -> Start:
    def start(read, schema):
        def run(batches):
            for pdf in batches:
                for path, data in zip(pdf["path"], pdf["content"]):
                    yield from read(path, bytes(data))

        return files.select("path", "content").mapInPandas(run, schema)

    return start


def _of_groups(rows: DataFrame, by: str, write: Callable[[pd.DataFrame], tuple[str, bytes]]) -> Start:
    def start(read, schema):
        def run(pdf):
            import pandas as pd

            parts = list(read(*write(pdf)))
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

        return rows.groupBy(by).applyInPandas(run, schema)

    return start


def _made(start: Start, changes: tuple[Change, ...]) -> DataFrame:
    out = start(_after(changes, _row), SCHEMA)
    out._peakloom_steps = start, changes
    return out


def _steps(files: DataFrame) -> tuple[Start, tuple[Change, ...]]:
    ship(files.sparkSession)
    return getattr(files, "_peakloom_steps", None) or (_of_rows(files), ())


def write(rows: DataFrame, by: str, f: Callable[[pd.DataFrame], tuple[str, bytes]]) -> DataFrame:
    """(path, content): a file for each value of `by`, which must fit a task."""
    ship(rows.sparkSession)
    return _made(_of_groups(rows, by, f), ())


def change(files: DataFrame, f: Change) -> DataFrame:
    """(path, content) of files with other contents; each must fit a task."""
    start, changes = _steps(files)
    return _made(start, (*changes, f))


def read(files: DataFrame, f: Read, schema: str) -> DataFrame:
    """What f gives of each file, in frames of this schema."""
    start, changes = _steps(files)
    return start(_after(changes, f), schema)
