"""Spectrum documents (mzML): a generator for tests, a record reader, and a Spark data source.

The source splits a document at spectrum boundaries: a partition owns the spectra that start in its byte range, so any number
of partitions gives the same rows. Header values are read inside their own spectrum (a missing one is null), and array
types from each array's own terms, whichever order they come in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..plans.session import ship
from . import contents

# Accessions of terms.
MS_LEVEL, MS1, MSN = 1000511, 1000579, 1000580
RETENTION_TIME, SELECTED_MZ, CHARGE = 1000016, 1000744, 1000041
MZ_ARRAY, INTENSITY_ARRAY = 1000514, 1000515
INDEXED_MARK = b"indexedmzML"

SCHEMA = (
    "file string, index bigint, scan bigint, ms_level int, retention_time float, precursor double, charge int, mz array<double>, "
    "intensity array<double>, xml string, spec_start bigint, spec_end bigint, mz_start bigint, mz_end bigint, inten_start bigint, inten_end bigint"
)
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))

_SPECTRUM = re.compile(rb"<spectrum\s.*?</spectrum>", re.S)
_TERM = re.compile(rb"<cvParam\b([^>]*)>")
_ATTRIBUTE = re.compile(rb'([\w:]+)\s*=\s*(?:"([^"]*)"|\'([^\']*)\')')
_ARRAY = re.compile(rb"<binaryDataArray\b.*?</binaryDataArray>", re.S)
_BINARY = re.compile(rb"<binary\s*/>|<binary>(.*?)</binary>", re.S)
_SCAN = re.compile(rb"scan=(\d+)")


def is_document(head: bytes) -> bool:
    """Whether the first 512 bytes say that this is an indexed document."""
    return INDEXED_MARK in head[:512]


def source_name(head: bytes) -> str | None:
    """The name of the file that a document was made from, by its first 4096 bytes."""
    m = re.search(rb"<sourceFile\b([^>]*)>", head[:4096])
    name = _attributes(m.group(1)).get(b"name") if m else None
    return name.decode("utf-8", "replace") if name is not None else None


def _attributes(raw: bytes) -> dict[bytes, bytes]:
    return {k: a or b for k, a, b in _ATTRIBUTE.findall(raw)}


def _terms(xml: bytes) -> dict[int, bytes]:
    """Accession -> value, the first of each."""
    out: dict[int, bytes] = {}
    for raw in _TERM.findall(xml):
        own = _attributes(raw)
        code = own.get(b"accession", b"")
        if code.startswith(b"MS:") and code[3:].isdigit():
            out.setdefault(int(code[3:]), own.get(b"value", b""))
    return out


def _number(raw: bytes | None, kind=float):
    try:
        return None if raw is None or raw == b"" else kind(raw)
    except ValueError:
        return None


def read_spectrum(xml: bytes, start: int = 0, columns: Sequence[str] = COLUMNS) -> dict:
    """The record of one <spectrum> element; arrays are decoded only if asked for."""
    head = xml[: xml.find(b">") + 1]
    first_array = _ARRAY.search(xml)
    terms = _terms(xml[: first_array.start()] if first_array else xml)
    own = _attributes(head)
    scan = _SCAN.search(own.get(b"id", b""))
    level = _number(terms.get(MS_LEVEL), int)
    if level is None and MS1 in terms:
        level = 1
    out = {
        "index": _number(own.get(b"index"), int),
        "scan": int(scan.group(1)) if scan else None,
        "ms_level": level,
        "retention_time": _number(terms.get(RETENTION_TIME)),
        "precursor": _number(terms.get(SELECTED_MZ)),
        "charge": _number(terms.get(CHARGE), int),
        "xml": xml.decode("utf-8", "replace") if "xml" in columns else None,
        "spec_start": start,
        "spec_end": start + len(xml),
    }
    kinds: list[tuple[str, int, int, str, int]] = []
    for k, m in enumerate(_ARRAY.finditer(xml)):
        own = _terms(m.group())
        name = "mz" if MZ_ARRAY in own else "intensity" if INTENSITY_ARRAY in own else ("mz", "intensity")[k] if k < 2 else ""
        dtype = next((t for code, t in codecs.ELEMENT_TYPES.items() if code in own), "<f8")
        body = _BINARY.search(m.group())
        if name and body:
            a, b = body.span(1) if body.group(1) is not None else (body.end(), body.end())
            kinds.append((name, m.start() + a, m.start() + b, dtype, codecs.ZLIB if codecs.ZLIB in own else codecs.NO_COMPRESSION))
    for name, a, b, dtype, compression in kinds:
        short = "mz" if name == "mz" else "inten"
        out[f"{short}_start"], out[f"{short}_end"] = start + a, start + b
        if name in columns:
            out[name] = codecs.decode_binary(xml[a:b].strip(), dtype, compression).astype(float).tolist()
    return out


def scan_document(data: bytes, low: int = 0, high: int | None = None, columns: Sequence[str] = COLUMNS) -> Iterator[dict]:
    """Records of the spectra that start in [low, high). An unfinished last spectrum is no record."""
    high = len(data) if high is None else high
    at = low
    while (m := _SPECTRUM.search(data, at)) and m.start() < high:
        yield read_spectrum(m.group(), m.start(), columns)
        at = m.end()


def write_document(spectra: Sequence[dict], mz_type: str = "<f8", intensity_type: str = "<f4", compression: int = codecs.NO_COMPRESSION, indexed: bool = True, kind_first: bool = True) -> bytes:
    """A document of these spectra (scan, ms_level, retention_time, mz, intensity; perhaps precursor, charge)."""
    codes = {v: k for k, v in codecs.ELEMENT_TYPES.items()}
    term = lambda code, value="": f'<cvParam cvRef="MS" accession="MS:{code}" name="" value="{value}"/>'
    out = ['<?xml version="1.0" encoding="utf-8"?>\n']
    if indexed:
        out.append('<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">\n')
    out.append('<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0"><fileDescription><sourceFileList count="1"><sourceFile id="S1" name="made.raw" location=""/></sourceFileList></fileDescription>\n')
    out.append(f'<run id="run"><spectrumList count="{len(spectra)}">\n')
    for k, s in enumerate(spectra):
        out.append(f'<spectrum index="{k}" id="controllerType=0 controllerNumber=1 scan={s["scan"]}" defaultArrayLength="{len(s["mz"])}">\n')
        if s.get("ms_level") is not None:
            out.append(term(MS_LEVEL, s["ms_level"]) + term(MS1 if s["ms_level"] == 1 else MSN))
        if s.get("retention_time") is not None:
            out.append(f'<scanList count="1"><scan>{term(RETENTION_TIME, s["retention_time"])}</scan></scanList>')
        if s.get("precursor") is not None:
            out.append(f'<precursorList count="1"><precursor><selectedIonList count="1"><selectedIon>{term(SELECTED_MZ, s["precursor"])}{term(CHARGE, s.get("charge", ""))}</selectedIon></selectedIonList></precursor></precursorList>')
        out.append('\n<binaryDataArrayList count="2">\n')
        for name, dtype, code in (("mz", mz_type, MZ_ARRAY), ("intensity", intensity_type, INTENSITY_ARRAY)):
            body = codecs.encode_binary(np.asarray(s[name], dtype), compression).decode()
            terms = [term(codes[dtype]), term(compression), term(code)]
            out.append(f'<binaryDataArray encodedLength="{len(body)}">{"".join(terms if not kind_first else terms[::-1])}<binary>{body}</binary></binaryDataArray>\n')
        out.append("</binaryDataArrayList>\n</spectrum>\n")
    out.append("</spectrumList></run></mzML>\n")
    if indexed:
        out.append("</indexedmzML>\n")
    return "".join(out).encode()


def read_documents(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Spectra of documents that Spark can list, in any file system; `index` counts inside each file.

    Files come through Spark's binaryFile reader (up to 2 GB each) and are scanned on executors; only the arrays and
    texts among `columns` are decoded."""
    return spectra_of(spark.read.format("binaryFile").load(path), columns)


def spectra_of(documents: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spectra of documents (path, content), as `read_documents` gives them."""
    wanted = tuple(columns or COLUMNS)
    unknown = set(wanted) - set(COLUMNS)
    if unknown:
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    fields = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in wanted)
    order = [c.split()[0] for c in fields.split(", ")]

    def run(file, data):
        import pandas as pd

        rows = ({"file": file, **r, "index": k} for k, r in enumerate(scan_document(data, columns=wanted)))
        while part := list(islice(rows, 1000)):
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in part], dtype=object) for c in order})

    return contents.read(documents, run, fields)


def documents_of(spectra: DataFrame, file: str, **options) -> DataFrame:
    """(path, content): one document for each value of the column `file`, its spectra in order of `scan`.

    spectra: scan, ms_level, retention_time, mz, intensity; options: of `write_document`. A file must fit a task."""

    def write(pdf):
        rows = pdf.sort_values("scan").to_dict("records")
        return str(rows[0][file]), write_document(rows, **options)

    return contents.write(spectra, file, write)


def to_peaks(spectra: DataFrame) -> DataFrame:
    """The long peak table: one row for each peak, columns of the spectrum repeated."""
    from ..functions.columns import mass_bin
    from ..plans.queries import MASS_BIN

    whole = spectra.where(F.assert_true(F.size("mz") == F.size("intensity"), F.lit("m/z and intensity differ in length")).isNull())
    rows = whole.select(F.col("index").cast("int").alias("spec_no"), F.col("retention_time").alias("ret_time"), F.col("ms_level").cast("tinyint").alias("ms_level"), F.col("precursor").cast("float").alias("precursor"), F.col("charge").cast("tinyint").alias("charge"), F.explode(F.arrays_zip("mz", "intensity")).alias("p"))
    return rows.select("spec_no", "ret_time", F.col("p.mz").cast("float").alias("mz"), F.col("p.intensity").cast("float").alias("int"), "ms_level", "precursor", "charge", mass_bin(F.col("p.mz"), MASS_BIN).cast("smallint").alias("mass_bin"))


def register(spark: SparkSession) -> None:
    """`spark.read.format("mzml").load(path)`, with the options columns and partitions."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

    ship(spark)

    class Range(InputPartition):
        def __init__(self, file: str, low: int, high: int):
            super().__init__((file, low, high))

    class Reader(DataSourceReader):
        def __init__(self, path: str, columns: tuple[str, ...], parts: int):
            self.path, self.columns, self.parts = path, columns, parts
            self.tests: list[tuple[str, str, object]] = []

        def pushFilters(self, filters):
            """Comparisons of header values are tested before arrays are decoded."""
            names = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
            for f in filters:
                column = getattr(f, "attribute", ())
                if type(f) in names and len(column) == 1 and column[0] in ("scan", "ms_level", "retention_time"):
                    self.tests.append((column[0], names[type(f)], f.value))
                yield f  # Spark tests all again; what is dropped early is only saved work

        def partitions(self):
            import glob
            import os

            files = sorted(f for p in self.path.split(",") for f in (glob.glob(os.path.join(p, "*")) if os.path.isdir(p) else glob.glob(p)))
            if not files:
                raise FileNotFoundError(self.path)
            out = []
            for f in files:
                size = os.path.getsize(f)
                cuts = [size * k // self.parts for k in range(self.parts + 1)]
                out += [Range(f, a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            return out

        def passes(self, row: dict) -> bool:
            ops = {"eq": lambda a, b: a == b, "in": lambda a, b: a in b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
            return all(row.get(c) is not None and ops[o](row[c], v) for c, o, v in self.tests)

        def read(self, partition):
            import mmap

            file, low, high = partition.value
            with open(file, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                at = low
                while (m := _SPECTRUM.search(data, at)) and m.start() < high:
                    xml, at = m.group(), m.end()
                    if self.tests and not self.passes(read_spectrum(xml, m.start(), ())):
                        continue
                    row = {"file": file, **read_spectrum(xml, m.start(), self.columns)}
                    yield tuple(row.get(c) for c in self.columns)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "mzml"

        def _columns(self) -> tuple[str, ...]:
            asked = self.options.get("columns")
            return tuple(c for c in COLUMNS if not asked or c in [x.strip() for x in asked.split(",")])

        def schema(self):
            return ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in self._columns())

        def reader(self, schema):
            return Reader(self.options["path"], self._columns(), int(self.options.get("partitions", "1")))

    spark.dataSource.register(Source)
