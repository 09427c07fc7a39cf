"""Files as objects: `read(path)` gives a document, whose spectra are looked up lazily; and jobs over many files.

For one file on the machine at hand; tables of many files are `sources.mzml.read_documents` and `sources.container`.
"""

from __future__ import annotations

import mmap
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .operators.selection import parse_ranges
from .sources import container, mzml
from .sources.container import Container, Options


def num_threads() -> int:
    return os.cpu_count() or 1


def filesize(path: str) -> int:
    """Bytes of a file; 0 for a folder."""
    return 0 if os.path.isdir(path) else os.path.getsize(path)


@dataclass
class Spectrum:
    """One spectrum; arrays and XML are decoded when asked for."""

    index: int
    scan: int | None
    ms_level: int | None
    _file: SpectrumFile

    @cached_property
    def mz(self) -> np.ndarray:
        return self._file.array("mz", self.index)

    @cached_property
    def intensity(self) -> np.ndarray:
        return self._file.array("inten", self.index)

    @cached_property
    def xml(self):
        """The element tree of the spectrum."""
        from xml.etree import ElementTree

        return ElementTree.fromstring(self._file.spectrum_xml(self.index))

    @cached_property
    def retention_time(self) -> float | None:
        return mzml.read_spectrum(self._file.spectrum_xml(self.index), 0, ())["retention_time"]

    @property
    def size(self) -> int:
        return len(self.mz)

    @property
    def peaks(self) -> np.ndarray:
        """m/z beside intensity; an error if they differ in length."""
        if len(self.mz) != len(self.intensity):
            raise ValueError(f"{len(self.mz)} m/z values and {len(self.intensity)} intensities")
        return np.column_stack((self.mz, self.intensity))

    def __repr__(self) -> str:
        return f"Spectrum(index={self.index}, scan={self.scan}, ms_level={self.ms_level}, retention_time={self.retention_time})"


class Spectra:
    """The spectra of a file in order: len, iteration, [i]; each is made once."""

    def __init__(self, file: SpectrumFile):
        self._file = file
        self._made: dict[int, Spectrum] = {}

    def __len__(self) -> int:
        return len(self._file.headers)

    def __getitem__(self, i: int) -> Spectrum:
        if not 0 <= i < len(self):
            raise IndexError(f"spectrum {i} of {len(self)}")
        if i not in self._made:
            scan, level = self._file.headers[i]
            self._made[i] = Spectrum(i, scan, level, self._file)
        return self._made[i]

    def __iter__(self) -> Iterator[Spectrum]:
        return (self[i] for i in range(len(self)))


class SpectrumFile:
    """Common to documents and containers. A context manager; pickles by its path."""

    def __init__(self, path: str):
        self.path = path
        self._handle = open(path, "rb")  # noqa: SIM115
        self.data = mmap.mmap(self._handle.fileno(), 0, access=mmap.ACCESS_READ)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.data.close()
        self._handle.close()

    def __reduce__(self):
        return type(self), (self.path,)

    @cached_property
    def spectra(self) -> Spectra:
        return Spectra(self)

    @property
    def filesize(self) -> int:
        return filesize(self.path)

    def select(self, indices: str | None = None, scans: str | None = None, level: int | str | None = None) -> list[int]:
        """Indices of the chosen spectra, ascending; one way to choose at most. Unknown scans choose nothing."""
        if sum(x is not None for x in (indices, scans, level)) > 1:
            raise ValueError("choose by indices, by scans or by level")
        if indices is not None:
            chosen = [i for a, b in parse_ranges(indices) for i in range(a, min(b, len(self.headers) - 1) + 1)]
        elif scans is not None:
            ranges = parse_ranges(scans)
            chosen = [i for i, (s, _) in enumerate(self.headers) if s is not None and any(a <= s <= b for a, b in ranges)]
        elif level is not None:
            chosen = [i for i, (_, n) in enumerate(self.headers) if n is not None and (n > 2 if level == "n" else n == int(level))]
        else:
            chosen = list(range(len(self.headers)))
        return chosen


class Document(SpectrumFile):
    """An mzML file."""

    @cached_property
    def _parsed(self):
        return container.index_document(bytes(self.data))

    @property
    def positions(self) -> container.Index:
        return self._parsed[0]

    @cached_property
    def headers(self) -> list[tuple[int, int]]:
        return list(zip(self.positions.scans, self.positions.levels))

    @property
    def format(self) -> dict:
        mz, inten, source = self._parsed[1]
        return {"mz": mz, "intensity": inten, "compression": source, "spectra": len(self.headers)}

    def spectrum_xml(self, i: int) -> bytes:
        a, b = self.positions.spectra[i]
        return self.data[a:b]

    def array(self, stream: str, i: int) -> np.ndarray:
        row = mzml.read_spectrum(self.spectrum_xml(i), 0, ("mz", "intensity"))
        values = np.array(row.get("mz" if stream == "mz" else "intensity") or [], float)
        return values.astype(self.format["mz" if stream == "mz" else "intensity"])

    def extract(self, indices: list[int]) -> bytes:
        """The document with only these spectra."""
        p, data = self.positions, self.data
        if not p.spectra:
            return bytes(data)
        return data[: p.spectra[0][0]] + b"".join(data[a:b] + b"\n" for a, b in (p.spectra[i] for i in indices)) + data[p.spectra[-1][1] :]

    def compress(self, out: str, options: Options | None = None, indices: list[int] | None = None) -> None:
        """Write the container of the document, or of some of its spectra."""
        data = bytes(self.data) if indices is None else self.extract(indices)
        with open(out, "wb") as f:
            f.write(container.compress(data, options))

    def describe(self) -> dict:
        return {"path": self.path, "filesize": self.filesize, "format": self.format, "positions": self.positions}


class ContainerFile(SpectrumFile):
    """A block container."""

    @cached_property
    def container(self) -> Container:
        return Container(self.data)

    @cached_property
    def headers(self) -> list[tuple[int, int]]:
        return [(s, n) for d in self.container.divisions for s, n in zip(d.scans, d.levels)]

    @property
    def positions(self) -> list[container.Index]:
        return self.container.divisions

    @property
    def format(self) -> dict:
        return self.container.format

    def spectrum_xml(self, i: int) -> bytes:
        return self.container.spectrum_xml(i)

    def array(self, stream: str, i: int) -> np.ndarray:
        return self.container.array(stream, i)

    def extract(self, indices: list[int]) -> bytes:
        return self.container.extract(indices)

    def decompress(self, out: str) -> None:
        with open(out, "wb") as f:
            f.write(self.container.decompress())

    def describe(self) -> dict:
        return {"path": self.path, "filesize": self.filesize, **self.container.describe(), "positions": self.positions}


def kind_of(path: str) -> str:
    """document, container or external."""
    with open(path, "rb") as f:
        head = f.read(512)
    return "container" if container.is_container(head) else "document" if mzml.is_document(head) else "external"


def read(path: str | bytes) -> Document | ContainerFile:
    """A document or a container, by what the file says it is."""
    if isinstance(path, bytes):
        path = os.fsdecode(path)
    if not isinstance(path, str):
        raise ValueError("a path is a string or bytes")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    kind = kind_of(path)
    if kind == "external":
        raise OSError(f"{path}: neither a document nor a container")
    return Document(path) if kind == "document" else ContainerFile(path)


def output_name(path: str, kind: str) -> str:
    """Where a result goes if no output is named."""
    if kind == "document":
        return re.sub(r"\.[^./]*$", "", path) + ".msz"
    if kind == "container":
        return path[:-4] if path.endswith(".msz") else path + ".mzML"
    return path + ".msz"


def extract_name(path: str) -> str:
    """Where chosen spectra go if no output is named: beside the input, as a document."""
    folder, name = os.path.split(path)
    return os.path.join(folder, "extract_" + re.sub(r"\.[^.]*$", "", name) + ".mzML")
