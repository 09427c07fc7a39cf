"""The block container: a document in three streams, block-compressed, indexed, readable at random.

Layout, little-endian: a header of 512 bytes; the blocks of the XML, m/z and intensity streams; three block tables; the
divisions (positions of every piece in the original); a footer of 88 bytes. A division is a run of whole spectra and has one
block a stream; one more division holds the XML after the last spectrum. Lossless arrays are stored as their length
in bytes and the raw numbers; lossy ones as frames of `functions.transforms`, each by the type of its own stream.

`compress_files` and `decompress_files` run one file a row on executors. `blocks` gives the block index as a DataFrame.
The Parquet form of the same data (`write_parquet`) is the one that prunes and scales inside Spark.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import transforms as T
from ..plans.session import ship
from . import contents, mzml

# Sizes and offsets of the layout.
MAGIC = 0x035F51B5
VERSION = (1, 0)
HEADER_SIZE, FOOTER_SIZE = 512, 88
MESSAGE_OFFSET, FORMAT_OFFSET, BLOCKSIZE_OFFSET, MD5_OFFSET = 12, 140, 176, 184
FORMAT = "<7I2f"
FOOTER = "<9Q4i"
FOOTER_NAMES = "xml_pos mz_binary_pos inten_binary_pos xml_blk_pos mz_binary_blk_pos inten_binary_blk_pos divisions_t_pos num_spectra original_filesize n_divisions magic_tag mz_fmt inten_fmt".split()
STREAMS = ("xml", "mz", "inten")
DEFAULT_BLOCK = 100_000_000

_BINARY = re.compile(rb"<binary\s*/>|<binary>(.*?)</binary>", re.S)
_SPECTRUM = re.compile(rb"<spectrum\s.*?</spectrum>", re.S)
_MESSAGE = b"block container of spectra"


@dataclass
class Options:
    """How to compress. Blocks are about `blocksize` bytes of the original; lossy transforms by stream."""

    blocksize: int = DEFAULT_BLOCK
    mz: str = "lossless"
    intensity: str = "lossless"
    mz_scale: float | None = None
    intensity_scale: float | None = None
    level: int = codecs.DEFAULT_LEVEL
    targets: dict[str, str] = field(default_factory=lambda: dict.fromkeys(STREAMS, "zstd"))

    def __post_init__(self):
        T.transform(self.mz)
        T.transform(self.intensity)
        self.targets = {s: codecs.codec_name(self.targets.get(s, "zstd")) for s in STREAMS}
        for name in self.targets.values():
            codecs.check_level(name, min(self.level, 12) if name == "lz4" else self.level)
        if self.blocksize < 1:
            raise ValueError("a block size is at least 1")

    def scales(self) -> tuple[float, float]:
        return (
            T.default_scale(self.mz, "mz") if self.mz_scale is None else self.mz_scale,
            T.default_scale(self.intensity, "intensity") if self.intensity_scale is None else self.intensity_scale,
        )


@dataclass
class Index:
    """Where the pieces of a document are: intervals [start, end) by stream, and header values by spectrum."""

    spectra: list[tuple[int, int]]
    xml: list[tuple[int, int]]
    mz: list[tuple[int, int]]
    inten: list[tuple[int, int]]
    scans: list[int]
    levels: list[int]
    size: int


def index_document(data: bytes) -> tuple[Index, tuple[str, str, int]]:
    """Positions of a whole document, and (m/z type, intensity type, source compression) of its first spectrum."""
    out = Index([], [], [], [], [], [], len(data))
    kinds, typed = ("<f8", "<f8", codecs.NO_COMPRESSION), False
    past = 0
    for m in _SPECTRUM.finditer(data):
        xml = m.group()
        bodies = [(m.start() + b.start(1), m.start() + b.end(1)) for b in _BINARY.finditer(xml) if b.group(1) is not None]
        while len(bodies) < 2:  # no or empty elements: empty intervals
            bodies.append((bodies[-1][1] if bodies else m.end(),) * 2)
        (a, b), (c, d) = bodies[:2]
        arrays = [mzml._terms(x.group()) for x in mzml._ARRAY.finditer(xml)][:2]
        own = tuple(next((t for code, t in codecs.ELEMENT_TYPES.items() if code in a), "<f8") for a in arrays)
        own += (codecs.ZLIB if any(codecs.ZLIB in a for a in arrays) else codecs.NO_COMPRESSION,)
        if len(own) == 3 and (a < b or c < d):  # a container holds one type for each array; spectra without peaks have none
            if typed and own != kinds:
                raise ValueError(f"spectrum {len(out.spectra)} has arrays of {own}, earlier ones of {kinds}: a container can't hold both")
            kinds, typed = own, True
        row = mzml.read_spectrum(xml, m.start(), ())
        out.spectra.append(m.span())
        out.xml += [(past, a), (b, c)]
        out.mz.append((a, b))
        out.inten.append((c, d))
        out.scans.append(row["scan"] or 0)
        out.levels.append(row["ms_level"] or 0)
        past = d
    out.xml.append((past, len(data)))
    return out, kinds


def _array_payload(text: bytes, dtype: str, compression: int, name: str, scale: float) -> bytes:
    values = codecs.decode_binary(text, dtype, compression)
    if not len(values):
        return b""
    if T.transform(name, dtype).lossless:
        return struct.pack("<I", values.nbytes) + values.tobytes()
    return T.encode(values, name, scale)


def _frames(block: bytes, lengths: Iterable[int], dtype: str, name: str, scale: float) -> Iterator[np.ndarray]:
    """The arrays of a block one after the other; lengths: of the original texts, empty ones have no frame."""
    at, t, kind = 0, T.transform(name, dtype), np.dtype(dtype)
    for n in lengths:
        if not n:
            yield np.zeros(0, kind)
            continue
        (count,) = struct.unpack_from("<I", block, at)
        if t.lossless:
            yield np.frombuffer(block, kind, count // kind.itemsize, at + 4)
            at += 4 + count
            continue
        size = _body_size(block, at + 4, t, count, kind)
        yield t.unpack(block[at + 4 : at + 4 + size], count, kind, scale)
        at += 4 + size


def _body_size(block: bytes, at: int, t: T.Transform, n: int, kind: np.dtype) -> int:
    """Bytes of a frame's body."""
    if t.name in ("cast", "cast16", "log"):
        return n * {"cast": 4, "cast16": 2, "log": 2}[t.name]
    if t.name.startswith("vdelta"):
        return 8 + (n - 1) * int(t.name[6:]) // 8
    if t.name.startswith("delta"):
        return kind.itemsize + (n - 1) * int(t.name[5:]) // 8
    head = kind.itemsize if t.name == "vbr" else 0
    return head + 5 + struct.unpack_from("<I", block, at + head + 1)[0]


def _divisions(index: Index, blocksize: int) -> list[tuple[int, int]]:
    """Runs of spectra: equal counts, the last takes the remainder; never more than there are spectra."""
    n = len(index.spectra)
    if not n:
        return []
    k = max(1, min(n, index.size // blocksize))
    each = n // k
    return [(i * each, n if i == k - 1 else (i + 1) * each) for i in range(k)]


def _positions(pairs: list[tuple[int, int]]) -> bytes:
    a = np.array(pairs, "<u8").reshape(-1, 2)
    return struct.pack("<Q", len(a)) + a[:, 0].tobytes() + a[:, 1].tobytes()


def compress(data: bytes, options: Options | None = None) -> bytes:
    """The container of a document."""
    o = options or Options()
    index, (mz_type, int_type, source) = index_document(data)
    mz_scale, int_scale = o.scales()
    packers = {s: codecs.compressor(o.targets[s], min(o.level, 12) if o.targets[s] == "lz4" else o.level) for s in STREAMS}
    sections: dict[str, list[tuple[int, bytes]]] = {s: [] for s in STREAMS}
    divisions = []
    runs = _divisions(index, o.blocksize)
    for a, b in [*runs, (len(index.spectra), len(index.spectra))]:
        xml = index.xml[2 * a : 2 * b] if a < b else index.xml[2 * len(index.spectra) :]
        parts = {
            "xml": b"".join(data[x:y] for x, y in xml),
            "mz": b"".join(_array_payload(data[x:y], mz_type, source, o.mz, mz_scale) for x, y in index.mz[a:b]),
            "inten": b"".join(_array_payload(data[x:y], int_type, source, o.intensity, int_scale) for x, y in index.inten[a:b]),
        }
        for s in STREAMS:
            sections[s].append((len(parts[s]), packers[s](parts[s]) if parts[s] else b""))
        size = sum(y - x for x, y in (*xml, *index.mz[a:b], *index.inten[a:b]))
        scans, levels = index.scans[a:b], index.levels[a:b]
        divisions.append(
            b"".join(map(_positions, (index.spectra[a:b], xml, index.mz[a:b], index.inten[a:b])))
            + struct.pack("<QI", size, len(scans)) + np.array(scans, "<u4").tobytes() + struct.pack("<I", len(levels)) + np.array(levels, "<u2").tobytes()
        )
    codes = {v: k for k, v in codecs.ELEMENT_TYPES.items()}
    targets = [codecs.BLOCK_CODECS[o.targets["xml"]], T.ACCESSIONS[o.mz], T.ACCESSIONS[o.intensity]]
    header = bytearray(HEADER_SIZE)
    struct.pack_into("<3I", header, 0, MAGIC, *VERSION)
    names = ",".join(o.targets[s] for s in STREAMS).encode()
    header[MESSAGE_OFFSET : MESSAGE_OFFSET + 128] = (_MESSAGE + b"; " + names).ljust(128, b"\0")
    struct.pack_into(FORMAT, header, FORMAT_OFFSET, codes[mz_type], codes[int_type], source, len(index.spectra), *targets, mz_scale, int_scale)
    struct.pack_into("<q", header, BLOCKSIZE_OFFSET, o.blocksize)
    header[MD5_OFFSET : MD5_OFFSET + 32] = hashlib.md5(data).hexdigest().encode()
    out = [bytes(header)]
    at = HEADER_SIZE
    where = []
    for s in STREAMS:
        where.append(at)
        out += [z for _, z in sections[s]]
        at += sum(len(z) for _, z in sections[s])
    for s in STREAMS:
        where.append(at)
        out.append(b"".join(struct.pack("<2Q", n, len(z)) for n, z in sections[s]))
        at += 16 * len(sections[s])
    where.append(at)
    out += divisions
    out.append(struct.pack(FOOTER, *where, len(index.spectra), len(data), len(divisions), MAGIC, targets[1], targets[2]))
    return b"".join(out)


class Container:
    """A container in memory (or a memory map): header, footer, index, and random access that decompresses one block."""

    def __init__(self, data: bytes):
        if len(data) < HEADER_SIZE + FOOTER_SIZE or struct.unpack_from("<I", data)[0] != MAGIC:
            raise ValueError("not a container")
        self.data = data
        names = "source_mz_fmt source_inten_fmt source_compression source_total_spec target_xml_format target_mz_format target_inten_format mz_scale_factor int_scale_factor".split()
        self.format = dict(zip(names, struct.unpack_from(FORMAT, data, FORMAT_OFFSET)))
        (self.blocksize,) = struct.unpack_from("<q", data, BLOCKSIZE_OFFSET)
        self.md5 = bytes(data[MD5_OFFSET : MD5_OFFSET + 32]).decode("ascii", "replace")
        self.footer = dict(zip(FOOTER_NAMES, struct.unpack_from(FOOTER, data, len(data) - FOOTER_SIZE)))
        if self.footer["magic_tag"] != MAGIC:
            raise ValueError("the footer is damaged")
        message = bytes(data[MESSAGE_OFFSET : MESSAGE_OFFSET + 128]).rstrip(b"\0").decode("ascii", "replace")
        names = message.rpartition("; ")[2].split(",")
        self.codecs = dict(zip(STREAMS, names if len(names) == 3 and all(n in codecs.BLOCK_CODECS for n in names) else ["zstd"] * 3))
        n = self.footer["n_divisions"]
        tables = [self.footer[k] for k in ("xml_blk_pos", "mz_binary_blk_pos", "inten_binary_blk_pos")]
        starts = [self.footer[k] for k in ("xml_pos", "mz_binary_pos", "inten_binary_pos")]
        self.blocks: dict[str, list[tuple[int, int, int]]] = {}  # (original, compressed, offset)
        for s, table, at in zip(STREAMS, tables, starts):
            rows = np.frombuffer(data, "<u8", 2 * n, table).reshape(n, 2)
            offsets = at + np.cumsum(rows[:, 1]) - rows[:, 1]
            self.blocks[s] = [(int(a), int(b), int(o)) for (a, b), o in zip(rows, offsets)]
        self.divisions: list[Index] = []
        at = self.footer["divisions_t_pos"]
        for _ in range(n):
            lists = []
            for _ in range(4):
                (k,) = struct.unpack_from("<Q", data, at)
                both = np.frombuffer(data, "<u8", 2 * k, at + 8).reshape(2, k)
                lists.append([(int(a), int(b)) for a, b in both.T])
                at += 8 + 16 * k
            size, k = struct.unpack_from("<QI", data, at)
            scans = np.frombuffer(data, "<u4", k, at + 12).tolist()
            at += 12 + 4 * k
            (k,) = struct.unpack_from("<I", data, at)
            levels = np.frombuffer(data, "<u2", k, at + 4).tolist()
            at += 4 + 2 * k
            self.divisions.append(Index(*lists, scans, levels, size))
        self._cache: dict[tuple[str, int], bytes] = {}
        self._decoded: dict[str, tuple[int, list[np.ndarray]]] = {}
        self._cuts: tuple[int, list[int]] = (-1, [])

    def block(self, stream: str, division: int) -> bytes:
        """A decompressed block; the last one of each stream is kept."""
        if (stream, division) not in self._cache:
            size, packed, at = self.blocks[stream][division]
            self._cache = {k: v for k, v in self._cache.items() if k[0] != stream}
            self._cache[stream, division] = codecs.decompressor(self.codecs[stream])(bytes(self.data[at : at + packed]), size) if size else b""
        return self._cache[stream, division]

    def _type(self, stream: str) -> str:
        return codecs.ELEMENT_TYPES[self.format["source_mz_fmt" if stream == "mz" else "source_inten_fmt"]]

    def arrays(self, stream: str, division: int) -> list[np.ndarray]:
        """All arrays of a division, by the type and transform of their own stream; the last division of each stream is kept."""
        if self._decoded.get(stream, (None,))[0] != division:
            self._decoded[stream] = division, self._decode(stream, division)
        return self._decoded[stream][1]

    def _decode(self, stream: str, division: int) -> list[np.ndarray]:
        d = self.divisions[division]
        spans = d.mz if stream == "mz" else d.inten
        name = T.transform(self.format["target_mz_format" if stream == "mz" else "target_inten_format"]).name
        scale = self.format["mz_scale_factor" if stream == "mz" else "int_scale_factor"]
        return list(_frames(self.block(stream, division), [b - a for a, b in spans], self._type(stream), name, scale))

    def __len__(self) -> int:
        return self.footer["num_spectra"]

    def locate(self, index: int) -> tuple[int, int]:
        """(division, place in it) of a spectrum."""
        if not 0 <= index < len(self):
            raise IndexError(index)
        for k, d in enumerate(self.divisions):
            if index < len(d.spectra):
                return k, index
            index -= len(d.spectra)
        raise IndexError(index)

    def array(self, stream: str, index: int) -> np.ndarray:
        division, k = self.locate(index)
        return self.arrays(stream, division)[k]

    def _text(self, values: np.ndarray) -> bytes:
        return codecs.encode_binary(values, self.format["source_compression"])

    def _xml_cuts(self, division: int) -> list[int]:
        """Where the pieces of a division's XML begin in its block, and the end."""
        if self._cuts[0] != division:
            self._cuts = division, np.cumsum([0, *[b - a for a, b in self.divisions[division].xml]]).tolist()
        return self._cuts[1]

    def _division_bytes(self, division: int) -> Iterator[tuple[str, bytes]]:
        """The pieces of a division in order of the document."""
        d, xml = self.divisions[division], self.block("xml", division)
        cuts = self._xml_cuts(division)
        pieces = [xml[a:b] for a, b in zip(cuts, cuts[1:])]
        mz, inten = (self.arrays(s, division) if d.spectra else [] for s in ("mz", "inten"))
        for k in range(len(d.spectra)):
            yield "xml", pieces[2 * k]
            yield "mz", self._text(mz[k])
            yield "xml", pieces[2 * k + 1]
            yield "inten", self._text(inten[k])
        for p in pieces[2 * len(d.spectra) :]:
            yield "xml", p

    def decompress(self) -> bytes:
        """The document. Arrays kept without loss must give the MD5 that was stored."""
        out = b"".join(p for k in range(len(self.divisions)) for _, p in self._division_bytes(k))
        lossless = all(T.transform(self.format[f"target_{s}_format"]).lossless for s in ("mz", "inten"))
        if lossless and len(out) == self.footer["original_filesize"] and hashlib.md5(out).hexdigest() != self.md5:
            raise ValueError("the document's MD5 isn't the stored one")
        return out

    def spectrum_xml(self, index: int) -> bytes:
        """One <spectrum> element: its pieces of XML and its arrays, encoded again; only its own division is decompressed, once."""
        division, k = self.locate(index)
        d = self.divisions[division]
        start, end = d.spectra[k]
        xml, cuts = self.block("xml", division), self._xml_cuts(division)
        head, middle = xml[cuts[2 * k] + start - d.xml[2 * k][0] : cuts[2 * k + 1]], xml[cuts[2 * k + 1] : cuts[2 * k + 2]]
        mz, inten = (self._text(self.arrays(s, division)[k]) for s in ("mz", "inten"))
        # what follows the second array stands in the next piece of XML, perhaps in the next division
        rest = end - d.inten[k][1]
        after = xml[cuts[2 * k + 2] : cuts[2 * k + 2] + rest] if 2 * k + 2 < len(d.xml) else self._next_xml(division)[:rest]
        return head + mz + middle + inten + after

    def _next_xml(self, division: int) -> bytes:
        """The XML of the next division, without giving up the block of this one."""
        size, packed, at = self.blocks["xml"][division + 1]
        return codecs.decompressor(self.codecs["xml"])(bytes(self.data[at : at + packed]), size) if size else b""

    def extract(self, indices: Iterable[int]) -> bytes:
        """The document with only these spectra: what stands before the first, they, and what stands after the last."""
        first = self.divisions[0]
        before = self.block("xml", 0)[: first.spectra[0][0]] if len(self) else self.decompress()
        if not len(self):
            return before
        last = [d for d in self.divisions if d.spectra][-1]
        tail_at = last.spectra[-1][1] - last.inten[-1][1]
        after = self.block("xml", len(self.divisions) - 1)[tail_at:]
        return before + b"".join(self.spectrum_xml(i) + b"\n" for i in indices) + after

    def describe(self) -> dict:
        return {"format": self.format, "footer": self.footer, "blocksize": self.blocksize, "md5": self.md5, "codecs": self.codecs}


def is_container(head: bytes) -> bool:
    return len(head) >= 4 and struct.unpack_from("<I", head)[0] == MAGIC


# -- Spark ------------------------------------------------------------------------------------------------------------


def compress_files(spark: SparkSession, path: str, out: str, options: Options | None = None) -> DataFrame:
    """Containers of all documents that match, one file a task, into a folder that executors share: (path, output, sizes, md5)."""
    ship(spark)
    o = options or Options()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                made = compress(bytes(data), o)
                name = os.path.join(out, re.sub(r"(\.[^./]*)?$", ".msz", os.path.basename(file), count=1))
                os.makedirs(out, exist_ok=True)
                with open(name + ".part", "wb") as f:
                    f.write(made)
                os.replace(name + ".part", name)  # a task that runs twice writes the same file twice
                yield pd.DataFrame([{"path": file, "output": name, "original_size": len(data), "compressed_size": len(made), "md5": hashlib.md5(data).hexdigest()}])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, output string, original_size bigint, compressed_size bigint, md5 string")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def compress_contents(documents: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, content) of containers from (path, content) of documents; a document must fit a task."""
    o = options or Options()
    return contents.change(documents, lambda x: compress(x, o))


def extract_contents(containers: DataFrame, indices: list[int]) -> DataFrame:
    """(path, content) of documents with only these spectra of each container; indices that a container doesn't have are left out."""

    def run(data):
        c = Container(data)
        return c.extract([i for i in indices if i < len(c)])

    return contents.change(containers, run)


def decompress_contents(containers: DataFrame) -> DataFrame:
    """(path, content) of the documents of containers."""
    return contents.change(containers, lambda x: Container(x).decompress())


def read_containers(spark: SparkSession, path: str, indices: list[int] | None = None) -> DataFrame:
    """Spectra of containers that Spark can list, see `spectra_of`."""
    return spectra_of(_contents(spark, path), indices)


def spectra_of(containers: DataFrame, indices: list[int] | None = None) -> DataFrame:
    """Spectra of containers (path, content): (file, index, scan, ms_level, division_id, mz, intensity); with `indices` only
    the blocks that hold them are decompressed."""
    wanted = None if indices is None else set(indices)

    def run(file, data):
        import pandas as pd

        c = Container(data)
        first = 0
        for k, d in enumerate(c.divisions):
            own = [i for i in range(len(d.spectra)) if wanted is None or first + i in wanted]
            if own:
                mz, inten = c.arrays("mz", k), c.arrays("inten", k)
                yield pd.DataFrame({"file": file, "index": [first + i for i in own], "scan": [d.scans[i] for i in own], "ms_level": [d.levels[i] for i in own], "division_id": k, "mz": [mz[i].astype(float) for i in own], "intensity": [inten[i].astype(float) for i in own]})
            first += len(d.spectra)

    return contents.read(containers, run, "file string, index bigint, scan bigint, ms_level int, division_id int, mz array<double>, intensity array<double>")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, stream, block_id, original_size, compressed_size, offset) of every block."""
    ship(spark)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                c = Container(bytes(data))
                rows = [{"file": file, "stream": s, "block_id": k, "original_size": a, "compressed_size": b, "offset": at} for s in STREAMS for k, (a, b, at) in enumerate(c.blocks[s])]
                yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, stream string, block_id int, original_size bigint, compressed_size bigint, offset bigint")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row with the footer of every container; write it with `.write.csv(header=True)` to describe files."""
    return footers_of(_contents(spark, path))


def footers_of(containers: DataFrame) -> DataFrame:
    """The footers of containers (path, content)."""

    def run(file, data):
        import pandas as pd

        yield pd.DataFrame([{"file": file, **Container(data).footer}])

    fields = "file string, " + ", ".join(f"{n} {'int' if n in FOOTER_NAMES[-4:] else 'bigint'}" for n in FOOTER_NAMES)
    return contents.read(containers, run, fields)


def write_parquet(spectra: DataFrame, path: str, divisions: int = 64, mode: str = "error") -> None:
    """Spectra as Parquet, range-partitioned and sorted by (file, index): row groups prune by index, scan and level."""
    rows = spectra.repartitionByRange(divisions, "file", "index").sortWithinPartitions("file", "index")
    rows.write.mode(mode).option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.page.size", 2 << 20).parquet(path)


def write_peaks(peaks: DataFrame, path: str, mode: str = "error") -> None:
    """The peak table as Parquet: zstd, no dictionaries, pages of 2 MiB."""
    peaks.write.mode(mode).option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.page.size", 2 << 20).parquet(path)
