"""Command line: compress, decompress, extract, describe. `python -m peakloom.cli INPUT [OUTPUT] [options]`."""

from __future__ import annotations

import argparse
import csv
import re
import struct
import sys
import time

from . import api
from .functions import codecs
from .functions import transforms as T
from .functions.columns import SIZE_SUFFIXES
from .sources.container import FOOTER_NAMES, Options

_EXTERNAL = b"PLXT"


def block_size(text: str) -> int:
    m = re.fullmatch(r"([0-9]+)(KB|MB|GB)", text)
    if not m or not int(m.group(1)):
        raise argparse.ArgumentTypeError(f"no block size: {text!r} (like 10MB)")
    return int(m.group(1)) * SIZE_SUFFIXES[m.group(2)]


def _scale(text: str) -> float:
    try:
        return T.parse_scale(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def _level(text: str) -> int | str:
    if text == "n" or text.isdigit() and int(text) > 0:
        return text if text == "n" else int(text)
    raise argparse.ArgumentTypeError(f"no level: {text!r}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="peakloom", description="Compress documents of spectra into containers, and back; extract; describe.")
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-t", "--threads", type=int, default=0, help="kept for scripts; Spark decides how many tasks run")
    p.add_argument("-z", "--mz-lossy", choices=sorted(T.TRANSFORMS), default="lossless")
    p.add_argument("-i", "--int-lossy", choices=sorted(T.TRANSFORMS), default="lossless")
    p.add_argument("-b", "--blocksize", type=block_size, default=100_000_000)
    p.add_argument("-c", "--checksum", action="store_true", help="print the MD5 of the document")
    p.add_argument("-d", "--describe", action="store_true")
    p.add_argument("--mz-scale-factor", type=_scale)
    p.add_argument("--int-scale-factor", type=_scale)
    p.add_argument("--extract-indices")
    p.add_argument("--extract-scans")
    p.add_argument("--ms-level", type=_level)
    p.add_argument("--extract", action="store_true", help="write the chosen spectra as a document")
    for s in ("xml", "mz", "inten"):
        p.add_argument(f"--target-{s}-format", type=codecs.codec_name, default="zstd")
    p.add_argument("--zstd-compression-level", type=int, default=codecs.DEFAULT_LEVEL)
    p.add_argument("-V", "--version", action="version", version="peakloom 1")
    return p


def _write(path: str, data: bytes) -> None:
    with open(path, "wb") as f:
        f.write(data)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.threads < 0:
        parser().error("threads must not be negative")
    began = time.time()
    try:
        options = Options(a.blocksize, a.mz_lossy, a.int_lossy, a.mz_scale_factor, a.int_scale_factor, a.zstd_compression_level, {"xml": a.target_xml_format, "mz": a.target_mz_format, "inten": a.target_inten_format})
        kind = api.kind_of(a.input)
        out = a.output or api.output_name(a.input, kind)
        if kind == "external":
            with open(a.input, "rb") as f:
                data = f.read()
            if data[:4] == _EXTERNAL:
                (size,) = struct.unpack_from("<Q", data, 4)
                _write(a.output or re.sub(r"\.msz$", "", a.input), codecs.decompressor("zstd")(data[12:], size))
            else:
                _write(out, _EXTERNAL + struct.pack("<Q", len(data)) + codecs.compressor("zstd", a.zstd_compression_level)(data))
            return 0
        with api.read(a.input) as f:
            chosen = f.select(a.extract_indices, a.extract_scans, a.ms_level)
            picked = any(x is not None for x in (a.extract_indices, a.extract_scans, a.ms_level))
            if a.describe:
                if kind == "container":
                    w = csv.writer(sys.stdout)
                    w.writerow(FOOTER_NAMES)
                    w.writerow([f.container.footer[n] for n in FOOTER_NAMES])
                else:
                    print(f.format)
            elif a.extract:
                _write(a.output or api.extract_name(a.input), f.extract(chosen))
            elif kind == "document":
                f.compress(out, options, chosen if picked else None)
            elif picked:
                _write(out, f.extract(chosen))
            else:
                f.decompress(out)
            if a.checksum and kind == "container":
                print(f.container.md5)
    except (OSError, ValueError, TypeError) as e:
        print(f"peakloom: {e}", file=sys.stderr)
        return 1
    if a.verbose:
        print(f"{time.time() - began:.3f} s, {api.filesize(a.input)} bytes read", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
