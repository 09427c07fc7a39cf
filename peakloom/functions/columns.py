"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of block sizes and their decimal factors.
SIZE_SUFFIXES = {"KB": 1_000, "MB": 1_000_000, "GB": 1_000_000_000}
# Magic number of the container, and what marks an indexed document.
CONTAINER_MAGIC = 0x035F51B5
INDEXED_MARK = "indexedmzML"
# Fixed value: the polynomial of the mass bins is divided by this.
BIN_WIDTH = 5


def block_size(literal: Column) -> Column:
    """Bytes of `10KB`, `5MB`, `1GB`; -1 for anything else."""
    number = F.regexp_extract(literal, r"^([0-9]+)(KB|MB|GB)$", 1)
    suffix = F.regexp_extract(literal, r"^([0-9]+)(KB|MB|GB)$", 2)
    factor = F.lit(None).cast("bigint")
    for name, value in SIZE_SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(value).cast("bigint")).otherwise(factor)
    return F.coalesce(F.when(number != "", number.cast("bigint") * factor), F.lit(-1).cast("bigint"))


def format_bytes(size: Column) -> Column:
    """`1.5 KB`: powers of 1024, two decimals cut to what is needed, rounded half up."""
    hundredths = lambda unit: F.floor((size * 100 + unit // 2) / unit).cast("bigint") if unit > 1 else size.cast("bigint") * 100

    def text(unit: int, name: str) -> Column:
        h = hundredths(unit)
        whole, rest = F.floor(h / 100).cast("bigint"), F.pmod(h, F.lit(100))
        fraction = F.when(rest == 0, "").when(F.pmod(rest, F.lit(10)) == 0, F.concat(F.lit("."), F.floor(rest / 10).cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
        return F.concat(whole.cast("string"), fraction, F.lit(f" {name}"))

    return F.when(size < 1024, text(1, "Bytes")).when(size < 1 << 20, text(1 << 10, "KB")).when(size < 1 << 30, text(1 << 20, "MB")).otherwise(text(1 << 30, "GB"))


def smart_trim(text: Column, most: int) -> Column:
    """The text with its middle cut out for `...`, if it is longer than `most` characters."""
    keep = most - 3
    left = (keep + 1) // 2
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, left), F.lit("..."), F.right(text, F.lit(keep - left))))


def output_name(path: Column, kind: Column) -> Column:
    """Where a result goes: documents change their extension to the container's, containers lose it, others get it added."""
    swapped = F.when(path.rlike(r"\.[^./]*$"), F.regexp_replace(path, r"\.[^./]*$", ".msz")).otherwise(F.concat(path, F.lit(".msz")))
    stripped = F.when(path.endswith(".msz"), F.regexp_replace(path, r"\.msz$", "")).otherwise(F.concat(path, F.lit(".mzML")))
    return F.when(kind == "document", swapped).when(kind == "container", stripped).otherwise(F.concat(path, F.lit(".msz")))


def file_type(content: Column) -> Column:
    """document, container or external, from the first bytes."""
    magic = F.lit(CONTAINER_MAGIC.to_bytes(4, "little"))
    head = F.substring(content, 1, 512)
    return F.when(F.substring(content, 1, 4) == magic, "container").when(F.contains(head, F.lit(INDEXED_MARK.encode())), "document").otherwise("external")


def accession_label(code: Column) -> Column:
    return F.concat(F.lit("MS:"), code.cast("string"))


def accession_code(label: Column) -> Column:
    return F.regexp_extract(label, r"^MS:([0-9]+)$", 1).cast("int")


def mass_bin(mz: Column, coefficients: tuple[float, ...]) -> Column:
    """floor of a polynomial in mz over BIN_WIDTH, at least 0; Horner's rule, highest power first."""
    value = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        value = value * mz + F.lit(float(c))
    return F.greatest(F.lit(0), F.floor(value / BIN_WIDTH)).cast("int")


def level_bucket(level: Column) -> Column:
    """MS1, MS2, and MSn for all above."""
    return F.when(level > 2, "MSn").otherwise(F.concat(F.lit("MS"), level.cast("string")))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two values agree; two missing ones do, one missing one doesn't."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= tolerance)
