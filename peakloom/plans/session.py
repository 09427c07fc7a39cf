"""What a Spark session needs before Python functions of this package can run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, unless PYTHONPATH already has it."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_peakloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="peakloom-"), "peakloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "peakloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(path)
    sc._peakloom_shipped = True
