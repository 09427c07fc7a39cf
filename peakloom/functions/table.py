"""A table function: peaks of one spectrum's arrays."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..plans.session import ship


class _Peaks:
    def eval(self, mz: list, intensity: list):
        if mz is None or intensity is None:
            return
        if len(mz) != len(intensity):
            raise ValueError(f"{len(mz)} m/z values and {len(intensity)} intensities")
        for k, (m, i) in enumerate(zip(mz, intensity)):
            yield k, m, i


def register(spark: SparkSession) -> None:
    """SQL: `select * from peaks_of(array(1D, 2D), array(3D, 4D))`, or `lateral` beside a table."""
    ship(spark)
    spark.udtf.register("peaks_of", udtf(_Peaks, returnType="pos int, mz double, intensity double"))
