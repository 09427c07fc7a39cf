import os

import duckdb
import pytest
from pyspark.sql import functions as F

from peakloom.functions import columns, picture, table
from peakloom.operators import analysis, prefix, selection
from peakloom.plans import queries as core
from peakloom.sources import mzml
from peakloom.streaming import ingest

from .test_sources import CASES, spectra


@pytest.mark.parametrize(("text", "want"), [("", []), ("3", [(3, 3)]), ("1 2,5", [(1, 1), (2, 2), (5, 5)]), ("[1-5,8]", [(1, 5), (8, 8)]), ("1-3", [(1, 1), (3, 3)]), ("[1-2] 7", [(1, 2), (7, 7)])])
def test_ranges(text, want):
    assert selection.parse_ranges(text) == want


@pytest.mark.parametrize("text", ["[3-1]", "5,3", "[1-4,4]", "[1-", "x", "[1--2]", "[[1]]", "[-3]", "1]", "[0-2000000]"])
def test_bad_ranges(text):
    with pytest.raises(ValueError):
        selection.parse_ranges(text)


def test_selection(spark):
    df = spark.range(100).select(F.col("id").alias("index"), (F.col("id") * 2).alias("scan"), (F.col("id") % 4 + 1).cast("int").alias("ms_level"))
    assert selection.select_spectra(df, indices="[3-5,9]").count() == 4
    assert selection.select_spectra(df, scans="[3-8]").count() == 3
    assert selection.select_spectra(df, level="n").count() == 50 and selection.select_spectra(df, level=2).count() == 25
    assert selection.select_spectra(df).count() == 100
    many = [(3 * k, 3 * k) for k in range(100)]
    assert selection.by_ranges(df, "scan", many).count() == selection.by_ranges(df, "scan", many, few=1000).count() == 34
    with pytest.raises(ValueError):
        selection.select_spectra(df, indices="1", level=1)
    for bad in (0, "x", "-1"):
        with pytest.raises(ValueError):
            selection.by_level(df, bad)


def test_filters_reach_the_scan(spark, sf):
    rows = selection.by_ranges(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", [(1, 5)]).select("o_orderkey")
    plan = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderkey,1)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_prefix_scans(spark):
    rows = [(k * k % 101 - 50, k) for k in range(300)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key bigint, v bigint").withColumn("uid", F.monotonically_increasing_id())
    for bins in (1, 7, 1024):
        got = prefix.running_total(df, "key", F.col("v"), "before", ("uid",), bins).orderBy(F.col("key").asc_nulls_first(), "uid").collect()
        total = 0
        for r in got:
            assert r.before == total
            total += r.v
        index = sorted(r["index"] for r in prefix.global_index(df, "key", ties=("uid",), bins=bins).collect())
        assert index == list(range(302))
    assert prefix.global_index(df.limit(0), "key").count() == 0


@pytest.mark.parametrize("n", [1, 3, 10, 11, 500])
def test_divisions(spark, n):
    df = spark.range(11)
    got = [r.division_id for r in prefix.equal_count_divisions(df, "id", n).orderBy("id").collect()]
    k = min(n, 11)
    assert got == [min(k - 1, i // (11 // k)) for i in range(11)]


def test_interval_join_is_exact(spark):
    points = spark.createDataFrame([(k, 13 * k % 97) for k in range(60)], "p bigint, at bigint")
    spans = spark.createDataFrame([(k, 7 * k % 90, 7 * k % 90 + k % 23) for k in range(40)], "s bigint, lo bigint, hi bigint")
    want = {(a.p, b.s) for a in points.collect() for b in spans.collect() if b.lo <= a.at < b.hi}
    for width in (1, 10, 1000):
        got = [(r.p, r.s) for r in analysis.interval_join(points, spans, "at", "lo", "hi", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_scalar_functions(spark):
    text = spark.createDataFrame([("10KB",), ("3GB",), ("5",), ("x",), ("1.5MB",), (None,)], "t string")
    assert [r.b for r in text.select(columns.block_size(F.col("t")).alias("b")).collect()] == [10_000, 3_000_000_000, -1, -1, -1, -1]
    sizes = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1587, 10**7, 5 << 30)], "n bigint")
    assert [r.b for r in sizes.select(columns.format_bytes(F.col("n")).alias("b")).collect()] == ["0 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1.55 KB", "9.54 MB", "5 GB"]
    words = spark.createDataFrame([("short",), ("a rather long text",)], "t string")
    assert [r.b for r in words.select(columns.smart_trim(F.col("t"), 9).alias("b")).collect()] == ["short", "a r...ext"]
    pairs = spark.createDataFrame([(1.0, 1.05), (1.0, 1.2), (None, None), (1.0, None)], "a double, b double")
    assert [r.w for r in pairs.select(columns.within(F.col("a"), F.col("b"), 0.1).alias("w")).collect()] == [True, False, True, False]


def test_table_function(spark):
    table.register(spark)
    rows = spark.sql("select * from peaks_of(array(1D, 2D), array(3D, 4D))").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    with pytest.raises(Exception, match="m/z values"):
        spark.sql("select * from peaks_of(array(1D), array(3D, 4D))").collect()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    for k in range(2):
        (tmp_path / "in" / f"{k}.mzML").write_bytes(mzml.write_document(spectra(5, seed=k), **CASES["mz32_int32_none"]))
        ingest.ingest(*args).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 5 * (k + 1)
    assert os.path.exists(tmp_path / "checkpoint")


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.windowed_current(events, "ts", F.col("value"))
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_heat_map_of_values_without_logarithm(spark, tmp_path):
    """-inf of zero and NaN below it, as the query's SQL has it, not left out."""
    values = [(1, 0.0), (1, 0.25), (2, -3.0), (2, -3.1), (3, -0.0), (4, 2.0), (4, 2.25), (5, None), (6, float("nan")), (7, float("inf")), (8, 0.0), (8, None)]
    rows = [(k, None, u, "click", v, "{}") for k, (u, v) in enumerate(values)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = core.queries()["tic_heatmap"](spark, str(tmp_path)).select("mz_bin", "rt_bin", "cell", "n").collect()
    shown = lambda rows: sorted(tuple(str(v + 0.0 if isinstance(v, float) else v) for v in r) for r in rows)
    assert shown(got) == shown(con.execute(core.oracle_sql()["tic_heatmap"]).fetchall())
    assert {(r.rt_bin, r.n): r.cell for r in got}[1, 2] == float("-inf")


def test_pictures(spark, sf):
    import struct
    import zlib

    assert picture.hex_to_rgb("#0a10ff") == (10, 16, 255)
    colours = picture.colour_map(("#000000", "#ff0000"), 256)
    assert colours[0].tolist() == [0, 0, 0] and colours[255].tolist() == [255, 0, 0] and colours[128].tolist() == [128, 0, 0]
    cells = spark.createDataFrame([(1.0, 0, 0.0), (2.0, 1, 5.0)], "mz_bin double, rt_bin int, cell double")
    made = picture.heat_map_png(cells)
    width, height = struct.unpack(">2I", made[16:24])
    assert made.startswith(b"\x89PNG") and (width, height) == (2, 2)
    raw = zlib.decompress(made[made.index(b"IDAT") + 4 : -16])
    assert raw[1:4] == bytes(picture.colour_map()[0]) and raw[4:7] == bytes(picture.colour_map()[255])
    infinite = spark.createDataFrame([(1.0, 0, float("-inf")), (2.0, 1, 5.0)], cells.schema)
    assert picture.heat_map_png(infinite) == made
    assert picture.heat_map_png(cells.limit(0)).startswith(b"\x89PNG") and picture.to_base64(b"abc") == "YWJj"


def test_prefix_scans_of_any_span(spark):
    for keys in ([-(2**62), 0, 2**62, 2**63 - 1, -(2**63)], [5, 5, 5], [10**15, *range(50)]):
        df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key bigint, n bigint")
        got = prefix.global_index(df, "key", ties=("n",)).orderBy("index").collect()
        assert [(r["key"], r.n) for r in got] == sorted((k, n) for n, k in enumerate(keys)) and [r["index"] for r in got] == list(range(len(keys)))
