import hashlib
import os
import pickle
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom import api, cli
from peakloom.functions import codecs
from peakloom.functions import transforms as T
from peakloom.operators.analysis import validate
from peakloom.plans import queries as core
from peakloom.sources import container, external, mzml
from peakloom.sources.container import Container, Options


def spectra(n=12, size=40, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        level = 1 + k % 4
        mz = np.sort(rng.random(size) * 900 + 100)
        out.append({"scan": 3 * k + 5, "ms_level": level, "retention_time": 0.5 * k, "mz": mz, "intensity": rng.random(size) * 1e4} | ({"precursor": 400.5 + k, "charge": 2} if level > 1 else {}))
    return out


CASES = {
    "mz64_int32_zlib": dict(mz_type="<f8", intensity_type="<f4", compression=codecs.ZLIB),
    "mz64_int64_none": dict(mz_type="<f8", intensity_type="<f8"),
    "mz32_int32_zlib": dict(mz_type="<f4", intensity_type="<f4", compression=codecs.ZLIB),
    "mz32_int32_none": dict(mz_type="<f4", intensity_type="<f4"),
    "kind_after_type": dict(mz_type="<f8", intensity_type="<f4", kind_first=False),
}


def made(case="mz64_int32_zlib", rows=None):
    return mzml.write_document(spectra() if rows is None else rows, **CASES[case])


@pytest.mark.parametrize("case", CASES)
def test_records(case):
    rows = spectra()
    got = list(mzml.scan_document(made(case)))
    assert len(got) == len(rows)
    for k, (r, g) in enumerate(zip(rows, got)):
        assert (g["index"], g["scan"], g["ms_level"], g["retention_time"]) == (k, r["scan"], r["ms_level"], r["retention_time"])
        assert (g["precursor"], g["charge"]) == (r.get("precursor"), r.get("charge"))
        assert g["mz"] == r["mz"].astype(CASES[case]["mz_type"]).astype(float).tolist()
        assert g["intensity"] == r["intensity"].astype(CASES[case]["intensity_type"]).astype(float).tolist()


def test_records_are_split_at_their_starts():
    data = made()
    for parts in (1, 2, 5, 50):
        cuts = [len(data) * k // parts for k in range(parts + 1)]
        got = [r["scan"] for a, b in zip(cuts, cuts[1:]) for r in mzml.scan_document(data, a, b)]
        assert got == [s["scan"] for s in spectra()]


def test_degenerate_documents():
    empty = [{"scan": 1, "ms_level": None, "retention_time": None, "mz": [], "intensity": []}]
    (g,) = mzml.scan_document(mzml.write_document(empty))
    assert (g["mz"], g["intensity"], g["ms_level"], g["retention_time"]) == ([], [], None, None)
    whole = made()
    assert len(list(mzml.scan_document(whole[: len(whole) // 2]))) < 12
    assert list(mzml.scan_document(b"")) == []
    assert mzml.is_document(whole) and not mzml.is_document(mzml.write_document(spectra(), indexed=False))


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("block", [10**9, 5000, 1])
@pytest.mark.parametrize("codec", ["zstd", "lz4", "none"])
def test_container_gives_the_document_back(case, block, codec):
    data = made(case)
    c = Container(container.compress(data, Options(blocksize=block, targets=dict.fromkeys(container.STREAMS, codec))))
    assert c.decompress() == data and c.md5 == hashlib.md5(data).hexdigest()
    assert len(c) == 12 and c.footer["original_filesize"] == len(data)
    assert len(c.divisions) == 1 + max(1, min(12, len(data) // block))
    for k in (0, 5, 11):
        row = list(mzml.scan_document(data))[k]
        assert c.array("mz", k).tolist() == row["mz"] and c.array("inten", k).tolist() == row["intensity"]
        assert c.spectrum_xml(k) == data[row["spec_start"] : row["spec_end"]]
    with pytest.raises(IndexError):
        c.array("mz", 12)


def test_container_layout():
    data = made()
    raw = container.compress(data, Options(blocksize=4000))
    assert struct.unpack_from("<3I", raw) == (0x035F51B5, 1, 0)
    assert struct.unpack_from("<4I", raw, 140) == (1000523, 1000521, 1000574, 12)
    assert struct.unpack_from("<3I", raw, 156) == (4700001, 4700000, 4700000)
    footer = struct.unpack("<9Q4i", raw[-88:])
    assert struct.unpack_from("<i", raw, len(raw) - 88 + 76)[0] == 0x035F51B5 and footer[0] == 512
    c = Container(raw)
    first = c.block("mz", 0)
    n = struct.unpack_from("<I", first)[0]
    assert n == 40 * 8 and np.frombuffer(first, "<f8", 40, 4).tolist() == list(mzml.scan_document(data))[0]["mz"]
    assert c.blocks["xml"][1][2] == 512 + c.blocks["xml"][0][1]
    for bad in (b"", raw[:100], b"x" * 1000, raw[:-20] + b"\0" * 20):
        with pytest.raises(ValueError):
            Container(bad)


@pytest.mark.parametrize("name", list(T.TRANSFORMS))
def test_lossy_containers(name):
    data = made("mz64_int64_none")
    o = Options(blocksize=3000, mz=name, intensity="log" if name != "log" else "vbr")
    back = list(mzml.scan_document(Container(container.compress(data, o)).decompress()))
    for r, g in zip(mzml.scan_document(data), back):
        assert len(g["mz"]) == len(r["mz"]) and (g["scan"], g["ms_level"]) == (r["scan"], r["ms_level"])
        want = T.decode(T.encode(np.array(r["mz"]), name), name, "<f8")
        assert np.allclose(g["mz"], want, rtol=0, atol=1e-9)


def test_odd_documents_in_containers():
    rows = spectra(4)
    rows[1]["mz"], rows[1]["intensity"] = np.zeros(0), np.zeros(0)
    rows.append({"scan": 99, "ms_level": 1, "retention_time": None, "mz": np.arange(70_000.0), "intensity": np.zeros(70_000)})
    for own in (rows, rows[:1], []):
        data = mzml.write_document(own, **CASES["mz64_int32_zlib"])
        for block in (1, 10**9):
            assert Container(container.compress(data, Options(blocksize=block))).decompress() == data


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.mzML").write_bytes(mzml.write_document(spectra(6 + k, seed=k), **CASES["mz64_int32_zlib"]))
    return tmp_path


def test_spark_tables(spark, folder):
    docs = mzml.read_documents(spark, f"{folder}/in/*.mzML")
    assert docs.count() == 21 and docs.where("ms_level = 1").count() == 6
    slim = mzml.read_documents(spark, f"{folder}/in", ["file", "scan"])
    assert slim.columns == ["file", "scan"] and slim.count() == 21
    with pytest.raises(ValueError):
        mzml.read_documents(spark, f"{folder}/in", ["nothing"])
    made = container.compress_files(spark, f"{folder}/in", f"{folder}/out", Options(blocksize=3000)).collect()
    assert len(made) == 3 and all(os.path.getsize(r.output) == r.compressed_size for r in made)
    back = container.read_containers(spark, f"{folder}/out/*.msz")
    key = lambda df: sorted((os.path.basename(r.file).split(".")[0], r["index"], r.scan, r.mz, r.intensity) for r in df.collect())
    assert key(back) == key(docs)
    assert container.read_containers(spark, f"{folder}/out/*.msz", [2, 5]).count() == 6
    b = container.blocks(spark, f"{folder}/out/*.msz")
    f = container.footers(spark, f"{folder}/out/*.msz")
    assert b.where("stream = 'mz'").groupBy().sum("compressed_size").first()[0] > 0 and f.count() == 3
    report = validate(docs.selectExpr("file", "scan", "mz[0] m"), docs.selectExpr("file", "scan", "mz[0] + 0.2 m").where("scan > 5"), ["file", "scan"], {"m": 0.1}).first()
    assert (report.n_rows, report.only_left, report.only_right, report.m_apart) == (21, 3, 0, 18)
    container.write_parquet(docs.drop("xml"), f"{folder}/pq", 2)
    assert spark.read.parquet(f"{folder}/pq").where("index = 3").count() == 3
    peaks = mzml.to_peaks(docs)
    container.write_peaks(peaks, f"{folder}/peaks")
    assert spark.read.parquet(f"{folder}/peaks").count() == 21 * 40
    assert dict(peaks.dtypes) == {"spec_no": "int", "ret_time": "float", "mz": "float", "int": "float", "ms_level": "tinyint", "precursor": "float", "charge": "tinyint", "mass_bin": "smallint"}


def test_data_source(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    mzml.register(spark)
    for parts in (1, 4):
        df = spark.read.format("mzml").option("partitions", parts).load(f"{folder}/in")
        assert df.count() == 21 and df.where("ms_level = 2 and scan > 8").count() == 3
    slim = spark.read.format("mzml").option("columns", "scan, ms_level").load(f"{folder}/in")
    assert slim.columns == ["scan", "ms_level"] and slim.where("scan in (5, 8)").count() == 6


def test_external(spark, tmp_path):
    data = os.urandom(1001)
    (tmp_path / "x.bin").write_bytes(data)
    (tmp_path / "y.msz").write_bytes(container.compress(made()))
    (tmp_path / "z.mzML").write_bytes(made())
    pieces = external.read_chunks(spark, f"{tmp_path}/x.bin", 4).orderBy("chunk").collect()
    assert b"".join(bytes(r.piece) for r in pieces) == data and [len(r.piece) for r in pieces] == [250, 250, 250, 251]
    kinds = {os.path.basename(r.path): r.kind for r in external.sniff(spark, f"{tmp_path}/*").collect()}
    assert kinds == {"x.bin": "external", "y.msz": "container", "z.mzML": "document"}
    with pytest.raises(ValueError):
        external.read_chunks(spark, f"{tmp_path}/x.bin", 0)


@pytest.fixture
def both(tmp_path):
    doc = tmp_path / "a.mzML"
    doc.write_bytes(made())
    assert cli.main([str(doc)]) == 0
    return str(doc), str(tmp_path / "a.msz")


def test_files_as_objects(both):
    rows = spectra()
    for path in both:
        with api.read(path) as f:
            assert len(f.spectra) == 12 and f.filesize == os.path.getsize(path)
            for s, r in zip(f.spectra, rows):
                assert (s.scan, s.ms_level, s.retention_time, s.size) == (r["scan"], r["ms_level"], r["retention_time"], 40)
                assert s.peaks.shape == (40, 2) and (s.mz == r["mz"]).all() and s.xml.tag.endswith("spectrum")
            assert f.spectra[3] is f.spectra[3] and "index=3" in repr(f.spectra[3])
            for bad in (12, -1):
                with pytest.raises(IndexError):
                    f.spectra[bad]
            assert f.select(level=2) == [1, 5, 9] and f.select(level="n") == [2, 3, 6, 7, 10, 11]
            assert f.select(scans="[5-8,14]") == [0, 1, 3] and f.select(indices="[0-2]") == [0, 1, 2]
            with pytest.raises(ValueError):
                f.select(level=1, indices="1")
            assert pickle.loads(pickle.dumps(f)).path == path
            assert f.describe()["path"] == path
    assert api.read(both[0].encode()).path == both[0]


def test_read_errors(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing")
    for path, error in ((3, ValueError), (str(tmp_path / "no"), FileNotFoundError), (str(tmp_path), IsADirectoryError), (str(tmp_path / "x"), OSError)):
        with pytest.raises(error):
            api.read(path)
    assert api.filesize(str(tmp_path)) == 0 and api.num_threads() > 0


def test_command_line(both, tmp_path, capsys):
    doc, packed = both
    original = open(doc, "rb").read()
    assert cli.main([packed, str(tmp_path / "b.mzML")]) == 0 and (tmp_path / "b.mzML").read_bytes() == original
    assert cli.main([packed, "--describe"]) == 0
    head, row = capsys.readouterr().out.strip().splitlines()
    assert head.split(",")[7] == "num_spectra" and row.split(",")[7] == "12"
    for source in both:
        out = tmp_path / "sub.mzML"
        assert cli.main([source, str(out), "--extract", "--ms-level", "2"]) == 0
        assert [r["scan"] for r in mzml.scan_document(out.read_bytes())] == [8, 20, 32]
    assert cli.main([doc, str(tmp_path / "s.msz"), "--extract-indices", "[0-3]"]) == 0
    with api.read(str(tmp_path / "s.msz")) as f:
        assert [s.scan for s in f.spectra] == [5, 8, 11, 14]
    assert cli.main([doc, str(tmp_path / "l.msz"), "-z", "delta32", "-i", "log", "-b", "5KB", "--target-mz-format", "lz4", "--zstd-compression-level", "1"]) == 0
    with api.read(str(tmp_path / "l.msz")) as f:
        assert np.abs(f.spectra[2].mz - spectra()[2]["mz"]).max() < 0.1
    (tmp_path / "x.bin").write_bytes(b"opaque" * 50)
    assert cli.main([str(tmp_path / "x.bin")]) == 0 and cli.main([str(tmp_path / "x.bin.msz"), str(tmp_path / "y.bin")]) == 0
    assert (tmp_path / "y.bin").read_bytes() == b"opaque" * 50
    assert cli.main([str(tmp_path / "none")]) == 1 and cli.main([doc, "--zstd-compression-level", "40"]) == 1
    for bad in (["--ms-level", "0"], ["-b", "5XB"], ["-z", "delta8"], ["--mz-scale-factor", "-1"], ["-t", "-2"]):
        with pytest.raises(SystemExit):
            cli.main([doc, *bad])


def test_source_name():
    assert mzml.source_name(made()) == "made.raw" and mzml.source_name(b"<mzML>") is None


def test_output_names():
    assert [api.extract_name(p) for p in ("/x/a.mzML", "a.b.msz", "/d.e/f")] == ["/x/extract_a.mzML", "extract_a.b.mzML", "/d.e/extract_f.mzML"]
    assert [api.output_name(p, k) for p, k in (("a.mzML", "document"), ("a", "document"), ("a.msz", "container"), ("a.x", "container"), ("a.txt", "external"))] == ["a.msz", "a.msz", "a", "a.x.mzML", "a.txt.msz"]


def test_a_container_refuses_mixed_types():
    one, two = (mzml.write_document(spectra(1), mz_type=t) for t in ("<f8", "<f4"))
    element = two[two.index(b"<spectrum ") : two.index(b"</spectrum>") + len(b"</spectrum>")]
    at = one.index(b"</spectrum>") + len(b"</spectrum>")
    with pytest.raises(ValueError, match="can't hold both"):
        container.compress(one[:at] + b"\n" + element + one[at:])


def test_decompression_checks_the_md5():
    data = container.compress(made())
    assert Container(data).decompress() == made()
    bad = bytearray(data)
    bad[container.MD5_OFFSET] ^= 1
    with pytest.raises(ValueError, match="MD5"):
        Container(bytes(bad)).decompress()


def test_one_spectrum_costs_one_division_once(monkeypatch):
    rows = spectra(300)
    data = mzml.write_document(rows)
    c = Container(container.compress(data, Options(blocksize=len(data) // 3)))
    calls = []
    decode = Container._decode
    monkeypatch.setattr(Container, "_decode", lambda self, s, k: calls.append((s, k)) or decode(self, s, k))
    whole = list(container._SPECTRUM.finditer(data))
    for i in range(300):
        assert c.spectrum_xml(i) == whole[i].group() and np.array_equal(c.array("mz", i), rows[i]["mz"])
    assert len(calls) == len(set(calls)) == 2 * sum(bool(d.spectra) for d in c.divisions)


def test_steps_share_a_worker(spark, sf):
    """Documents written, compressed, decompressed and read again take one Python worker a task, not one a step."""
    python = lambda df: len(re.findall(r"(?:MapInPandas|FlatMapGroupsInPandas)", df._jdf.queryExecution().optimizedPlan().toString()))
    for name in ("mzml_roundtrip", "container_roundtrip", "container_decompress", "container_lookup", "subset_roundtrip"):
        assert python(core.queries()[name](spark, sf)) == 1, name


def test_chains_of_steps(spark):
    """Every step's outcome can be used on its own, more than once, and a chain without rows is empty."""
    documents = [(str(k), mzml.write_document(spectra(12, seed=k), **CASES["mz64_int32_zlib"])) for k in range(5)]
    rows = spark.createDataFrame([(k, n, n) for k in range(5) for n in range(4)], "file bigint, scan bigint, ms_level int")
    rows = rows.select("*", F.lit(1.5).alias("retention_time"), F.array(F.lit(1.0), F.col("scan") + 2.0).alias("mz"), F.array(F.lit(3.0), F.lit(4.0)).alias("intensity"))
    for source in (spark.createDataFrame(documents, "path string, content binary"), mzml.documents_of(rows, "file")):
        originals = {r.path: bytes(r.content) for r in source.collect()}
        made = container.compress_contents(source, container.Options(blocksize=500))
        packed = {r.path: bytes(r.content) for r in made.collect()}
        assert packed == {k: container.compress(v, container.Options(blocksize=500)) for k, v in originals.items()}
        again = container.decompress_contents(made)
        assert {r.path: bytes(r.content) for r in again.collect()} == originals and len(originals) == 5
        assert {r.path: bytes(r.content) for r in made.collect()} == packed
        n = sum(len(container.Container(x)) for x in packed.values())
        assert mzml.spectra_of(again).count() == container.spectra_of(made).count() == n
        assert container.spectra_of(made, []).collect() == [] and container.footers_of(made).agg(F.sum("num_spectra")).first()[0] == n
        assert mzml.spectra_of(container.extract_contents(made, [1, 3, 99])).count() == 10
        assert mzml.spectra_of(again.filter("path = '3'")).count() == len(container.Container(packed["3"]))
