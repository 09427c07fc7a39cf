import base64
import math

import duckdb
import pytest

import __spark_entry__ as entry
from peakloom.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf, oracle, name):
    df = core.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    assert rows
    if name in core.oracle_sql():
        result = oracle.execute(core.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert norm(rows) == norm([[r[k] for k in order] for r in result.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_base64_of_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = core.queries()["base64_roundtrip"](spark, sf).collect()
    assert {r.doc_id: r.restored for r in rows} == texts and max(map(len, texts.values())) > 1000
    assert all(base64.b64decode(r.b64, validate=True) == r.restored.encode() for r in rows)


def test_pivot_leaves_nothing_out(spark, sf, oracle):
    rows = core.queries()["tic_pivot"](spark, sf).drop("user_id").collect()
    total = oracle.execute("select cast(sum(cast(round(value * 100) as bigint)) as bigint) from events").fetchone()[0]
    assert sum(v for r in rows for v in r if v is not None) == total
