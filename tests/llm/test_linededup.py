import random

import pytest
from pyspark.sql import functions as F

from peakloom.llm import linededup


def brute(rows, t=80):
    """{(doc_id, text): kept line numbers}, and whether a document had a word."""
    lines = []
    for d, text in {(d, x) for d, x in rows}:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            words = frozenset(w for w in line.split(" ") if w)
            if words:
                lines.append((d, text, k, words))
    out = {}
    for d, text, k, w in lines:
        earlier = [x for x in lines if before((x[0], x[1], x[2]), (d, text, k))]
        if not any(100 * len(w & x[3]) >= t * len(w | x[3]) for x in earlier):
            out.setdefault((d, text), []).append(k)
    return {k: sorted(v) for k, v in out.items()}


def kept(df, *args):
    """{doc_id: kept line numbers} of the documents that keep some."""
    t1, t2 = linededup._keys(F.col("doc_id"), F.col("text"))
    rows = df.select("doc_id", t1.alias("t1"), t2.alias("t2"))
    return {r.doc_id: r.kept for r in rows.join(linededup.kept_lines(df, *args), ["t1", "t2"]).collect()}


ORDER = {}


def before(a, b):
    rank = lambda p: (p[0] is not None, p[0] or 0, ORDER[p[:2]], p[2])
    return rank(a) < rank(b)


def order_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").filter("text is not null")
    t1, t2 = linededup._keys(F.col("doc_id"), F.col("text"))
    ORDER.update({(r.doc_id, r.text): (r.a, r.b) for r in df.select("doc_id", "text", t1.alias("a"), t2.alias("b")).collect()})


def corpus(seed, n):
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    line = lambda: [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 40, 90, 140, 300]))]
    lines = [line() for _ in range(n)]
    for _ in range(n):  # near copies, around the threshold
        own = list(rng.choice(lines))
        for _ in range(rng.randrange(1 + len(own) // 4)):
            own[rng.randrange(len(own))] = rng.choice(rare)
        lines.append(own)
    rng.shuffle(lines)
    docs = []
    while lines:
        k = rng.randint(1, 6)
        docs.append((len(docs), "\n".join(rng.choice([" ", "  ", "   "]).join(x) if rng.random() < 0.2 else " ".join(x) for x in lines[:k]) + rng.choice(["", "\n", "\n \n"])))
        lines = lines[k:]
    return docs


@pytest.mark.parametrize(("seed", "threshold", "bins", "broadcast"), [(1, 80, 1 << 10, 10**9), (2, 80, 16, 0), (3, 90, 1 << 17, 10**9), (4, 60, 64, 10**9)])
def test_matches_brute_force(spark, seed, threshold, bins, broadcast):
    rows = corpus(seed, 120)
    order_of(spark, rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = kept(df, threshold, bins, broadcast)
    want = brute(rows, threshold)
    assert got == {d: v for (d, _), v in want.items()}
    assert sum(map(len, got.values())) < sum(len(t.split("\n")) for _, t in rows) * 0.9


ROWS = [
    (None, "the first of all lines\nshared line with five words"),
    (3, None),
    (2, ""),
    (1, "shared line with five words\n\n own line here\t\nfive words with line shared  "),
    (4, "shared line with five words"),
    (4, "shared line with five words"),
    (5, " \n  \n"),
    (6, "a"),
    (7, "a\na\nb"),
    (7, "a\na\nb"),
    (8, "w1 w2 w3 w4 w5 w6 w7 w8 w9 x"),
    (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 y"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, "z", 0) for r in ROWS], "doc_id bigint, text string, kept int, k1 string, t1 int")
    order_of(spark, ROWS)
    want = brute(ROWS)
    rows = linededup.report(df).collect()
    assert len(rows) == len(ROWS)
    assert sorted((str(r.doc_id), r.n_lines, r.kept_lines) for r in rows) == sorted(
        (str(d), sum(bool(x.strip(" ")) for x in (t or "").split("\n")), ",".join(map(str, want.get((d, t), [])))) for d, t in ROWS
    )
    out = linededup.deduplicate(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert (1, "\n own line here\t") in got and (9, "w1 w2 w3 w4 w5 w6 w7 w8 w9 y") not in got
    assert (3, None) in got and (2, "") in got and (5, " \n  \n") in got
    assert (4, "shared line with five words") not in got
    assert got.count((7, "b")) == 2
    assert linededup.report(df.limit(0)).count() == 0 and linededup.deduplicate(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    n = 150_000
    df = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("only w"), "id", F.lit(" v"), "id").alias("text"))
    rows = linededup.report(df).groupBy("n_lines", "n_kept", "kept_lines").count().collect()
    assert [tuple(r) for r in rows] == [(1, 1, "0", n)]
    named = spark.createDataFrame([("b", "p q r s t"), ("a", "x\nt s r q p"), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: r.kept_lines for r in linededup.report(named).collect()}
    assert got == {None: "0", "a": "1", "b": ""}
    assert {(r.doc_id, r.text) for r in linededup.deduplicate(named).collect()} == {(None, "x"), ("a", "t s r q p")}


def test_thresholds_at_the_ends(spark):
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "a b c"), (4, "d c b a"), (5, "a b c e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order_of(spark, rows)
    for t in (1, 75, 80, 100):
        assert kept(df, t) == {d: v for (d, _), v in brute(rows, t).items()}, t


def test_a_hot_line_and_a_hot_cluster(spark):
    hot = [f"h{k}" for k in range(30)]
    near = lambda k: [f"v{k}" if i == k % 30 else w for i, w in enumerate(hot)]
    rows = [(k, " ".join(hot) + "\n" + " ".join(near(k))) for k in range(400)] + [(1000 + k, f"lone line number {k} x{k} y{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = kept(df)
    assert got == {0: [0]} | {1000 + k: [0] for k in range(100)}


def test_no_python_on_the_main_path(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = linededup.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, "a b\n\nc"), (2, None), (3, "")], "doc_id bigint, text string")
    lines = linededup._lines(df)
    assert sorted((r.at.doc_id, r.at.line_no, r.line) for r in lines.collect()) == [(1, 0, "a b"), (1, 2, "c")]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
