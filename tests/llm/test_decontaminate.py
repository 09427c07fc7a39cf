import hashlib
import random
import re

from peakloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} if item is not None else set()
        ids = ",".join(sorted(found))
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def as_dict(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def fixture():
    rng = random.Random(3)
    vocabulary = ["a", "bb", "ccc", "dé", "É1", "日本", "x9", "the", "of", "to", "in"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "--"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(8)] + [(8, None), (9, "!!"), (3, "the of the"), (None, "zz zz zz")]
    docs = [(k, text(rng.randrange(60))) for k in range(60)]
    docs += [(100 + k, f"{text(5)} {(t or '').upper()} {text(5)}") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "Zz zz-ZZ zz"), (204, text(3000))]
    return docs, items


def test_report_matches_brute_force(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, hits int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert as_dict(decontaminate.report(d, b)) == want
    assert any(x[4] for x in want.values()) and not all(x[4] for x in want.values())
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, x in want.items() if not x[4]}


def test_benchmark_beyond_the_bound_gives_the_same(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = decontaminate.contamination(d, b, clean=True).select("doc_id", "hits.*").collect()
    parts = decontaminate.contamination(d, b, bound=100, clean=True).select("doc_id", "hits.*").collect()
    assert sorted(whole) == sorted(parts)


def test_empty_tables(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert as_dict(decontaminate.report(d, b.limit(0))) == brute(docs, [])
    assert as_dict(decontaminate.report(d.limit(0), b)) == {}


def test_remove_spans(spark):
    d = spark.createDataFrame([(1, "keep This, one two THREE four five end."), (2, "none"), (3, None)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert got == {1: "keep This, end.", 2: "none", 3: None}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 64)
    docs, items = fixture()
    data = [t if t is None else t.encode() for _, t in docs]
    held = decontaminate.WindowSet([(None if i is None else str(i), t and t.encode()) for i, t in items])
    n_words, masks, found, _ = decontaminate.scan(data, held)
    want = brute(docs, [(i, t) for i, t in items])
    for (key, _), n, m, f in zip(docs, n_words, masks, found):
        assert (n, 0 if m is None else m.sum(), len({held.ids[i] for i in f} - {None})) == want[key][:3]


def test_a_block_takes_a_bounded_multiple_of_its_text():
    rng = random.Random(1)
    for word in (lambda: rng.choice("abcdefgh"), lambda: "".join(rng.choice("abcdefgh") for _ in range(6))):
        items = [(str(k), " ".join(word() for _ in range(400)).encode()) for k in range(500)]
        made = decontaminate.WindowSet(items)
        assert made.nbytes() <= decontaminate.HELD * sum(len(t) for _, t in items)
    assert decontaminate.BOUND * decontaminate.HELD <= 200 << 20


def test_items_that_share_a_window():
    items = [(str(k), b"one two three four five six seven eight nine ten" + (b" more" if k % 2 else b"")) for k in range(6)]
    made = decontaminate.WindowSet(items)
    n_words, masks, found, _ = decontaminate.scan([b"x One two three four five six seven eight nine ten y", b"nine ten more", b"", None], made)
    assert found == [set(range(6)), set(), set(), set()] and masks[0].sum() == 10 and n_words.tolist() == [12, 3, 0, 0]
