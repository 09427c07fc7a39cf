import html
import re

import pytest

from peakloom.llm import extract


@pytest.fixture(scope="module")
def model():
    return extract.trained()


def test_held_out_pages(model):
    right = total = 0
    for page, labels in extract.labelled_pages(150, seed=1234):
        got = model.decode(extract.blocks(page))
        assert len(got) == len(labels)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.99


def test_viterbi_matches_every_path(model):
    import itertools

    for page, _ in extract.labelled_pages(60, seed=5):
        found = extract.blocks(page)
        if not 1 <= len(found) <= 9:
            continue
        emit = [sum(model.weights.get(f, 0) for f in own) for own in extract.features(found)]

        def score(path, emit=emit):
            s = model.start[path[0]] + sum(e for e, y in zip(emit, path) if y)
            return s + sum(model.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(found)), key=score)
        assert score(tuple(map(int, model.decode(found)))) == pytest.approx(score(best))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text <b>here</b>", "plain text here"),
        ("<p>a &lt; b &amp;amp; c&#233;</p>", "a < b &amp; cé"),
        ("<article><p>One\n\t two&nbsp; three<br>four<p>Five</article>", "One two three four\nFive"),
        ("<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Text.</p><div class='comments'><p>Great read, thanks a lot.</p></div></article><footer>&copy; x</footer>", "Title\nText."),
        ("<body><header>Site</header><main><p>Body one.</p><div class=\"ad\">Buy now.</div><p>Body two.</p></main><aside><p>Other stories of the day.</p></aside></body>", "Body one.\nBody two."),
        ("<script>if (a < b) document.write('<p>x</p>')</script><style>p{}</style><article><p>Only this.</p></article><!-- <p>no</p> -->", "Only this."),
        ("<article><p>Cut off here <a href=\"x", "Cut off here"),
        ("<article><p>Text.</p></article><div id='cookie-notice'>We use cookies.</div><form><label>Mail</label><button>Go</button></form>", "Text."),
    ],
)
def test_pages(model, page, text):
    assert extract.main_text(page, model) == text


def test_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-1, "u", "")], pages.schema)
    rows = extract.main_texts(pages.union(extra)).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == pages.count() + 3 and (by[None].text, by[None].n_chars, by[-1].text) == ("", 0, "")
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert by[r.page_id].text == "\n".join(x for x in parts if x) and by[r.page_id].n_chars == len(by[r.page_id].text)
    assert extract.main_texts(pages.limit(0)).count() == 0


def test_deep_and_long_pages(model):
    page = "<div>" * 3000 + "<article><p>" + "word " * 200_000 + "end.</p></article>"
    assert extract.main_text(page, model).endswith("end.")


def test_head_ends_without_its_end_tag():
    found = lambda page: [t for _, t, _ in extract.blocks(page)]
    head = "<html><head><title>T</title><meta charset=utf-8><template><div>no</div></template><noscript><link rel=x></noscript><style>p{}</style>"
    for rest in ("<p>Text</p>", "<b>Text</b>", "Text", "<br>Text", "<div>Text</div>", "</head><body>Text", "<body>Text", "<script>1</script><h1>Text</h1>"):
        assert found(head + rest) == ["Text"], rest


def test_math_and_fallback_content_are_read():
    found = lambda page: [t for _, t, _ in extract.blocks(page)]
    assert found("<body><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == ["so x=1 holds"]
    for tag in ("noscript", "object", "video", "audio", "canvas", "map"):
        assert found(f"<body><div>a</div><{tag}><p>kept</p></{tag}><div>b</div>") == ["a", "kept", "b"], tag


@pytest.mark.parametrize(
    "page",
    [
        "<p a=\"x' " * 600_000,
        "<p a='x " * 600_000,
        "<p " * 1_000_000,
        "<div>a" * 100_000,
        "<div class=c>" * 100_000 + "</article></p>" * 100_000,
        "<p><div>" + "<x-y>" * 100_000 + "</p>" * 100_000,
        "<svg>" + "<g>" * 100_000 + "</q1>" * 100_000,
        "<" * 2_000_000,
        "<li>a<b>" * 200_000,
    ],
    ids=["mixed quotes", "open quotes", "open tags", "open divs", "no such end", "out of reach", "dropped", "brackets", "items"],
)
def test_odd_pages_take_linear_time(model, page):
    import time

    start = time.monotonic()
    extract.main_text(page, model)
    assert time.monotonic() - start < 30


def test_quotes_hide_brackets():
    found = lambda page: [t for _, t, _ in extract.blocks(page)]
    assert found("<p title=\"a > b\" x='c > d'>one</p><p a='>'>two") == ["one", "two"]
    assert found("<p a=\"x>one</p><p>two</p>") == ["one", "two"]
    assert found("<p a=\"x<b>one</b></p>") == ["one"]


def test_features_are_those_of_all_ancestors():
    page = "<html><body><div class='a b'><div class='b c'><p>x</p></div><p>y.</p></div><p>z"
    rows = [set(f) for f in extract.features(extract.blocks(page))]
    assert {"div", ".a", ".b", ".c", "p", "body>div", "div>div", "div>p", "leaf p"} <= rows[0] and ".c" not in rows[1] and "div>div" not in rows[1]
    assert {"p", "body>p"} <= rows[2] and not {"div", "div>p", ".a"} & rows[2]
    assert all(len(f) == len(set(f)) for f in extract.features(extract.blocks(page)))
