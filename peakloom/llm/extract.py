"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: runs of text that no block-level tag interrupts. Each block has features of the
tags around it (tags, words of class, id and role, pairs of neighbouring ancestors) and of its own text (length, share of
link text, final punctuation). The chain labels each block main or other; weights are fitted by maximum likelihood
(forward-backward, AdaGrad) on labelled pages and decoded by Viterbi. The labelled pages are built
from templates by a fixed rule (`labelled_pages`), so the model is the same for every input, and a page's text depends on
that page alone.

Scripts, styles, comments, the head, and elements that carry no readable text are markup and never become blocks. Character
references are decoded once. White space inside a block turns into one space; blocks are joined by a line feed.
Null or empty pages give an empty text, pages without markup give their text, broken or unclosed tags end
where HTML closes them (a new paragraph ends an open one; an unclosed container ends with its parent, a head at what may not stand in it). Nothing is cut by length.

A page is scanned once, in time and memory linear in its length however broken it is: where a tag's quotes end is
remembered by opening quote, open elements are found by name, and blocks share the features of their ancestors. Repeated
pages are extracted row by row, alike; an empty table gives an empty one; columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Labelled pages that the model is fitted on, and passes over them.
PAGES = 1200
PASSES = 12

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_BROKEN = re.compile(r"([a-zA-Z][^\s/><]*)([^<>]*)>?")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content isn't read at all.
_DROPPED = {"script", "style", "head", "title", "template", "iframe", "svg", "select", "datalist", "textarea"}
_RAW = {"script", "style", "textarea", "title", "iframe"}
#: Start tags that leave a head open.
_HEAD = {"head", "html", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "script", "style", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rp", "br", "wbr", "img", "nobr", "center-inline",
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "menclose", "msub", "msup", "msubsup", "munder",
    "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "semantics", "annotation",
}
#: What a start tag closes, if it is open in the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_CONTAINERS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "header", "footer", "form", "blockquote", "fieldset", "figure", "details"}


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, then a word for each word of its class, id and role."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return (tag,)
    out = [tag]
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden":
            if name == "hidden" or (a or b or c).lower() == "true":
                out.append(".hidden")
            continue
        out += [f".{w}" for w in _WORD.findall(_CAMEL.sub(" ", a or b or c).lower()) if not w.isdigit()]
    return tuple(dict.fromkeys(out))


class _Tags:
    """Where the tags of a page end: at the first `>` outside quotes, each quote looked at once."""

    def __init__(self, page: str):
        self.page = page
        self.special: list[int] | None = None
        self.ends: dict[int, int] = {}

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose name ends at `at`; -1 if its quotes leave none."""
        page = self.page
        m = _SPECIAL.match(page, at)  # nearly always: nothing or one attribute
        if m and m.group() == ">":
            return at
        if self.special is None:
            self.special = [x.start() for x in _SPECIAL.finditer(page)]
        passed = []
        while True:
            k = bisect_left(self.special, at)
            if k == len(self.special):
                found = -1
                break
            opened = self.special[k]
            if page[opened] == ">":
                found = opened
                break
            if opened in self.ends:
                found = self.ends[opened]
                break
            passed.append(opened)
            closed = page.find(page[opened], opened + 1)
            if closed < 0:
                found = -1
                break
            at = closed + 1
        self.ends.update(dict.fromkeys(passed, found))
        return found


class Element:
    """An open element: its names, its parent, and the features that its ancestors don't have."""

    __slots__ = ("names", "new", "parent", "score")

    def __init__(self, names: tuple[str, ...], parent: Element | None, new: list[str]):
        self.names, self.parent, self.new, self.score = names, parent, new, None

    def features(self) -> list[str]:
        """Of this element and all around it."""
        chain, e = [], self
        while e:
            chain.append(e.new)
            e = e.parent
        return [f for new in reversed(chain) for f in new]


class _Stack:
    """The open elements, and where on the stack each tag and the containers are."""

    def __init__(self):
        self.elements: list[Element] = []
        self.leaves: list[str] = ["body"]  # innermost tag but html and body
        self.at: dict[str, list[int]] = defaultdict(list)
        self.containers: list[int] = []
        self.seen: Counter[str] = Counter()
        self.dropped = 0

    def push(self, names: tuple[str, ...]) -> None:
        tag, new = names[0], []
        leaf = self.leaves[-1]
        if tag not in ("html", "body"):
            new = [f for f in (*names, f"{leaf}>{tag}") if not self.seen[f]]
            self.seen.update(new)
            leaf = tag
        self.at[tag].append(len(self.elements))
        if tag in _CONTAINERS:
            self.containers.append(len(self.elements))
        self.dropped += tag in _DROPPED
        self.elements.append(Element(names, self.elements[-1] if self.elements else None, new))
        self.leaves.append(leaf)

    def cut(self, k: int) -> None:
        while len(self.elements) > k:
            e = self.elements.pop()
            tag = e.names[0]
            self.leaves.pop()
            self.at[tag].pop()
            if tag in _CONTAINERS:
                self.containers.pop()
            self.dropped -= tag in _DROPPED
            self.seen.subtract(e.new)

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1

    def lowest(self, tag: str, above: int) -> int:
        """The lowest place of an open tag above another place, or -1."""
        places = self.at.get(tag, ())
        k = bisect_right(places, above)
        return places[k] if k < len(places) else -1


def blocks(page: str) -> list[tuple[tuple[Element | None, str], str, float]]:
    """((innermost open element, innermost tag), text, share of its characters in links) of each leaf block."""
    out: list[tuple[tuple[Element | None, str], str, float]] = []
    stack, tags = _Stack(), _Tags(page)
    text: list[str] = []
    linked: list[bool] = []
    links = at = 0

    def flush() -> None:
        if text:
            joined = html.unescape("".join(text))
            words = joined.split()
            if words:
                inside = sum(len(t) for t, x in zip(text, linked) if x)
                around = stack.elements[-1] if stack.elements else None
                out.append(((around, stack.leaves[-1]), " ".join(words), inside / max(1, sum(map(len, text)))))
            text.clear()
            linked.clear()

    def close(k: int) -> None:
        flush()
        stack.cut(k)

    def leave_head() -> None:
        while stack.last("head") > stack.last("template"):
            close(stack.last("head"))

    while True:
        m = _TOKEN.search(page, at)
        if stack.dropped and stack.elements[-1].names[0] == "head" and page[at : m.start() if m else len(page)].strip():
            leave_head()
        if (stop := m.start() if m else len(page)) > at and not stack.dropped:
            text.append(page[at:stop])
            linked.append(links > 0)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA[") and not stack.dropped:
                text.append(html.escape(m.group()[9:].removesuffix("]]>")))
                linked.append(links > 0)
            continue
        if (end := tags.end(at)) >= 0:
            attributes, at = page[at:end], end + 1
        else:  # quotes that never close: the tag ends at the next bracket
            m2 = _BROKEN.match(page, m.start(2))
            tag, attributes, at = m2.group(1), m2.group(2), m2.end()
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in _INLINE:
                k = stack.last(tag)
                if k >= 0 and (tag in _CONTAINERS or not stack.containers or k > stack.containers[-1]):
                    close(k)
                else:
                    flush()
            continue
        if stack.dropped and tag not in _HEAD:
            leave_head()
        if tag in _INLINE:
            if tag == "a":
                links = 1
            elif tag == "br" and not stack.dropped:
                text.append(" ")
                linked.append(False)
            continue
        flush()
        links = 0
        if tag in _VOID:
            continue
        inside = stack.containers[-1] if stack.containers else -1
        if closed := [k for x in {"p"} | _CLOSES.get(tag, set()) if (k := stack.lowest(x, inside)) >= 0]:
            close(min(closed))
        stack.push(_names(tag, attributes))
        if tag in _RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out


def _own_features(leaf: str, text: str, share: float) -> list[str]:
    """Feature names of a block that don't come from the elements around it."""
    n = len(text)
    out = [
        "bias",
        f"leaf {leaf}",
        "size " + ("0" if n < 20 else "1" if n < 60 else "2" if n < 200 else "3"),
        "link " + ("0" if share < 0.1 else "1" if share < 0.6 else "2"),
        "ends" if text[-1] in ".!?…。！？\"”»" else "open",
    ]
    return [*out, "copyright"] if "©" in text else out


def features(page: list[tuple[tuple[Element | None, str], str, float]]) -> list[list[str]]:
    """Feature names of each block."""
    return [list(dict.fromkeys([*_own_features(leaf, text, share), *(around.features() if around else ())])) for (around, leaf), text, share in page]


# Words that sites use for the parts of a page.
_OTHER_WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pagination pager toc skip".split(),
    "header": "header masthead branding logo site-header top-header hero-nav".split(),
    "footer": "footer site-footer bottom colophon copyright legal credits".split(),
    "aside": "sidebar side-bar aside widget related recommended more-stories popular trending archive tags tagcloud rail".split(),
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted affiliate commercial dfp".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay announcement disclaimer paywall banner-notice".split(),
    "form": "form search searchbox login signup sign-up newsletter subscribe subscription register contact-form optin".split(),
    "comments": "comment comments comment-list respond reply replies discussion disqus feedback responses thread reader-comments user-comments reviews".split(),
    "share": "share sharing social social-links follow buttons tools print".split(),
}
_MAIN_WORDS = "content article post entry story main body text article-body post-content entry-content main-content page-content article-text prose blog-post".split()
_ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "search", "notice": "alert"}


def labelled_pages(n: int = PAGES, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages with, for each leaf block, whether it is main text. Main blocks carry the mark @1, others @0."""
    rng = random.Random(seed)
    syllables = "ta ne ri so lu ka mo den gra vel est ou qui tion ing er de la un as".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def sentence(mark: int, a: int = 1, b: int = 60) -> str:
        body = words(a, b)
        if rng.random() < 0.1:
            body = f"<b>{body}</b>" if rng.random() < 0.5 else f'{body} <a href="#">{words(1, 3)}</a> {words(1, 5)}'
        return f"@{mark} {body.capitalize()}{rng.choice(['.', '.', '.', '', '!', '?'])}"

    def named(word: str) -> str:
        odd = rng.choice(["", "", "js-", "c-", "x-"]) + word + rng.choice(["", "", "-box", "-wrap", "-1", "Item"])
        return rng.choice([f' class="{odd}"', f' id="{odd}"', f' class="{words(1, 1)} {odd}"', f" class='{odd}'"])

    def paragraphs(mark: int, a: int, b: int) -> str:
        out = []
        for _ in range(rng.randint(a, b)):
            kind, s = rng.random(), sentence(mark)
            if kind < 0.7:
                out.append(f"<p>{s}</p>")
            elif kind < 0.78:
                out.append(f"<p>{s}")
            elif kind < 0.83:
                out.append(f"<p><b>{s}<br>")
            elif kind < 0.88:
                out.append(f"<ul>{''.join(f'<li>{sentence(mark, 1, 12)}</li>' for _ in range(rng.randint(1, 4)))}</ul>")
            elif kind < 0.91:
                out.append(f"<h{(h := rng.randint(2, 4))}>{sentence(mark, 1, 8)}</h{h}>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{s}</p></blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{s}</pre>")
            elif kind < 0.98:
                out.append(f"<figure><figcaption>{s}</figcaption></figure>")
            else:
                out.append(f"<table><tr><td>{sentence(mark, 1, 9)}</td><td>{sentence(mark, 1, 9)}</td></tr></table>")
        return "".join(out)

    def other(kind: str) -> str:
        if kind in ("ad", "notice", "share", "footer", "aside") and rng.random() < 0.2:
            return f"<p{named(rng.choice(_OTHER_WORDS[kind]))}>{sentence(0)}</p>"
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        bare = tag != "div" and rng.random() < 0.5
        if not bare and rng.random() < 0.7:
            tag = rng.choice(["div", "div", "section", "ul" if kind in ("nav", "share") else "div"])
        a = "" if bare else named(rng.choice(_OTHER_WORDS[kind]))
        if kind in _ROLES and rng.random() < 0.15:
            a += f' role="{_ROLES[kind]}"'
        if kind in ("nav", "share") or kind in ("aside", "header", "footer") and rng.random() < 0.4:
            inner = "".join(f'<li><a href="/{k}">@0 {words(1, 4)}</a></li>' for k in range(rng.randint(1, 6)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f'<label>@0 {words(1, 4)}</label><input name="q"><button>@0 {words(1, 2)}</button>'
            inner = (f"<p>{sentence(0)}</p>" if rng.random() < 0.5 else "") + inner
            inner = inner if tag == "form" else f"<form>{inner}</form>"
        elif kind == "comments":
            inner = "".join(f"<{(t := rng.choice(['div', 'li', 'article', 'section']))}{named('comment')}><{(h := rng.choice(['h4', 'span', 'div', 'p']))}>@0 {words(1, 2)}</{h}>{paragraphs(0, 1, 3)}</{t}>" for _ in range(rng.randint(1, 3)))
            inner = (f"<h3>@0 {words(1, 3)}</h3>" if rng.random() < 0.6 else "") + inner
        elif rng.random() < 0.5:
            inner = paragraphs(0, 1, 4)
        else:
            inner = sentence(0) + (f"&copy; {words(1, 2)} &middot; {words(2, 6)}." if kind == "footer" else "")
        return f"<{tag}{a}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        head = rng.choice(["", f"<h1>{sentence(1, 1, 9)}</h1>", f"<header><h1>{sentence(1, 1, 9)}</h1><p>{sentence(1, 1, 6)}</p></header>", f"<h1>{sentence(1, 1, 9)}</h1>"])
        parts = [paragraphs(1, 1, 4) for _ in range(rng.randint(1, 3))]
        for kind in ("ad", "notice", "share", "aside", "comments", "form"):
            if rng.random() < 0.2:
                parts.insert(rng.randint(1, len(parts)), other(kind))
        if rng.random() < 0.3:
            parts.append(other("comments"))
        inner = head + "".join(parts)
        style = rng.random()
        if style < 0.45:
            inner = f"<article{rng.choice(['', '', named(rng.choice(_MAIN_WORDS))])}>{inner}</article>"
        elif style < 0.6:
            inner = f"<main>{inner}</main>"
        elif style < 0.7:
            inner = f"<main><article>{inner}</article></main>"
        elif style < 0.92:
            inner = f"<div{named(rng.choice(_MAIN_WORDS))}>{inner}</div>"
        if rng.random() < 0.05:  # no markup to speak of
            inner = rng.choice([sentence(1), f"<p>{sentence(1)}</p>", f"{sentence(1)}<hr>{sentence(1)}", f"<div>{sentence(1)}</div>", paragraphs(1, 1, 3)])
            out.append((inner, [True] * len(blocks(inner))))
            continue
        before = "".join(other(k) for k in ("header", "nav", "notice", "ad") if rng.random() < 0.5)
        after = "".join(other(k) for k in ("aside", "comments", "ad", "form", "share", "footer") if rng.random() < 0.4)
        page = before + inner + after
        if rng.random() < 0.3:
            page = f"<div{rng.choice([' id=wrapper', ' class=container', ' class=page', ''])}>{page}</div>"
        text = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{page}<script>var x='<p>';</script></body></html>"
        out.append((text.replace("@0 ", "@0").replace("@1 ", "@1"), [t.lstrip("“")[:2] == "@1" for _, t, _ in blocks(text)]))
    return [(re.sub(r"@[01] ?", "", page), labels) for page, labels in out]


class Chain:
    """Weights of features for main against other, and of transitions."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    @classmethod
    def fit(cls, pages: list[tuple[str, list[bool]]], passes: int = PASSES, rate: float = 0.3, decay: float = 2e-4) -> Chain:
        data = []
        index: dict[str, int] = {}
        for page, labels in pages:
            rows = [[index.setdefault(f, len(index)) for f in own] for own in features(blocks(page))]
            if len(rows) == len(labels) and rows:
                data.append((rows, np.array(labels, int)))
        w, gw = np.zeros(len(index)), np.full(len(index), 1e-6)
        moves, gm = np.zeros((2, 2)), np.full((2, 2), 1e-6)
        start, gs = np.zeros(2), np.full(2, 1e-6)
        rng = random.Random(1)
        for _ in range(passes):
            rng.shuffle(data)
            for rows, y in data:
                n = len(rows)
                score = np.zeros((n, 2))
                score[:, 1] = [w[r].sum() for r in rows]
                score[0] += start
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = score[0]
                for k in range(1, n):
                    x = fwd[k - 1][:, None] + moves
                    fwd[k] = score[k] + np.logaddexp(x[0], x[1])
                for k in range(n - 2, -1, -1):
                    x = moves + score[k + 1] + bwd[k + 1]
                    bwd[k] = np.logaddexp(x[:, 0], x[:, 1])
                z = np.logaddexp(*fwd[-1])
                p = np.exp(fwd + bwd - z)
                err = y - p[:, 1]
                g = np.zeros(len(index))
                for r, e in zip(rows, err):
                    g[r] += e
                own = np.unique(np.concatenate([np.array(r) for r in rows]))
                g = g[own] - decay * w[own]
                gw[own] += g * g
                w[own] += rate * g / np.sqrt(gw[own])
                g = np.zeros(2)
                g[y[0]] += 1
                g -= p[0]
                gs += g * g
                start += rate * g / np.sqrt(gs)
                if n > 1:
                    pair = np.exp(fwd[:-1, :, None] + moves + (score + bwd)[1:, None, :] - z).sum(axis=0)
                    g = np.zeros((2, 2))
                    np.add.at(g, (y[:-1], y[1:]), 1)
                    g = g - pair - decay * moves
                    gm += g * g
                    moves += rate * g / np.sqrt(gm)
        return cls({f: float(w[i]) for f, i in index.items()}, moves, start)

    def _around(self, element: Element | None) -> float:
        """The weights of an element's features and of all around it, added up once for each element."""
        chain = []
        while element and element.score is None:
            chain.append(element)
            element = element.parent
        score = element.score if element else 0.0
        for e in reversed(chain):
            score += sum([self.weights.get(f, 0.0) for f in e.new])
            e.score = score
        return score

    def decode(self, page: list[tuple[tuple[Element | None, str], str, float]]) -> list[bool]:
        """Viterbi: whether each block is main text."""
        if not page:
            return []
        get = self.weights.get
        (oo, om), (mo, mm) = self.moves.tolist()
        s0, s1 = self.start.tolist()
        from_main: list[tuple[bool, bool]] = []
        for k, ((around, leaf), text, share) in enumerate(page):
            e = self._around(around) + sum([get(f, 0.0) for f in _own_features(leaf, text, share)])
            if k:
                a, b, c, d = s0 + oo, s1 + mo, s0 + om, s1 + mm
                from_main.append((b > a, d > c))
                s0, s1 = max(a, b), max(c, d) + e
            else:
                s1 += e
        main = s1 > s0
        out = [main]
        for other_from, main_from in reversed(from_main):
            main = main_from if main else other_from
            out.append(main)
        return out[::-1]


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The model, fitted once in a process."""
    return Chain.fit(labelled_pages())


def main_text(page: str | None, model: Chain) -> str:
    found = blocks(page or "")
    return "\n".join(text for (_, text, _), main in zip(found, model.decode(found)) if main)


def extract(html_column: Column, spark, model: Chain | None = None) -> Column:
    """The main text of an html column, empty for null."""
    model = model or trained()
    held = spark.sparkContext.broadcast((model.weights, model.moves, model.start))

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        chain = Chain(*held.value)
        return pa.array([main_text(page, chain) for page in column.to_pylist()], pa.string())

    return text.asNondeterministic()(html_column)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    text_batches(pages.sparkSession)
    out = pages.select("page_id", "url", extract(F.col("html"), pages.sparkSession).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
