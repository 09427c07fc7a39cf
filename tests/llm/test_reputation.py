import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import reputation as rep

URLS = [
    None, "", "no scheme/x", "http://A.Example.COM/en/7x?q#f", "https://example.net", "https://example.net?x=/de/8", "ftp://a.b.example.net/de/80/", "http://x.org#/es/", "http://x.org/es/1",
    "http://notexample.com/en/7", "http://com/en/", "http://example.com/en/", "x://y://z/w", "http://É.net/de/\n8",
]


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    rest = rest[k:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def brute_rule(host, path):
    fits = []
    for verdict, rule in rep.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows = df.select("url", rep.host_of(F.col("url")).alias("h"), rep.path_of(F.col("url")).alias("p")).withColumn("r", rep.ruled(F.col("h"), F.col("p"))).collect()
    for r in rows:
        assert (r.h, r.p) == brute(r.url), r.url
        assert ((r.r.rule, r.r.verdict) if r.r else (None, None)) == brute_rule(r.h, r.p)


def test_many_rules_are_joined(spark):
    many = [*rep.RULES, *[("block", f"h{k}.org/") for k in range(300)], *[("allow", f"h{k}.org/a") for k in range(300)], ("block", "whole.net")]
    urls = [*URLS, "http://h7.org/b", "http://x.h7.org/ab/c", "http://h299.org/a", "http://h300.org/a", "http://a.whole.net", "http://whole.net/x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", rep.host_of(F.col("url")).alias("host"), rep.path_of(F.col("url")).alias("path"))
    table = spark.createDataFrame([(r, v) for v, r in many], "rule string, verdict string")
    rows = rep.ruled_by_table(df, table).withColumn("other", rep.ruled(F.col("host"), F.col("path"), many)).collect()
    assert len(rows) == len(urls) and all(r.ruled == r.other for r in rows) and sum(r.ruled is not None for r in rows) > 8


def test_beta_quantile():
    rng = np.random.default_rng(0)
    for a, b in ((1, 1), (0.5, 3), (20, 5), (300, 700), (2, 900)):
        draws = np.sort(rng.beta(a, b, 200_000))
        for p in (0.05, 0.5, 0.9):
            assert rep.beta_quantile(p, [a], [b])[0] == pytest.approx(draws[int(p * len(draws))], abs=0.006)
    assert rep.beta_quantile(0.05, [1.0], [1.0])[0] == pytest.approx(0.05)
    assert rep.beta_cdf(np.array([0.3]), np.array([2.0]), np.array([2.0]))[0] == pytest.approx(0.216)


def test_shrinking(spark):
    rng = random.Random(2)
    rows = []
    for d in range(20):
        for h in range(10):
            host = f"h{h}.d{d}.com"
            bad = 0.95 if (d, h) == (3, 3) or d == 7 else 0.1
            rows += [(host, rng.random() < bad) for _ in range(40 if h else 2)]
    rows += [("new.d7.com", None), ("new.d1.com", None), ("", None)]
    got = {r.host: r for r in rep.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["h3.d3.com"].blocked and not got["h4.d3.com"].blocked
    assert all(got[f"h{h}.d7.com"].blocked for h in range(10))  # with two labels of its own, by its domain
    assert got["new.d7.com"].rate > 0.6 and got["new.d1.com"].rate < 0.3 and not got["new.d1.com"].blocked
    assert 0.1 < got["h0.d7.com"].prior < 1 and got["h3.d3.com"].rate < 0.95
    assert not got[""].blocked


def test_rows_may_stand_for_many_pages(spark):
    rows = [("a.com", True)] * 30 + [("a.com", False)] * 3 + [("b.com", False)] * 50 + [("c.com", None)] * 2
    each = spark.createDataFrame(rows, "host string, bad boolean")
    got = [sorted(tuple(r) for r in rep.reputations(x).collect()) for x in (each, each.groupBy("host", "bad").agg(F.count(F.lit(1)).alias("pages")))]
    assert got[0] == got[1]


def test_equal_hosts_shrink_to_one(spark):
    rng = random.Random(4)
    rows = [(f"h{h}.com", rng.random() < 0.3) for h in range(200) for _ in range(10)]
    got = rep.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()
    assert sum(r.blocked for r in got) <= 2 and np.std([r.rate for r in got]) < 0.03


def test_judge(spark, sf):
    pages, docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents", "labels"))
    out = rep.outcomes_by_text(pages, docs, labels)
    labelled, total = out.agg(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.sum("pages")).first()
    assert total == pages.count() and labelled > 0.2 * total
    extra = spark.createDataFrame([(-k, u, None) for k, u in enumerate(URLS, 1)] + [(None, "http://x.com/", "")], pages.schema)
    rows = rep.judge(pages.union(extra), out).collect()
    assert len(rows) == pages.count() + len(URLS) + 1
    urls = {r.page_id: r.url for r in pages.union(extra).collect()}
    for r in rows:
        assert (r.host, r.path) == brute(urls[r.page_id])
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)
    none = rep.judge(pages, out.withColumn("bad", F.lit(None).cast("boolean"))).filter("rule is null")
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert rep.judge(pages.limit(0), out.limit(0)).count() == 0


def test_strength():
    assert rep.strength(1, 1, 10, 1, 5, 1) == rep.STRENGTH[1]
    assert rep.strength(50, 50, 500, 10, 50, 9) == rep.STRENGTH[1]
    assert rep.strength(50, 1, 500, 10, 5, 9) == rep.STRENGTH[1]
    assert math.isclose(rep.strength(101, 1, 1100, 100, 60, 20), 0.2 / 0.04 - 1)


@pytest.mark.parametrize("per", [2, 4, 20])
def test_strength_of_known_priors(spark, per):
    rng = np.random.default_rng(per)
    rows = []
    for d in range(4000 // per):
        m = rng.beta(3, 7)
        for h, r in enumerate(rng.beta(10 * m, 10 * (1 - m), per)):
            bad = int(rng.binomial(30, r))
            rows += [(f"h{h}.d{d}.com", True, bad), (f"h{h}.d{d}.com", False, 30 - bad)]
    got = rep.reputations(spark.createDataFrame(rows, "host string, bad boolean, pages bigint")).first()
    assert 8 < got.worth < 13


def brute_reputations(rows, confidence=rep.CONFIDENCE):
    """The same by plain loops: {host: (n, bad, prior, worth, rate, bound, blocked)}; bounds by scanning the density."""

    def moments(units):  # (group, n, bad, prior, n of the group)
        units = [u for u in units if u[1]]
        groups = len({u[0] for u in units})
        noise = sum(m * (1 - m) * (1 - n / g) for _, n, _, m, g in units)
        extra = sum(n * (b / n - m) ** 2 for _, n, b, m, _ in units) - noise
        room = sum(u[1] for u in units) - sum(n * n / g for _, n, _, _, g in units)
        if len(units) <= groups or room <= 0 or extra <= 0 or noise <= 0:
            return rep.STRENGTH[1]
        return min(max(noise / (len(units) - groups) / (extra / room) - 1, rep.STRENGTH[0]), rep.STRENGTH[1])

    hosts = {}
    for host, bad in rows:
        n, b = hosts.get(host, (0, 0))
        hosts[host] = (n + (bad is not None), b + bool(bad))
    name = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1])
    total, wrong = sum(n for n, _ in hosts.values()), sum(b for _, b in hosts.values())
    mean = (wrong + 0.5) / (total + 1)
    s = moments([("", n, b, mean, total) for n, b in hosts.values()])
    weigh = lambda k: sum(x[k] * s / (x[0] + s) for x in hosts.values())
    usual = (weigh(1) + 0.5) / (weigh(0) + 1)
    above = {"": (mean, total)}
    for key, parent in ((lambda h: name(h)[1], lambda h: ""), (lambda h: name(h)[0], lambda h: name(h)[1]), (lambda h: h, lambda h: name(h)[0])):
        units = {}
        for h, (n, b) in hosts.items():
            _, x, y = units.get(key(h), (None, 0, 0))
            units[key(h)] = (parent(h), x + n, y + b)
        worth = moments([(g, n, b, *above[g]) for g, n, b in units.values()])
        prior = {k: above[g][0] for k, (g, _, _) in units.items()}
        above = {k: ((prior[k] * worth + b) / (n + worth), n) for k, (_, n, b) in units.items()}
    out = {}
    for h, (n, b) in hosts.items():
        x = (np.arange(400_000) + 0.5) / 400_000
        log = (prior[h] * worth + b - 1) * np.log(x) + ((1 - prior[h]) * worth + n - b - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        bound = x[np.searchsorted(mass, (1 - confidence) * mass[-1])]
        out[h] = (n, b, prior[h], worth, above[h][0], bound, bound > rep.bar(usual))
    return out


def test_reputations_match_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for d in range(12):
        for h in range(rng.choice([1, 2, 5])):
            rate = rng.betavariate(1.5, 3)
            rows += [(f"h{h}.d{d}.{('com', 'org', 'net')[d % 3]}", rng.choice([None, rng.random() < rate, rng.random() < rate])) for _ in range(rng.choice([1, 20, 90]))]
    got = {r.host: r for r in rep.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    want = brute_reputations(rows)
    assert got.keys() == want.keys() and {r.blocked for r in got.values()} == {True, False}
    for h, (n, b, prior, worth, rate, bound, blocked) in want.items():
        r = got[h]
        assert (r.n, r.bad, r.blocked) == (n, b, blocked)
        assert (r.prior, r.worth, r.rate) == pytest.approx((prior, worth, rate)) and r.bound == pytest.approx(bound, abs=1e-4)


def test_pages_without_text_have_no_outcome(spark):
    pages = spark.createDataFrame([(k, "http://a.com/x", None if k % 2 else "<p> </p>") for k in range(60)] + [(60, "http://a.com/y", "<article><p>Real words here.</p></article>")], "page_id bigint, url string, html string").withColumn("host", F.lit("z")).withColumn("bad", F.lit(1))
    docs = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, "Real words here.")], "doc_id bigint, text string").withColumn("bad", F.lit(1))
    labels = spark.createDataFrame([(k, 0 if k < 4 else 1, 0) for k in (1, 2, 3, 4)], "doc_id bigint, quality int, toxic int")
    got = {(r.host, r.bad): r.pages for r in rep.outcomes_by_text(pages, docs, labels).collect()}
    assert got == {("a.com", None): 60, ("a.com", False): 1}
    assert {r.verdict for r in rep.judge(pages, rep.outcomes_by_text(pages, docs, labels)).collect()} == {"allow"}


def test_bar_is_below_one(spark):
    assert rep.bar(0.25) == 0.375 and all(u < rep.bar(u) < 1 for u in (0.01, 0.4, 0.5, 2 / 3, 0.9, 0.999))
    rows = [("bad.com", True)] * 2000 + [(f"h{h}.org", k < 35) for h in range(40) for k in range(50)]
    got = {r.host: r.blocked for r in rep.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.com"] and not any(v for h, v in got.items() if h != "bad.com")


def test_a_hot_host_does_not_shield_others(spark):
    rows = [(f"h{h}.com", k < (140 if h == 7 else 50)) for h in range(40) for k in range(200)]
    for hot in ([], [("hot.net", True)] * 4000):
        got = {r.host: r.blocked for r in rep.reputations(spark.createDataFrame(rows + hot, "host string, bad boolean")).collect()}
        assert {h for h, v in got.items() if v} == {"h7.com"} | {h for h, _ in hot}


def test_addresses_are_domains_of_their_own(spark):
    hosts = {"10.0.3.4": ("10.0.3.4", "ip"), "u@10.9.3.4:80": ("10.9.3.4", "ip"), "[2001:db8::1]:8080": ("[2001:db8::1]", "ip"), "a.b.co.uk": ("b.co.uk", "co.uk"), "a.b.com:1": ("b.com", "com"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", rep.domain_of(F.col("h")), rep.suffix_of(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == hosts
