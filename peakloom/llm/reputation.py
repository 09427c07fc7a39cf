"""URL filters: host reputation by empirical Bayes, under rules that override it.

Labelled page outcomes (bad or not) are counted by host and shrunk through beta-binomial priors, level by level:

    corpus -> suffix -> registered domain -> host

A level's prior mean is the posterior mean of the level above; its strength (how many pages the prior is worth)
comes from the method of moments over all units of the level: the less units differ beyond chance, the stronger the prior.
A host's rate of bad pages then has a beta posterior. A host is blocked if the lower `1 - confidence` quantile of
that posterior exceeds the bar: if it is credibly worse than usual, not if it has few labels. Over the bar, bad pages are
`lift` times as frequent as usual, or good ones `lift` times as rare; so the bar is below 1 whatever the usual rate is. The usual
rate is the random-effects mean of the hosts: by pages if hosts differ by chance only, else a host's weight is bounded, and one
hot host hardly moves it.

Counts are partial aggregates by host, so a host with a third of all pages costs one row a task. Only level totals
(four numbers a level) reach the driver. Verdicts are joined to pages by host.

Null urls and urls without `://` have an empty host and path, and are judged like any host: by no rule, and by the
counts of the empty host. Hosts without labels are judged by their domain's or suffix's prior. Without any labels, all is
allowed. Pages without text have no outcome, and neither documents without text nor with null labels give one. Repeated page
ids are judged row by row, equally long rules that fit go by the rule's text; columns other than page_id, url and html aren't
read, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract
from .common import ascii_lower, checkpoint, text_batches

CONFIDENCE = 0.95
LIFT = 1.5
#: A prior is worth between so many pages.
STRENGTH = (2.0, 1e6)
#: Suffixes of two labels under which names are registered; else the last label is the suffix.
TWO_LABELS = "ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.mx com.tr gov.uk ne.jp net.au or.jp org.au org.uk".split()
#: (verdict, rule): a rule is a host and a path that the url's path must start with.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: So many rules are part of the plan; longer lists are joined as a table.
PLAN_RULES = 100


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _name_of(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def _address(name: Column) -> Column:
    return name.rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^\[")


def suffix_of(host: Column) -> Column:
    """The suffix of a host; of an IP address `ip`."""
    name = _name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_address(name), "ip").when(two.isin(TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain of a host; an IP address is its own."""
    name = _name_of(host)
    return F.when(_address(name), name).when(F.substring_index(name, ".", -2).isin(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        one = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def ruled_by_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (columns host, path) with one more column, `ruled`, as `ruled` gives it; rules: rule and verdict, any number.

    Each host is joined with the rules of itself and of the domains around it, each (host, path) once."""
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    table = rules.distinct().select("rule", "verdict", F.substring_index("rule", "/", 1).alias("end"), F.expr("if(instr(rule, '/') > 0, substring(rule, instr(rule, '/')), '')").alias("start"))
    fits = places.withColumn("end", F.explode(ends)).join(table, "end").filter(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.char_length("rule"), F.col("rule"), F.col("verdict"))).alias("ruled"))
    return rows.join(best, ["host", "path"], "left")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving the argument above 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(t := 1 - (a + b) * x / (a + 1)) < tiny, tiny, t)
    f = d.copy()
    for m in range(1, 2000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / np.where(np.abs(c) < tiny, tiny, c)
            f = f * (step := c * d)
        if np.abs(step - 1).max(initial=0) < 1e-13:
            break
    out = np.minimum(front * f, 1.0)
    return np.where(flip, 1 - out, out)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p-quantile of beta distributions, by bisection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def strength(units: int, groups: int, n: float, n2_n: float, spread: float, noise: float) -> float:
    """Prior strength by the method of moments.

    units, in so many groups of the level above; n: labels in all units; n2_n: sum of n_i^2 / n over the level above; spread:
    sum of n_i (r_i - m)^2, r_i a unit's rate and m its prior mean; noise: sum of m (1 - m) (1 - n_i / n) over units, what
    chance alone would give on the whole. A group of k units adds m (1 - m) (k - 1) to it."""
    extra = spread - noise
    room = n - n2_n
    if units <= groups or room <= 0 or extra <= 0 or noise <= 0:
        return STRENGTH[1]
    between = extra / room  # variance of the true rates
    mean = noise / (units - groups)  # about m (1 - m)
    return float(np.clip(mean / between - 1, *STRENGTH))


def _level(units: DataFrame, above: Sequence[str] = ()) -> float:
    """The strength of a level's prior, from one aggregate over its units (columns n, bad, prior, group_n, and those that
    name the unit's group at the level above)."""
    n, m = F.col("n"), F.col("prior")
    r = units.filter(n > 0).agg(
        F.count(F.lit(1)).alias("units"),
        (F.count_distinct(F.struct(*above)) if above else F.lit(1)).alias("groups"),
        F.sum(n).alias("n"),
        F.sum(n * n / F.col("group_n")).alias("n2"),
        F.sum(n * (F.col("bad") / n - m) ** 2).alias("spread"),
        F.sum(m * (1 - m) * (1 - n / F.col("group_n"))).alias("noise"),
    ).first()
    return strength(r.units, r.groups, r.n or 0.0, r.n2 or 0.0, r.spread or 0.0, r.noise or 0.0)


def usual_rate(hosts: DataFrame, mean: float, everything: float) -> float:
    """The rate of bad pages that a host usually has: hosts (columns n, bad) weigh n S / (n + S), S the strength of `mean` as
    their prior."""
    worth = _level(hosts.withColumn("prior", F.lit(mean)).withColumn("group_n", F.lit(everything)))
    share = F.lit(worth) / (F.col("n") + worth)
    r = hosts.agg(F.sum(F.col("n") * share).alias("n"), F.sum(F.col("bad") * share).alias("bad")).first()
    return (r.bad + 0.5) / (r.n + 1.0)


def bar(usual: float, lift: float = LIFT) -> float:
    """The rate over which bad pages are `lift` times as frequent as usual, or good ones `lift` times as rare."""
    return min(lift * usual, 1 - (1 - usual) / lift)


def reputations(outcomes: DataFrame, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(host, domain, suffix, n, bad, prior, worth, rate, bound, blocked) of every host.

    outcomes: host, bad (boolean, null where a page has no label), perhaps pages (how many pages a row stands for, else one);
    hosts of unlabelled pages get a verdict too."""
    pages = F.col("pages") if "pages" in outcomes.columns else F.lit(1)
    sums = [F.sum(F.when(c, pages).otherwise(0)).cast("double").alias(name) for name, c in (("n", F.col("bad").isNotNull()), ("bad", F.col("bad")))]
    hosts = outcomes.groupBy("host").agg(*sums)
    hosts = checkpoint(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total.bad + 0.5) / (total.n + 1.0) if total.n else 0.5
    everything = total.n or 0.0
    limit = bar(usual_rate(hosts, mean, everything), lift) if total.n else 1.0

    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(mean)).withColumn("group_n", F.lit(float(everything)))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def settled(units: DataFrame, above: Sequence[str] = ()) -> DataFrame:
        worth = _level(units, above)
        return units.withColumn("worth", F.lit(worth)).withColumn("rate", (F.col("prior") * worth + F.col("bad")) / (F.col("n") + worth))

    def under(units: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        return units.join(above.select(*on, F.col("rate").alias("prior"), F.col("n").alias("group_n")), on)

    suffixes = settled(suffixes)
    domains = settled(under(domains, suffixes, ["suffix"]), ["suffix"])
    hosts = settled(under(hosts, domains, ["suffix", "domain"]), ["suffix", "domain"])

    @F.arrow_udf("double")
    def bound(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(beta_quantile(1 - confidence, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)))

    a = F.col("prior") * F.col("worth") + F.col("bad")
    b = (1 - F.col("prior")) * F.col("worth") + F.col("n") - F.col("bad")
    out = hosts.withColumn("bound", bound(a, b)).withColumn("blocked", F.col("bound") > limit if total.n else F.lit(False))
    return out.select("host", "domain", "suffix", "n", "bad", "prior", "worth", "rate", "bound", "blocked")


def outcomes_by_text(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad, pages): how many pages of each host have which outcome; a page is labelled if its article is the text of a
    labelled document.

    bad: quality 0 or toxic, by any label of that text. Articles and texts meet by XXH64 over their text without white space,
    so only slim rows are shuffled; copies of a text collapse on both sides before they meet. The article's heading, a
    copy of the text's beginning, is dropped if the rest begins with it."""
    spark = pages.sparkSession
    text_batches(spark)
    rows = pages.select(host_of(F.col("url")).alias("host"), extract.extract(F.col("html"), spark).alias("text"))
    first, rest = F.substring_index("text", "\n", 1), F.expr("substring(text, instr(text, '\n') + 1)")
    body = F.when(F.col("text").contains("\n") & rest.startswith(F.rtrim(first)), rest).otherwise(F.col("text"))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    squeezed = lambda c: F.when(bare(c) != "", F.xxhash64(bare(c)))  # noqa: E731  # without text: null, and equal to nothing
    rows = rows.select("host", squeezed(body).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("pages"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad")).filter("bad is not null")
    known = documents.filter("text is not null").select("doc_id", squeezed(F.col("text")).alias("h")).join(marks, "doc_id").groupBy("h").agg(F.max("bad").alias("bad"))
    return rows.join(known, "h", "left").groupBy("host", "bad").agg(F.sum("pages").alias("pages"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labels, host_rate, host_bound of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= PLAN_RULES:
        rows = rows.withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    else:
        rows = ruled_by_table(rows, pages.sparkSession.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string"))
    known = reputations(outcomes).select("host", F.col("n").cast("bigint").alias("host_labels"), F.round("rate", 9).alias("host_rate"), F.round("bound", 9).alias("host_bound"), "blocked")
    out = rows.join(known, "host", "left")
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", own).alias("verdict"), "host_labels", "host_rate", "host_bound")
