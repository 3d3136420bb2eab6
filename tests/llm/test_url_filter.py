"""Host, path and rules against plain Python; the models' scores against a direct version."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from receivables.llm import registry, url_filter

from .conftest import SF

RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    best = None
    for rule, allow in RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = rule, allow
    return best or (None, None)


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG/x", "http://EXAMPLE.org/ES/", "http://x.example.org/es/1?q", "http://example.org/en/1", "http://example.org/en/", "http://org", "http://org/",
            "http://notorg/", "http://a.com/fr/b", "http://a.com/fr", "http://com/de/", "http://a://b.org/c", "http://b.org?x=/y", "http://b.org#/y", "http://É.org/", "a\nb://c.org/d\ne?f", "http://k.org/" + "x" * 30_000]
    df = spark.createDataFrame([(i if i % 7 else None, u, 1, "v") for i, u in enumerate(urls + urls)], "page_id long, url string, score int, verdict string")
    rows = url_filter.judge(df).collect()
    want = []
    for i, u in enumerate(urls + urls):
        host, path = parsed(u)
        want.append(repr((i if i % 7 else None, host, path, ruled(host, path)[0])))
    assert sorted(repr(tuple(r)[:4]) for r in rows) == sorted(want)
    for r in rows:
        allow = ruled(r.host, r.path)[1]
        assert r.verdict in ("allow", "block") and (allow is None or (r.verdict == "allow") == allow)
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.where("url is null")).collect()} == {"allow"}


def test_whole_result_against_brute_force(spark):
    """Scores, the cross-fitted threshold, both error rates and every verdict, by direct counts over all URLs."""
    rng = np.random.default_rng(5)
    hosts = {"a.org/": "abcde", "b.example.org/es/": "abcde", "c.com/fr/": "abcef", "d.com/de/": "abcef"}
    word = lambda letters: "".join(rng.choice(list(letters), 120))
    # Every seventh URL looks like those of the other verdict, so no cut parts them.
    urls = [f"http://{h}{word('degx' if (k % 7 == 0) == ok else letters)}" for h, letters in hosts.items() for ok in ["org/" == h[-4:] or "fr" in h] for k in range(60)]
    urls += urls[:10] + [f"http://e.net/{word('abcdefgh')}" for _ in range(40)] + ["é", "", None, "http://a.org/" + "ab" * 500]
    found, got = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4))
    fold = lambda u: zlib.crc32((u or "").encode()) % url_filter.FOLDS

    def grams(url):
        b = [-1] * url_filter.ORDER + list((url or "").encode())
        return [[tuple(b[i - k : i + 1]) for k in range(url_filter.ORDER + 1)] for i in range(url_filter.ORDER, len(b))]

    # Counts of (verdict, fold), so that any fold can be left out.
    seen, context = Counter(), Counter()
    for u in urls:
        allow = ruled(*parsed(u))[1]
        if allow is not None:
            for g in (g for of in grams(u) for g in of):
                seen[allow, fold(u), g] += 1
                context[allow, fold(u), g[:-1]] += 1

    def score(url, without=None):
        folds, total = [f for f in range(url_filter.FOLDS) if f != without], 0.0
        for of in grams(url):
            p = {True: 1 / 256, False: 1 / 256}
            for g in of:
                for kind in p:
                    n, m = sum(seen[kind, f, g] for f in folds), sum(context[kind, f, g[:-1]] for f in folds)
                    p[kind] = (n + url_filter.STRENGTH * p[kind]) / (m + url_filter.STRENGTH)
            total += math.log(p[True]) - math.log(p[False])
        return total / max(1, len((url or "").encode()))

    unseen = [(ruled(*parsed(u))[1], score(u, fold(u))) for u in urls if ruled(*parsed(u))[1] is not None]
    step = 2 * url_filter.REACH / url_filter.BINS
    rates = []
    for k in range(url_filter.BINS + 1):
        cut = k * step - url_filter.REACH
        low = [ok for ok, x in unseen if math.floor((x + url_filter.REACH) / step) < k]
        accepted = sum(ok for ok, _ in unseen)
        lost, passed = sum(low) / accepted, 1 - (len(low) - sum(low)) / (len(unseen) - accepted)
        rates.append((lost + passed, lost, passed, cut))
    least = [r for r in rates if r[0] <= min(rates)[0] + 1e-12]
    _, lost, passed, cut = least[len(least) // 2]
    assert 0 < lost + passed < 1 and np.allclose(got, (cut, lost, passed))
    for r in found.collect():
        u, allow = urls[r.page_id], ruled(*parsed(urls[r.page_id]))[1]
        assert abs(r.score - score(u)) < 1e-9
        assert r.verdict == ("allow" if (score(u) >= cut if allow is None else allow) else "block")


def test_many_distinct_contexts(spark):
    """Far more contexts than a table of fixed size holds: every score is the one of exact counts, in pieces of any size."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rng.integers(33, 127, n))).translate({ord(c): "_" for c in "/?#"})
    hosts = ["a.org/", "b.example.org/es/", "c.com/fr/", "d.com/de/", "e.net/"]
    urls = [f"http://{hosts[i % 5]}{word(90)}" for i in range(2500)]
    urls += urls[:3] + ["é", "", None, "http://org/" + word(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    seen, context = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}

    def grams(url):
        b = [-1] * url_filter.ORDER + list((url or "").encode())
        for i in range(url_filter.ORDER, len(b)):
            yield [tuple(b[i - k : i + 1]) for k in range(url_filter.ORDER + 1)]

    for u in urls:
        allow = ruled(*parsed(u))[1]
        if allow is not None:
            for g in (g for of in grams(u) for g in of):
                seen[allow][g] += 1
                context[allow][g[:-1]] += 1
    assert len(seen[True].keys() | seen[False].keys()) > 1 << 19
    got = url_filter.judge(pages).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    for r in got:
        u, want = urls[r.page_id], 0.0
        for of in grams(u):
            p = {True: 1 / 256, False: 1 / 256}
            for g in of:
                for kind in p:
                    p[kind] = (seen[kind][g] + url_filter.STRENGTH * p[kind]) / (context[kind][g[:-1]] + url_filter.STRENGTH)
            want += math.log(p[True]) - math.log(p[False])
        assert abs(r.score - want / max(1, len((u or "").encode()))) < 1e-9


def test_model_tells_ruled_urls_apart(spark):
    rows = registry.queries()["op9_url_language_model"](spark, "/root/testdata/sf0.01").collect()
    kinds = {kind: [r.score for r in rows if r.rule and r.verdict == kind] for kind in ("allow", "block")}
    assert np.median(kinds["allow"]) > np.median(kinds["block"])
    free = [r for r in rows if r.rule is None]
    cut = min(r.score for r in free if r.verdict == "allow")
    assert all((r.score >= cut) == (r.verdict == "allow") for r in free)


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.queries()["op9_url_language_model"](spark, SF).collect():
        host, path = parsed(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, ruled(host, path)[0])
