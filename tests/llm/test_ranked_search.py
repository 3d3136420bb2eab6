"""Ranked search against a plain scoring loop; range maxima and pruning on their own."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from receivables.llm import ranked_search as rs

from .conftest import EDGE_ROWS, SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "item_id long, text string, doc_id int, rank int")


def test_edges_against_a_plain_loop(spark, frame):
    docs = EDGE_ROWS + [(20 + i, "copy of one passage here") for i in range(40)] + [(None, "lonely")] + [(90, "lonely w17"), (91, "ONE\x00two\x7fW17")]
    items = [(1, "one two the"), (2, None), (3, ""), (4, "w17 W4999 w17"), (5, "copy passage"), (6, "é 漢字 endoftext"), (7, "nothing-known"), (None, "lonely one"), (1, "here words"), (1, "here words"), (8, "x")]
    for block in (3, 10_000):
        same(rs.ranked(frame(docs), items_frame(spark, items), 10, block), brute(docs, items, 10))
    same(rs.ranked(frame(docs), items_frame(spark, items), 2), brute(docs, items, 2))
    assert rs.ranked(frame([]), items_frame(spark, items)).count() == 0
    assert rs.ranked(frame(docs), items_frame(spark, [])).count() == 0
    assert rs.ranked(frame([(1, None), (2, " ")]), items_frame(spark, items)).count() == 0


def test_real_table_in_small_blocks_of_queries(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    same(rs.ranked(docs, items), want)
    monkeypatch.setattr(rs, "QUERY_ROWS", 17)
    same(rs.ranked(docs.repartition(5), items, 10, 16), want)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(rs, "PIECE", 7)
    for text in ("", "   ", "a", "abcdefghijklmnop", "ab cdefghij k", "one two three-four,five " * 5, "é" * 20 + " x"):
        assert [w.decode() for p in rs.terms_of(text.encode()) for w in p] == terms(text)


def made(rng, n, sizes):
    places = [np.sort(rng.choice(n, s, replace=False)) for s in sizes]
    impacts = np.concatenate([rng.integers(1, 50, s) for s in sizes])
    return rs.Lists(n, np.array(sizes), np.concatenate(places), impacts)


def test_range_maxima(rng=np.random.default_rng(1)):
    lists = made(rng, 500, [1, 2, 3, 64, 65, 200, 333])
    for _ in range(300):
        t = rng.integers(len(lists.starts) - 1)
        lo, hi = np.sort(rng.integers(lists.starts[t], lists.starts[t + 1] + 1, 2))
        (got,) = lists.maxima(np.array([lo]), np.array([hi]))
        assert got == -1 if lo == hi else lo <= got < hi and lists.impacts[got] == lists.impacts[lo:hi].max()


@pytest.mark.parametrize("k", [1, 10])
def test_blocks_are_searched_exactly_and_not_wholly(k):
    rng = np.random.default_rng(2)
    n, sizes = 4000, [4000, 2500, 600, 40, 3]
    lists = made(rng, n, sizes)
    weight = np.repeat([1, 3, 20, 400, 900], sizes)
    lists.impacts *= weight
    lists = rs.Lists(n, np.array(sizes), lists.places, lists.impacts)
    ids = np.sort(rng.choice(10**6, n, replace=False))
    own, times = np.arange(5), np.array([1, 2, 1, 1, 3])
    top, scored = rs.search_block(lists, ids, np.ones(n, bool), own, times, [], k)
    total = np.zeros(n, np.int64)
    for t in range(5):
        at = slice(lists.starts[t], lists.starts[t + 1])
        total[lists.places[at]] += times[t] * lists.impacts[at]
    want = sorted(zip((-total).tolist(), ids.tolist(), strict=True))[:k]
    assert top == want and scored < n / 10
