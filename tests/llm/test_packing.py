"""Best-fit decreasing packing against a one-piece-at-a-time version and the tokenizer library."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from receivables.llm import packing, registry

from .conftest import EDGE_ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def bins_of_brute_force(lengths, capacity):
    bins, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, n)
        if at < len(bins):
            left = bins.pop(at) - n
        else:
            left, used = capacity - n, used + 1
        if left:
            bisect.insort(bins, left)
    return used


@given(st.integers(1, 70), st.lists(st.integers(1, 70), max_size=300))
@settings(max_examples=80, deadline=None)
def test_moves_place_every_piece_like_best_fit(capacity, lengths):
    lengths = [min(n, capacity) for n in lengths]
    filled = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, end, sequence, per, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
        for r in range(first, end):
            ranks[length].append(r)
            filled[sequence + (r - first) // per].append((offset + (r - first) % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == bins_of_brute_force(lengths, capacity)


def test_segment_tree_finds_the_tightest():
    random.seed(3)
    tree, on = packing.SegmentTree(37), set()
    for _ in range(500):
        k = random.randrange(37)
        on ^= {k}
        tree.set(k, k in on)
        at = random.randrange(37)
        assert tree.tightest(at) == min((x for x in on if x >= at), default=None)


def check_rows(rows, texts, capacity):
    """``rows`` against the library's ids of ``texts`` (a list per doc_id)."""
    tok = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cut, cut[1:])):
            expected[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_edges(frame):
    for capacity in (8, 2048):
        rows = packing.pack_documents(frame(EDGE_ROWS), PATH, capacity).collect()
        used = check_rows(rows, EDGE_ROWS, capacity)
        assert used == bins_of_brute_force([r.length for r in rows], capacity)
    assert packing.pack_documents(frame([]), PATH).count() == 0


def test_hot_length_is_ranked_in_parts(frame, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rows = [(i, "a b c") for i in range(100)] + [(100 + i, "d " * i) for i in range(40)]
    check_rows(packing.pack_documents(frame(rows), PATH, 16).collect(), rows, 16)


def test_ids_come_back(frame):
    rows = packing.pack_documents(frame(EDGE_ROWS), PATH, 64, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("name", ["op3_best_fit_packing"])
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_rows(registry.queries()[name](spark, sf).collect(), texts, 2048)
