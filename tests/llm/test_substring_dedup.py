"""Super-k-mer window removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from receivables.llm import registry, substring_dedup
from receivables.llm.common import hash_words, word_bounds

from .conftest import EDGE_ROWS, SF


def brute(rows, k):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((doc_id, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(map(repr, out))


def made(df, **how):
    rows = substring_dedup.remove_repeats(df, **how).collect()
    return sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in rows)


@pytest.mark.parametrize("crowded", [4096, 2])
@pytest.mark.parametrize("seed", [0, 1])
def test_random_texts(frame, monkeypatch, seed, crowded):
    """Few words, so windows repeat inside and across documents; buckets counted in tasks and by shuffle."""
    monkeypatch.setattr(substring_dedup, "BUCKET_STRINGS", crowded)
    random.seed(seed)
    rows = [(i if i % 9 else None, " ".join(random.choice("abc") for _ in range(random.randint(0, 40)))) for i in range(60)] + EDGE_ROWS
    assert made(frame(rows), window=7, gram=3) == brute(rows, 7)


def test_full_filter_changes_nothing(frame):
    """With a bitmap of 2 ** 15 bits nearly every string travels; the result is the same."""
    random.seed(5)
    rows = [(i, " ".join(random.choice("abcdefg") for _ in range(60))) for i in range(50)]
    keyed = substring_dedup.with_row_key(frame(rows))
    few, many = (substring_dedup.covered_words(keyed, 7, 3, bits) for bits in (15, 26))
    spans = lambda df: sorted((r.doc_id, sorted((s["first"], s["end"]) for s in r.spans)) for r in df.collect())
    assert spans(few) == spans(many)


def test_equal_windows_share_a_minimiser():
    random.seed(2)
    text = " ".join(random.choice("abcd") for _ in range(400)).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, docs = word_bounds(data, np.array([0, 300, len(data)]))
    values, first, windows = substring_dedup.super_kmers(hash_words(data, starts, ends), docs, 9, 4)
    words, of = text.split(), {}
    covered = Counter()
    for v, f, n in zip(values, first, windows):
        for i in range(f, f + n):
            covered[i] += 1
            assert of.setdefault(tuple(text[starts[j] : ends[j]] for j in range(i, i + 9)), v) == v
    assert len(words) >= len(covered) and set(covered.values()) == {1}


def test_empty_and_columns(frame):
    assert made(frame([])) == []
    long = " ".join(f"w{i}" for i in range(60))
    docs = frame([(1, long), (2, long + " tail"), (3, "short"), (4, None)])
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, ""), (2, "tail"), (3, "short"), (4, None)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.queries()["op4_super_kmer_dedup"](spark, SF).collect()
    sha = {repr((d, n, m, hashlib.sha256(t.encode()).hexdigest())) for d, n, m, t in map(eval, brute(rows, 35))}
    assert {repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got} == sha and len(got) == len(rows)
