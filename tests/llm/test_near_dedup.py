"""LSH forest near-duplicates and connected components against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from receivables.llm import near_dedup, registry
from receivables.llm.components import components, roots

from .conftest import EDGE_ROWS, SF


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 3:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    holds = defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in holds[g])
        links += [(i, j) for j, n in met.items() if 100 * n >= 85 * (len(s) + len(sets[j]) - n)]
        for g in s:
            holds[g].append(i)
    root = union_find(len(rows), links)
    least = {}
    for (doc_id, _), r, s in zip(rows, root, sets):
        if doc_id is not None and s:
            least[r] = min(least.get(r, doc_id), doc_id)
    out = [(d, len(s), least.get(r) if s else d) for (d, _), r, s in zip(rows, root, sets)]
    return sorted(repr((*x, x[0] == x[2])) for x in out)


def made(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in near_dedup.near_duplicate_rows(df).collect())


def near_copies(n, seed, words=120, changes=8):
    random.seed(seed)
    base = [random.choice("abcdefghijklmnop") * random.randint(1, 3) for _ in range(words)]
    for i in range(n):
        w = list(base)
        for _ in range(random.randint(0, changes)):
            w[random.randrange(words)] = f"z{random.randrange(99999)}"
        yield i, (" ".join(w).upper() if i % 2 else "  ".join(w))


@pytest.mark.parametrize("block", [512, 16])
def test_chains_of_near_copies(frame, monkeypatch, block):
    """Similarities all around the threshold; with small blocks, regions and components are cut into pairs of blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", block)
    monkeypatch.setattr(near_dedup.candidate_links, "__defaults__", (near_dedup.ROUGH, block))
    rows = [*near_copies(120, 1), *EDGE_ROWS, *((1000 + i, t) for i, t in near_copies(40, 2, words=30, changes=2))]
    assert made(frame(rows)) == brute(rows)


def test_empty_table(frame):
    assert made(frame([])) == []


def test_one_of_each_keeps_columns_and_rows_without_words(frame):
    docs = frame([(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (7, None), (8, ""), (9, "other text here now")])
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(3, "A b c d"), (9, "other text here now")]
    assert sorted(r.doc_id for r in out.collect() if not r.text) == [7, 8]


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 40, 3000, 6000, 6000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_dedup.intersections(sets)
    assert all(got[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_roots(edges):
    nodes, root = roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = union_find(31, edges)
    for a, x in zip(nodes, root):
        assert x == min(b for b in nodes if want[b] == want[a])


@pytest.mark.parametrize("task_edges", [1 << 18, 50, -1])
def test_components(spark, monkeypatch, task_edges):
    """All in one task, the end of it, or nothing."""
    monkeypatch.setattr("receivables.llm.components.TASK_EDGES", task_edges)
    random.seed(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(random.randint(2000, 2100), random.randint(2000, 2100)) for _ in range(60)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(8)
    got = {r.node: r.component for r in components(df).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    root = union_find(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    least = {}
    for x in nodes:
        least.setdefault(root[place[x]], x)
    assert got == {x: least[root[place[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = registry.queries()["op5_lsh_forest_dedup"](spark, SF).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute(rows)


def kept_at_five_words(rows):
    """Ids that stay: five-word shingles, similarity 0.8, every pair compared."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    links = [(i, j) for i, s in enumerate(sets) for j in range(i) if s and 10 * len(s & sets[j]) >= 8 * len(s | sets[j])]
    root = union_find(len(rows), links)
    least = {}
    for (doc_id, _), r in zip(rows, root):
        least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(d for (d, _), r, s in zip(rows, root, sets) if not s or least[r] == d)


def blocks_added(n, seed):
    """Texts of 200 words, and each again with 36 to 60 words appended, put in front or cut."""
    random.seed(seed)
    for i in range(n):
        w = [f"w{random.randrange(10**6)}" for _ in range(200)]
        more = [f"m{random.randrange(10**6)}" for _ in range(36 + i % 25)]
        yield 10 * i, " ".join(w)
        yield 10 * i + 1, " ".join([w + more, more + w, w[: 200 - i % 60]][i % 3])


def test_corpus_stage_finds_added_and_cut_blocks(spark):
    rows = [*blocks_added(75, 5), *((10_000 + d, t) for d, t in near_copies(60, 1)), (20_000, "a b c"), (20_001, "A b  c"), (20_002, ""), (20_003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_at_five_words(rows)
    assert len(want) < len([x for x in brute(rows) if x.endswith("True)")])  # three words and 0.85 leave more
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_corpus_stage_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == kept_at_five_words(rows)


@pytest.mark.parametrize("like", [near_dedup.CONTRACT, near_dedup.CORPUS])
def test_recall_at_the_threshold(like):
    s, values = like.threshold[0] / like.threshold[1], like.trees * like.depth
    assert 1 - (1 - s**like.depth) ** like.trees > 0.99999
    assert sum(math.comb(values, k) * s**k * (1 - s) ** (values - k) for k in range(like.rough)) < 1e-5
