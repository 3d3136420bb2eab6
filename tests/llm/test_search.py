"""Multi-index hashing (recall, exact scores) and pivot-distance search (exact) against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest

from receivables.llm import binary_index, pivot_index, registry

SF = "/root/testdata/sf0.01"
ROWS = [
    (0, [1.0, 0.5, -0.5]), (1, [1.0, 0.5, -0.5]), (2, [1.0, 0.5, -0.5]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 2.0]),
    (6, [math.nan, 1.0, 1.0]), (7, [math.inf, 0.0, 1.0]), (8, [-3.0, 2.0, 0.25]), (9, [0.1, 0.2, 0.3]), (10, [4.0, 4.0, -4.0]),
    (None, [1.0, 1.0, 1.0]), (20, [0.7, -0.7, 0.1]), (20, [0.7, -0.7, 0.1]), (100, [2.0, -1.0, 0.5]), (101, [1.0, 2.0]), (102, []), (200, [0.0, 0.0, 0.0]),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def usable(rows, zero):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, dtype=np.float32).astype(float)
    return out


def brute(vectors, every, k, score):
    out = []
    for q in sorted(v for v in vectors if v % every == 0):
        best = sorted((-score(vectors[q], vectors[c]), c) for c in vectors if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def whole(q, x):
    return int((np.floor(q * 1024) * np.floor(x * 1024)).sum())


@pytest.mark.parametrize("k", [3, 10])
def test_exact_top_edges(spark, k):
    got = pivot_index.exact_top(table(spark, ROWS), lambda v: v % 20 == 0, k).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(usable(ROWS, True), 20, k, whole)
    assert pivot_index.exact_top(table(spark, []), lambda v: v % 20 == 0).count() == 0


def test_exact_top_with_small_blocks_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "INDEX_BLOCK", 16)
    monkeypatch.setattr(pivot_index, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [2.0, 1.0, -1.0] if i % 3 == 0 else (rng.normal(size=3) * rng.uniform(0.1, 3)).round(3).tolist()) for i in range(300)]
    got = pivot_index.exact_top(table(spark, rows), lambda v: v % 10 == 0, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(usable(rows, True), 10, 5, whole)


@pytest.mark.parametrize("size", [2.9e3, 2.8e5, 2e6])
def test_large_components_are_exact(spark, monkeypatch, size):
    """Sums beyond 2^53, and components beyond it: the same rows as with Python's integers."""
    monkeypatch.setattr(pivot_index, "INDEX_BLOCK", 16)
    monkeypatch.setattr(pivot_index, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(9)
    d = 8 if size < 1e6 else 2
    rows = [(i, (rng.uniform(-1, 1, d) * size).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300 + i, [0.0] * d) for i in range(3)]
    if size > 1e6:  # nearly equal, larger than a double's integers
        rows = [(i, [v[0] * 1e-3, *v[1:]]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = pivot_index.exact_top(frame, lambda v: v % 10 == 0, 7).orderBy("query_id", "rank").collect()
    ints = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    assert [tuple(r) for r in got] == brute(ints, 10, 7, lambda q, x: sum(a * b for a, b in zip(q, x, strict=True)))


def test_scores_beyond_a_long_raise(spark):
    for big in (3e9, 1e150, 1e300):
        frame = spark.createDataFrame([(i, [big, 1.0]) for i in range(0, 400, 100)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="OVERFLOW|does not fit a long"):
            pivot_index.exact_top(frame, lambda v: v % 100 == 0).collect()
    with pytest.raises(OverflowError, match="cannot be scaled"):
        pivot_index.exact_top(spark.createDataFrame([(0, [1e307]), (100, [1.0])], "vec_id long, embedding array<double>"), lambda v: v % 100 == 0)
    # A huge component that meets zeros only is exact.
    frame = spark.createDataFrame([(0, [0.0, 3.0]), (100, [1e300, 0.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pivot_index.exact_top(frame, lambda v: v == 0).collect()] == [(0, 1, 7, 3072 * 2048), (0, 2, 100, 0)]


def test_bounds_prune(spark, monkeypatch):
    """On clustered vectors most blocks are left out."""
    monkeypatch.setattr(pivot_index, "INDEX_BLOCK", 16)
    monkeypatch.setattr(pivot_index, "QUERY_BLOCK", 1)
    seen = []
    meet = pivot_index.meet
    monkeypatch.setattr(pivot_index, "meet", lambda index, asked: seen.append((index.count() * asked.count(), meet(index, asked).count())) or meet(index, asked))
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 3))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 20] + rng.normal(size=3) / 500).tolist()) for i in range(1200)]
    got = pivot_index.exact_top(table(spark, rows), lambda v: v % 100 == 0, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(usable(rows, True), 100, 5, whole)
    assert seen[0][1] < 0.9 * seen[0][0]


@pytest.mark.parametrize("k", [3, 20])
def test_hashing_edges(spark, k):
    got = binary_index.nearest(table(spark, ROWS), lambda v: v % 20 == 0, k, reach=1.0).orderBy("query_id", "rank").collect()
    want = brute(usable(ROWS, False), 20, k, lambda q, x: float(sum(a * b for a, b in zip(q, x))))
    assert [(r.query_id, r["rank"]) for r in got] == [w[:2] for w in want]  # all candidates, if fewer
    if k == 20:
        assert [tuple(r) for r in got] == want
    assert binary_index.nearest(table(spark, []), lambda v: v % 20 == 0).count() == 0


def test_buckets_find_every_code_within_the_radius():
    rng = np.random.default_rng(8)
    code, asked = rng.integers(0, 256, (500, 4), dtype=np.uint8), rng.integers(0, 256, (20, 4), dtype=np.uint8)
    apart = np.unpackbits(asked[:, None, :] ^ code[None, :, :], axis=2).sum(axis=2)
    for radius in (0, 3, 9, 14, 32):
        assert (binary_index.Buckets(code).within(asked, code, radius) == (apart <= radius)).all()


def test_queries(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    found = {}
    for r in registry.queries()["op1_multi_index_hashing"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and [-g[2] for g in got] == sorted(-g[2] for g in got)
        assert all(abs(g[2] - score[ids == g[1]][0]) < 1e-12 for g in got)
        hits += len({g[1] for g in got} & set(ids[order]))
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("size", [1e-300, 1e160, 1e300])
def test_nearest_of_huge_and_tiny_vectors(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * size).tolist()) for i in range(60)] + [(100, [size] * 3 + [-size] * 3)]
    got = binary_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0, 70).collect()
    exact = {}
    for q, x in rows:
        if q % 20 == 0:
            for v, y in rows:
                total = sum(Fraction(a) * Fraction(b) for a, b in zip(x, y, strict=True))
                exact[q, v] = float(total) if abs(total) < Fraction(np.finfo(float).max) else math.inf * (1 if total > 0 else -1)
    assert len(got) == 4 * 60 and {r.query_id for r in got} == {0, 20, 40, 100}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], rel=1e-9, abs=size * size * 1e-9) for r in got)
    for q in (0, 100):
        mine = [r for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
