"""Part codes against a plain integer loop, also beyond 64 bits; lower bounds never lose the nearest entry."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from receivables.llm import part_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code long, error string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, v, c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = Counter(len(v) for _, v, _ in kept).most_common(1)[0][0]
    kept = sorted((r for r in kept if len(r[1]) == d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = d // parts
    cut = [[[math.floor(Fraction(x) * scale) for x in v[p * w : (p + 1) * w]] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[r][p] for r in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(y, book):
        return min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            for j, members in groups.items():
                books[p][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    errors = [sum(s for s, _ in f) for f in found]
    per_label = Counter()
    for (_, _, c), e in zip(kept, errors, strict=True):
        per_label[c] += e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, per_label[c], digest) for (i, _, c), f, e in zip(kept, found, errors, strict=True)]


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e10])
def test_against_a_plain_loop(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i * 7 % 211, (rng.normal(size=8) * min(size, 1e3) + (size if i % 2 else -size)).tolist(), "abc"[i % 3] if i % 5 else None) for i in range(150)]
    rows += [(500 + i, [size] * 8, "a") for i in range(60)]  # one vector in many rows
    rows += [(3, rows[0][1], None), (None, rows[1][1], "b"), (None, rows[1][1], "b"), (900, [size] * 8, "c"), (901, [-size] * 8, "c")]
    rows += [(902, None, "a"), (903, [], "a"), (904, [1.0] * 4, "a"), (905, [math.nan] * 8, "a"), (906, [math.inf] * 8, "a"), (907, [1.0] * 7 + [None], "a")]
    same(part_codes.compress(table(spark, rows), 4, 6, 2, 256), brute(rows, 4, 6, 2, 256))


def test_huge_components(spark):
    """Beyond 64 bits: exact where the errors fit a long, an error otherwise."""
    rows = [(i, [1e300 * (i % 2), 1e308, -1e305, 3.5], "a") for i in range(6)]
    same(part_codes.compress(table(spark, rows), 2, 2, 2, 256), brute(rows, 2, 2, 2, 256))
    with pytest.raises(Exception, match="does not fit a long"):
        part_codes.compress(table(spark, rows), 2, 1, 2, 256).collect()


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(2, [1.0, 2.0, 3.0, 4.0], "a"), (1, [1.0, 2.0, -3.0, 0.5], None)]
    same(part_codes.compress(table(spark, rows), 2, 64, 2, 256), brute(rows, 2, 64, 2, 256))
    for none in ([], [(1, None, "a")]):
        got = part_codes.compress(table(spark, none))
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        part_codes.compress(table(spark, rows), 3)


@pytest.mark.parametrize("size", [40, 10**7, 10**11])
def test_bounds_order_and_prune(size):
    """The nearest entry with the fewest distances: ties included, less than half of all distances computed."""
    rng = np.random.default_rng(8)
    wide = size > 10**9
    numbers = part_codes.Numbers(wide, 1, 4, 1, "int64", "int64")
    x = numbers.integers(rng.integers(-size, size, (400, 4)).astype(float))
    x[:40] = x[0]
    entries = np.concatenate([x[100:158], x[100:106]])
    pivots = part_codes.spread_pivots(numbers, entries[:, None, :], 4)[0]
    gaps, entry_gaps = (numbers.roots(numbers.squares(v[:, None, :], pivots[None])) for v in (x, entries))
    arg, best, computed = part_codes.nearest(numbers, x, gaps, entries, entry_gaps)
    whole = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in x]
    assert [int(b) for b in best] == [min(w) for w in whole] and arg.tolist() == [w.index(min(w)) for w in whole]
    assert computed < 0.5 * len(x) * len(entries)
