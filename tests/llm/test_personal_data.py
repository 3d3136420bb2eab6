"""Base spans against plain regular expressions; the random field's inference against enumeration."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from receivables.llm import personal_data as P
from receivables.llm import registry

from .conftest import EDGE_ROWS, SF

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        odd = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
        return 13 <= len(digits) <= 19 and odd % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group())] for k, p in PATTERNS.items()}


_PARTS = ["1", "25", "0", ".", ".", "@", "a", "-", " ", "+", "(", ")", "x.y", "é", "_", "4111111111111111", "\n", "255.1.2.3", "+1 (212) 555-0187"]


@given(st.lists(st.sampled_from(_PARTS), max_size=30))
@settings(max_examples=1500, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    assert P.base_spans(text) == plain(text)


@pytest.fixture(scope="module")
def weights(spark):
    """As the query has them, from the zones of a whole table."""
    return P.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_inference_is_the_best_of_all_segmentations(weights):
    for text in ("+1 (212) 555-0187 10.0.0.1", "a@b.co 4111111111111111 x", "4111-1111-1111-1111,a@b.c"):
        for start, end in P.zones(text):
            tokens, found = P.candidates(text, start, end)
            score = [float((f @ weights.T).max()) - P.LEAST_SCORE for _, _, f in found]
            best = 0.0
            for n in range(1, 4):
                for pick in itertools.combinations(range(len(found)), n):
                    spans = sorted(found[c][:2] for c in pick)
                    if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                        best = max(best, sum(score[c] for c in pick))
            got = P.best_segments(len(tokens), found, weights)
            place = {f[:2]: s for f, s in zip(found, score)}
            assert abs(sum(place[i, j] for i, j, _ in got) - best) < 1e-9


def test_gradient_matches_differences(weights):
    examples = P._example("+1 (212) 555-0187 and 10.0.0.1", P.base_spans("+1 (212) 555-0187 and 10.0.0.1"))
    rng = np.random.default_rng(0)
    w = rng.normal(size=weights.shape) / 4
    _, gradient = P._likelihood(examples, w)
    for k, f in [(0, 0), (1, 8), (3, 3), (3, 18), (2, 10)]:
        e = np.zeros_like(w)
        e[k, f] = 1e-5
        slope = (P._likelihood(examples, w + e)[0] - P._likelihood(examples, w - e)[0]) / 2e-5
        assert abs(slope - gradient[k, f]) < 1e-4


def test_adds_what_the_rules_miss(weights):
    base, spans = P.all_spans("call (212) 555-0187 or 4111111111111111 5500005555555559 now", weights)
    assert base["phone"] == [] and base["card"] == []
    assert spans["phone"] == [(5, 19)] and spans["card"] == [(23, 39), (40, 56)]
    for clean in ("version 1.2.3 of 2024-01-02", "page 12, line 34", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "4.0 and 3.5", "net 4111.1111.1111.1111 x", "10.0.300.1", "4111111111111112"):
        assert not any(P.all_spans(clean, weights)[1].values())


def test_masking():
    assert P.masked("a x@y.z b", {"email": [(2, 7)], "ip": [], "card": [], "phone": []}) == "a [EMAIL] b"
    assert P.masked("0123456789", {"email": [], "ip": [(2, 5)], "card": [(0, 4)], "phone": [(8, 9)]}) == "[CARD]567[PHONE]9"


def test_edges(frame):
    rows = EDGE_ROWS + [(20, "a@b.co " * 3), (21, "1." * 3000 + "@" * 500 + "+1 " * 500 + "9" * 5000)]
    got = P.find(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = next(plain(t or "") for d, t in rows if d == r.doc_id)
        if r.doc_id is not None:
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in P.KINDS)
    assert P.find(frame([])).count() == 0
    docs = frame([(1, None), (2, "write to a@b.co")])
    assert P.masked_texts(docs).columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in P.masked_texts(docs).collect()) == [(1, None), (2, "write to [EMAIL]")]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.queries()["op2_semi_markov_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k in P.KINDS for a, b in base[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))
