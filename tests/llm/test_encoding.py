"""Forced-boundary BPE against the tokenizer library."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from receivables.llm import encoding, registry

from .conftest import EDGE_ROWS, SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=60) | st.text("abcXYZ '’.,!?#019éÜßſİı<|>startofendx \t\n", max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert encoding.word_bpe(PATH).encode(text) == expected(text)


def test_every_character_block():
    bpe = encoding.word_bpe(PATH)
    for start in [*range(0, 0x3000, 48), 0xAC00, 0xFB00, 0xFF00, 0x1F600]:
        chars = [chr(c) for c in range(start, start + 48) if not 0xD800 <= c < 0xE000]
        for text in ("".join(chars), " ".join(chars), "x".join(chars)):
            assert bpe.encode(text) == expected(text), hex(start)


def test_cuts_are_at_pairs_outside_the_vocabulary():
    pairs = encoding.inner_pairs(["ab", "abc</w>", "d</w>", "xyz"])
    assert pairs == {("a", "b"), ("b", "c</w>"), ("x", "y"), ("y", "z")}
    bpe = encoding.word_bpe(PATH)
    seen = []
    fragment = bpe.fragment
    bpe.fragment = lambda text, last: seen.append((text, last)) or fragment(text, last)
    try:
        bpe.word("!\"q#x")
    finally:
        del bpe.fragment
    assert len(seen) > 1 and [last for _, last in seen] == [False] * (len(seen) - 1) + [True]


def test_edges_and_arrays(frame):
    rows = encoding.encode_digests(frame(EDGE_ROWS), PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in EDGE_ROWS:
        n, ids, decoded = expected(text)
        want.append((doc_id, n, sha(ids), sha(decoded)))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    whole = encoding.encode_texts(frame(EDGE_ROWS), PATH).collect()
    assert sorted((repr(r.doc_id), " ".join(map(str, r.ids)), r.decoded) for r in whole) == sorted((repr(d), *expected(t)[1:]) for d, t in EDGE_ROWS)
    assert encoding.encode_digests(frame([]), PATH).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.queries()["op8_forced_boundary_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, ids, decoded = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
