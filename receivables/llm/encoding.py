"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across, whatever stands around it; such pairs
mark certain cuts. Every word is cut there, the fragments are encoded independently of each other with the
tokeniser's own merges, and the ids are concatenated. The last byte of a word carries the word-end mark and is a
symbol of its own ("e</w>"), so pairs with it are told apart from pairs without.

Defined results: a null text is empty (no ids, empty decoded text); repeated rows and null ``doc_id`` are kept as they
are; an empty table gives an empty result; other columns are ignored. Special-token strings inside a text become their
ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import pieces_of

MEMO_WORDS = 250_000  # bound of each memo of a worker; beyond it, words are encoded each time
WORD_END = "</w>"


def inner_pairs(vocabulary: list[str], word_end: str = WORD_END) -> set[tuple[str, str]]:
    """Every pair of adjacent symbols that occurs inside some token; a token's marked last byte is one symbol."""
    pairs = set()
    for token in vocabulary:
        symbols = list(token.removesuffix(word_end)) if token != word_end else []
        if token.endswith(word_end) and symbols:
            symbols[-1] += word_end
        pairs.update(zip(symbols, symbols[1:], strict=False))
    return pairs


class WordBpe:
    """A tokeniser file (JSON) with word ends, byte alphabet, lower-casing and white-space dropping."""

    # Characters for which NFC is the identity, and Python's classes and lower case agree with the tokeniser's.
    _PLAIN = re.compile("[\t-\r -~\xa0-ɏ]*")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = models.BPE(model["vocab"], merges, cache_capacity=0)
        self.final = models.BPE(model["vocab"], merges, end_of_word_suffix=WORD_END, cache_capacity=0)
        self.pairs = inner_pairs(list(model["vocab"]))
        self.token = {i: t for t, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in added.items()}
        self.special = {t: (1, str(i), t) for t, i in added.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others are moved up to 256.. in order.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        self.symbol = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}

    def fragment(self, text: str, last: bool) -> tuple[int, ...]:
        got = self.fragments.get((text, last))
        if got is None:
            got = tuple(t.id for t in (self.final if last else self.inner).tokenize(text))
            if len(self.fragments) < MEMO_WORDS and len(text) < 64:
                self.fragments[text, last] = got
        return got

    def word(self, pre_token: str) -> list[int]:
        """Cut one pre-token at its forced boundaries, encode the fragments, concatenate."""
        symbols = pre_token if pre_token.isascii() and pre_token.isprintable() else "".join(self.symbol[b] for b in pre_token.encode())
        last, pairs, ids, start = len(symbols) - 1, self.pairs, [], 0
        for i in range(last):
            if (symbols[i], symbols[i + 1] if i + 1 < last else symbols[last] + WORD_END) not in pairs:
                ids += self.fragment(symbols[start : i + 1], False)
                start = i + 1
        ids += self.fragment(symbols[start:], True)
        return ids

    def run(self, visible: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids, tokens) of a run without white space; each text form is joined by spaces."""
        ids = [i for w in self.pattern.findall(visible) for i in self.word(w)]
        out = (len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids)))
        if len(self.words) < MEMO_WORDS and len(visible) < 64:
            self.words[visible] = out
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by spaces, decoded text) of a whole text."""
        runs: list[tuple[int, str, str]] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                runs.append(self.special[part])
                continue
            if self._PLAIN.fullmatch(part):
                clean = part.lower()
            else:
                clean = self.library.normalizer.normalize_str(part)
                if not self._PLAIN.fullmatch(clean):  # beyond the classes Python shares with the tokeniser
                    pre = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]
                    ids = [i for w in pre for i in self.byte_word(w)]
                    runs.append((len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))))
                    continue
            known = self.words
            runs += [known[w] if w in known else self.run(w) for w in clean.split()]
        runs = [r for r in runs if r[0]]
        return sum(r[0] for r in runs), " ".join([r[1] for r in runs]), " ".join([r[2] for r in runs])

    def byte_word(self, symbols: str) -> list[int]:
        """As ``word`` for a pre-token already written in the byte alphabet."""
        last, ids, start = len(symbols) - 1, [], 0
        for i in range(last):
            if (symbols[i], symbols[i + 1] if i + 1 < last else symbols[last] + WORD_END) not in self.pairs:
                ids += self.fragment(symbols[start : i + 1], False)
                start = i + 1
        return [*ids, *self.fragment(symbols[start:], True)]


_BPE: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One tokeniser with its memos per Python worker."""
    if path not in _BPE:
        _BPE[path] = WordBpe(path)
    return _BPE[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                got = [bpe.encode(t or "") for t in batch.column("text")[lo:hi].to_pylist()]
                ids = [[int(x) for x in g[1].split()] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(ids, pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_texts``, with counts and digests in place of the ids and the decoded text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                rows = []
                for text in batch.column("text")[lo:hi].to_pylist():
                    n, ids, decoded = bpe.encode(text or "")
                    rows.append((n, sha(ids), sha(decoded)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[lo:hi],
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)
