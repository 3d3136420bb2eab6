"""Ranked lexical search: range-maximum sparse tables over posting lists, best-first over document intervals.

The index is a table of blocks: up to ``BLOCK_DOCS`` documents of a scan partition, sorted by doc_id, with the posting
lists (document, occurrences) of the terms that the query set asks for and the lengths of all documents. Tokenising and
indexing are one pass without a shuffle; corpus counts (N, L, and df per asked term) are added up from the blocks.

A search turns a block's occurrences into integer impacts and builds one sparse table over its posting lists, which
gives the position of the largest impact in any range of a list in constant time. An interval of documents is bounded by the
sum of its lists' range maxima. From the whole block on, the intervals with the highest bounds are split at the document
that holds the largest single impact in them: that document is scored exactly, the two sides get bounds of their own. An
interval whose bound cannot beat the k-th score so far is dropped (on equal bounds, when all its ids are larger than
the k-th document's), and a query ends when none is left: results are exact. Several intervals are
split at a time so that numpy does the arithmetic. The k best so far are carried from block to block within a task.

Score (all integers but the logarithm): a term has the weight w = floor(1000 * ln((2N + 2) / (2df + 1))), a document of n
terms has m = 25 + 75nN div L, and the score adds w * (10^9 tf div (1000 tf + 8m)) over the terms of the query, repeats
included. N counts documents with a term, L all their terms.

Queries are a stated set and pass through the driver in blocks of at most ``QUERY_ROWS`` rows and ``QUERY_BYTES`` bytes; each
block of queries is one index pass and one search pass over all documents. What is sent to the tasks (terms, weights,
queries) is bounded by a block. Nothing is kept per document outside the index, and a task puts out k rows per query.

Defined results: terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A null or empty
text has no term and is never found; as a query it finds nothing. Documents with a null doc_id count in N, L and df, but are
not put out (nothing names them). Repeated rows are documents of their own, so a doc_id may fill several ranks. Every row of the
query table is an item; null and repeated item_ids are put out as they are. Ties go to the smaller doc_id. An empty table on
either side gives an empty result. Other columns are ignored. Texts of any length are indexed whole, in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from receivables.llm.common import written

K = 10
BLOCK_DOCS, BLOCK_HITS = 8192, 1_500_000
BLOCKS_PER_TASK = 8
QUERY_ROWS, QUERY_BYTES = 4096, 4 << 20
PIECE = 1 << 22  # bytes of text that are cut into words at a time
CELLS = 1 << 15  # interval x term cells that are split at a time

# Every ASCII byte that is no letter or digit ends a term; bytes from 0x80 on belong to one.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else (text.find(b" ", end) + len(text) + 1) % (len(text) + 1)
        yield text[at:end].split()
        at = end


def query_blocks(items: DataFrame) -> Iterator[list[Row]]:
    held, size = [], 0
    rows = items.select("item_id", "text").where(F.col("text").isNotNull())
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if held and (len(held) >= QUERY_ROWS or size + len(r.text) > QUERY_BYTES):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r.text)
    if held:
        yield held


def index_blocks(docs: DataFrame, terms: dict[bytes, int], block_docs: int = BLOCK_DOCS, block_hits: int = BLOCK_HITS) -> DataFrame:
    """Written blocks: block, with_terms (documents that hold a term), total (their terms), ids and known (binary, by place),
    lengths, terms (numbers of the terms that occur), sizes of their lists, and the lists' places and occurrences."""

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        get = terms.get
        ids, lengths, hits, per_doc = [], [], [], []

        def block():
            n = len(ids)
            known = np.array([i is not None for i in ids], dtype=bool)
            plain = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            order = np.lexsort((plain, ~known))
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            keys = np.array(hits, np.int64) * n + np.repeat(place, per_doc)
            keys, tf = np.unique(keys, return_counts=True)
            found, sizes = np.unique(keys // n, return_counts=True)
            length = np.array(lengths, np.int64)
            values = [
                number, int((length > 0).sum()), int(length.sum()), plain[order].tobytes(), known[order].astype(np.uint8).tobytes(),
                length[order].tobytes(), found.tolist(), sizes.tolist(), (keys % n).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes(),
            ]
            types = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.int32()), pa.list_(pa.int64())] + [pa.binary()] * 2
            names = ["block", "with_terms", "total", "ids", "known", "lengths", "terms", "sizes", "places", "tfs"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                before, n = len(hits), 0
                text = text.as_buffer() if text.is_valid else None
                for words in terms_of(text.to_pybytes()) if text is not None else ():
                    n += len(words)
                    hits.extend(t for t in map(get, words) if t is not None)
                if not n:
                    continue
                ids.append(doc)
                lengths.append(n)
                per_doc.append(len(hits) - before)
                if len(ids) >= block_docs or len(hits) >= block_hits:
                    yield block()
                    number += 1
                    for held in (ids, lengths, hits, per_doc):
                        held.clear()
        if ids:
            yield block()

    schema = "block long, with_terms long, total long, ids binary, known binary, lengths binary, terms array<int>, sizes array<long>, places binary, tfs binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(build, schema), "postings")


class Lists:
    """A block's posting lists, end to end, with one sparse table of range maxima over them."""

    def __init__(self, n: int, sizes: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        self.n, self.impacts = n, impacts
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.places = places
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * n + places
        longest = int(sizes.max()) if len(sizes) else 1
        self.levels = [np.arange(len(places), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            below, half = self.levels[-1], 1 << (j - 1)
            a, b = below[: max(0, len(below) - half)], below[half:]
            # Ranges that cross a list's end are never asked for.
            self.levels.append(np.where(impacts[b] > impacts[a], b, a))
        width = len(places)
        self.table = np.zeros((len(self.levels), width), np.int32)
        for j, level in enumerate(self.levels):
            self.table[j, : len(level)] = level
        del self.levels
        self.log = np.zeros(longest + 1, np.int8)
        for j in range(1, longest.bit_length()):
            self.log[1 << j :] = j

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions of the largest impacts in the ranges [lo, hi) of lists; -1 for empty ranges."""
        size = hi - lo
        some = size > 0
        j = self.log[np.where(some, size, 1)].astype(np.int64)
        left = np.where(some, lo, 0)
        right = np.where(some, hi - (np.int64(1) << j), 0)
        a, b = self.table[j, left], self.table[j, right]
        best = np.where(self.impacts[b] > self.impacts[a], b, a)
        return np.where(some, best, -1)


def search_block(lists: Lists, ids: np.ndarray, known: np.ndarray, own: np.ndarray, times: np.ndarray, top: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
    """``top``, up to k (-score, doc_id) in order, after the block's documents; and how many were scored. ``own`` are the
    query's lists in this block, ``times`` how often the query holds each term."""

    def offer(scores: np.ndarray, places: np.ndarray) -> None:
        floor = -top[-1][0] if len(top) == k else 1
        good = (scores >= floor) & known[places] & (scores > 0)
        if good.any():
            found = sorted([*top, *zip((-scores[good]).tolist(), ids[places[good]].tolist(), strict=True)])
            top[:] = found[:k]

    def bounded(a, b, lo, hi):
        """Intervals with their bounds and splitting documents."""
        best = lists.maxima(lo, hi)
        value = np.where(best >= 0, lists.impacts[best], 0) * times
        most = best[np.arange(len(best)), value.argmax(axis=1)]
        return [a, b, lo, hi, value.sum(axis=1), lists.places[most]]

    def alive(front):
        if len(top) < k:
            keep = front[4] > 0
        else:
            score, last = -top[-1][0], top[-1][1]
            keep = (front[4] > score) | ((front[4] == score) & (ids[np.minimum(front[0], lists.n - 1)] < last))
        keep &= front[4] > 0
        return [c[keep] for c in front] if not keep.all() else front

    at_once = max(4, CELLS // len(own))
    front = bounded(np.array([0]), np.array([lists.n]), lists.starts[own][None, :], lists.starts[own + 1][None, :])
    scored, batch = 0, 4
    while True:
        front = alive(front)
        if not len(front[4]):
            return top, scored
        many = min(batch, at_once)
        if len(front[4]) > many:
            pick = np.argpartition(front[4], len(front[4]) - many)[-many:]
            rest = np.ones(len(front[4]), bool)
            rest[pick] = False
            now, front = [c[pick] for c in front], [c[rest] for c in front]
        else:
            now, front = front, None
        batch *= 2
        a, b, lo, hi, _, split = now
        at = np.searchsorted(lists.keys, own[None, :] * lists.n + split[:, None])
        inside = np.minimum(at, len(lists.keys) - 1)
        has = (at < hi) & (lists.keys[inside] == own[None, :] * lists.n + split[:, None])
        offer((np.where(has, lists.impacts[inside], 0) * times).sum(axis=1), split)
        scored += len(split)
        sides = bounded(np.concatenate([a, split + 1]), np.concatenate([split, b]), np.concatenate([lo, at + has]), np.concatenate([at, hi]))
        sides = alive(sides)
        front = sides if front is None else [np.concatenate([x, y]) for x, y in zip(front, sides, strict=True)]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(blocks: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): each task's k best documents of every query."""

    def run(batches):
        tops: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8).astype(bool)
                length = np.frombuffer(row["lengths"], np.int64)
                places, tf = np.frombuffer(row["places"], np.int32).astype(np.int64), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
                terms, sizes = np.array(row["terms"], np.int64), np.array(row["sizes"], np.int64)
                m = 25 + 75 * length * n_docs // n_terms if n_docs < 2**20 else np.array([25 + 75 * int(x) * n_docs // n_terms for x in length], np.int64)
                impacts = np.repeat(weights[terms], sizes) * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
                if not len(places):
                    continue
                lists = Lists(len(ids), sizes, places, impacts)
                number = np.full(len(weights), -1)
                number[terms] = np.arange(len(terms))
                for q, (mine, times) in enumerate(queries):
                    own = number[mine]
                    on = own >= 0
                    if on.any():
                        tops[q], _ = search_block(lists, ids, known, own[on], times[on], tops[q], k)
        out = [(q, doc, -score) for q, top in enumerate(tops) for score, doc in top]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "doc_id", "score"])

    return blocks.mapInArrow(run, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item; see the module."""
    spark = docs.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    out = None
    for held in query_blocks(items):
        words = [[w for piece in terms_of(r.text.encode()) for w in piece] for r in held]
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        if not vocabulary:
            continue
        queries = [np.unique(np.array([vocabulary[w] for w in ws], np.int64), return_counts=True) for ws in words]
        index = index_blocks(docs, vocabulary, block_docs)
        n_blocks, n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("with_terms"), F.sum("total")).first()
        if not n_docs:
            break
        lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in lists.collect():  # at most one row per asked term
            weights[r.term] = weight(n_docs, r.df)
        # A block is a few MB: a task gets a few of them, whatever the sizes of the index files.
        dealt = index.repartition(max(1, -(-n_blocks // BLOCKS_PER_TASK)), "block")
        found = search(dealt, queries, weights, n_docs, n_terms, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(held)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


ORACLE = r"""
WITH words AS (
  SELECT rn, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rn, doc_id, text FROM documents)
), tf AS (
  SELECT rn, doc_id, term, count(*) AS tf FROM words GROUP BY rn, doc_id, term
), len AS (
  SELECT rn, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rn
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, tf.rn, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN len ON len.rn = tf.rn, corpus GROUP BY item_id, tf.rn, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
