"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

The packing itself depends only on how many pieces there are of each length. Those counts (at most ``capacity`` rows,
whatever the corpus) are the only thing the driver sees: bins with equal remaining capacity are interchangeable, so
best-fit decreasing places all pieces of one length at once. A segment tree over the remaining capacities finds the
tightest open class in logarithmic time. The plan is a list of moves ("pieces r0..r1 of length L go into sequences
s0.., k per sequence, from offset o"); Spark ranks the pieces of each length and looks up their move.

Defined results: a null text is empty and becomes the single end token; an empty table gives an empty result; repeated
rows (also of one ``doc_id``) are packed as documents of their own; a null ``doc_id`` is carried through; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm.common import pieces_of, written

CAPACITY = 2048
MEMO_WORDS = 300_000  # entries of the per-worker memo; beyond that, words are encoded each time
BUCKET_ROWS = 2_000  # pieces of one length that are ranked together

PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, row_no long"


class SegmentTree:
    """Which capacities 0..n-1 have open bins; ``tightest(c)`` is the smallest one >= c in O(log n)."""

    def __init__(self, n: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.has = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        at += self.leaves
        self.has[at] = value
        while at > 1:
            at //= 2
            self.has[at] = self.has[2 * at] or self.has[2 * at + 1]

    def tightest(self, at: int) -> int | None:
        node = at + self.leaves
        if not self.has[node]:
            while node > 1 and (node % 2 or not self.has[node + 1]):  # climb to the first parent with a bin on its right
                node //= 2
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.has[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, first rank, end rank, first sequence, pieces per sequence, offset) that place ``counts[length]``
    pieces of each length. Equal to best-fit decreasing one piece at a time, with all bins of one remaining capacity
    handled together; the number of moves is bounded by the capacity, not by the number of pieces."""
    tree = SegmentTree(capacity + 1)
    bins: dict[int, list[list[int]]] = {}  # remaining capacity -> [first sequence, end) ranges
    moves = []
    used = 0

    def open_bins(left: int, first: int, end: int) -> None:
        if left > 0 and end > first:
            bins.setdefault(left, []).append([first, end])
            tree.set(left, True)

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                per = capacity // length
                whole, rest = divmod(todo, per)
                if whole:
                    moves.append((length, rank, rank + whole * per, used, per, 0))
                    open_bins(capacity - per * length, used, used + whole)
                    used += whole
                    rank += whole * per
                if rest:
                    moves.append((length, rank, rank + rest, used, rest, 0))
                    open_bins(capacity - rest * length, used, used + 1)
                    used += 1
                break
            first, end = bins[left].pop()
            if not bins[left]:
                tree.set(left, False)
            per = left // length
            take = min(end - first, todo // per)
            if take:
                moves.append((length, rank, rank + take * per, first, per, capacity - left))
                open_bins(left - per * length, first, first + take)
                rank, todo = rank + take * per, todo - take * per
                open_bins(left, first + take, end)
            else:  # fewer pieces than one bin could hold
                moves.append((length, rank, rank + todo, first, todo, capacity - left))
                open_bins(left - todo * length, first, first + 1)
                open_bins(left, first + 1, end)
                todo = 0
    return moves


class ByteBpe(dict):
    """Memo: leading white space with the visible run after it -> its ids as uint32 bytes.

    The pre-tokeniser never lets a token go on from a visible character into white space, so text may be cut there.
    Runs of Latin text are encoded with the rank file of the same vocabulary, anything else with the tokeniser itself;
    so are texts that hold a special token or one of the control characters on which engines differ.
    """

    _RUN = re.compile(r"\s*\S+|\s+")
    _LATIN = re.compile("[\t\n\r -~\xa1-\u024f]*")
    _CONTROL = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        super().__init__()
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path.removesuffix("json") + "tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.latin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        out = np.array(self.latin.encode_ordinary(run), dtype="<u4").tobytes() if self._LATIN.fullmatch(run) else self.by_library(run)
        if len(self) < MEMO_WORDS and len(run) < 64:
            self[run] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self._CONTROL.search(text):
            return self.by_library(text)
        return b"".join(map(self.__getitem__, self._RUN.findall(text)))


_BPE: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One tokeniser with its memo per Python worker."""
    if path not in _BPE:
        _BPE[path] = ByteBpe(path)
    return _BPE[path]


def piece_rows(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece: a document's ids and the end id, cut into pieces of ``capacity`` of which only the first may be
    shorter. ``with_ids`` adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, row_no, end = byte_bpe(path), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                out: list[list] = [[], [], [], [], [], [], []]
                for doc_id, text in zip(ids[lo:hi], batch.column("text")[lo:hi].to_pylist(), strict=True):
                    tokens = bpe.encode(text or "") + end
                    n = len(tokens) // 4
                    ends = range(n % capacity or capacity, n + 1, capacity)
                    for piece, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        part = tokens[4 * a : 4 * b]
                        for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(part), row_no, part), strict=True):
                            column.append(value)
                        row_no += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_no"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[6]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_FIELDS + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of a written table with ``length`` (1..capacity) and a distinct ``row_no`` its ``sequence_id`` and
    ``offset``; all other columns stay."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    # Every length is ranked in buckets of about BUCKET_ROWS pieces, so that a frequent length is not one task's.
    buckets = spark.createDataFrame([(k, math.ceil(n / BUCKET_ROWS)) for k, n in counts.items()], "length long, _buckets long")
    spread = pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("row_no"), "_buckets")).drop("_buckets")
    sizes = spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    moves = spark.createDataFrame(
        best_fit_decreasing(counts, capacity),
        "length long, _first long, _end long, _sequence long, _per long, _at long",
    )
    inside = Window.partitionBy("length", "_bucket").orderBy("row_no")
    ranked = spread.withColumn("_place", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    # The moves are bounded by the capacity, not by the corpus.
    met = ranked.alias("p").join(
        F.broadcast(moves).alias("m"),
        (F.col("p.length") == F.col("m.length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    )
    step = F.col("_rank") - F.col("_first")
    return met.select(
        *[F.col(f"p.`{c}`") for c in pieces.columns],
        (F.col("_sequence") + F.floor(step / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(step, F.col("_per")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    pieces = written(piece_rows(docs, path, capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity).drop("row_no")
