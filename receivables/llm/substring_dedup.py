"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash of the ``gram``-word runs
inside it (leftmost on ties). Consecutive windows with the same minimiser position travel together as one packed
string, keyed by the minimiser: equal windows have equal minimisers, so they meet in one bucket, where the windows of
all strings are sorted and counted.

Four passes over the documents, each a narrow map:

1. count how often each minimiser value starts a string (partial sums before the shuffle);
2. pack the strings whose minimiser occurs at least twice, add up equal strings (copies of a document collapse here),
   and count windows per bucket. A minimiser that occurs once cannot have a window that occurs elsewhere: two
   windows of one string that are equal would have their minimiser at two positions. The values that occur more than
   once are passed on as a bitmap of fixed size (``2 ** FILTER_BITS`` bits); false positives only cost traffic;
3. send every occurrence of a string that holds repeated windows back to its document;
4. write the documents without the covered words.

Buckets with many different strings are counted by a shuffle on the window itself instead of in one task. Results do
not depend on which way a bucket takes.

Defined results: null and empty texts have no words and lose none; documents shorter than the window keep everything;
exact repetitions of a row count as documents of their own; a null ``doc_id`` is carried through; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import U64, buffers, hash_ngrams, hash_words, mix, pieces_of, with_row_key, word_bounds, written

WINDOW = 35
GRAM = 8
FILTER_BITS = 26
BITMAP_BITS = 32768  # of one bitmap of Spark's bitmap functions
BUCKET_STRINGS = 4096  # different strings of one minimiser that a task sorts together
CHUNK_BYTES = 2 << 20


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` consecutive values, by doubling."""
    best = np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best


def super_kmers(words: np.ndarray, docs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, number of windows) of every super-k-mer; ``docs`` are n + 1 offsets into the words."""
    count = len(words) - window + 1
    empty = np.zeros(0, np.int64)
    if count <= 0:
        return np.zeros(0, np.uint64), empty, empty
    grams = hash_ngrams(words, gram)
    at = sliding_minimum(grams, window - gram + 1)
    of = np.searchsorted(docs, np.arange(count), side="right") - 1
    inside = np.arange(count) + window <= docs[of + 1]
    new = np.empty(count, dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    breaks = np.flatnonzero(new | ~inside)
    ends = np.append(breaks, count)[np.searchsorted(breaks, first, side="right")]
    return grams[at[first]], first, ends - first


def _chunks(batches: Iterator[pa.RecordBatch], *columns: str):
    """Parts of the batches with their bytes, words and super-k-mer inputs."""
    for batch in batches:
        for lo, hi in pieces_of(batch, "text", CHUNK_BYTES):
            data, offsets = buffers(batch.column("text")[lo:hi])
            starts, ends, docs = word_bounds(data, offsets)
            yield data, starts, ends, docs, [batch.column(c)[lo:hi] for c in columns]


def minimiser_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def count(batches):
        for data, starts, ends, doc_words, _ in _chunks(batches):
            values, _, _ = super_kmers(hash_words(data, starts, ends), doc_words, window, gram)
            values, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["minimiser", "n"])

    found = docs.select("text").mapInArrow(count, "minimiser long, n long")
    return found.groupBy("minimiser").agg(F.sum("n").alias("n"))


def repeated_filter(counts: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits over the minimisers that occur more than once; the same size for any corpus."""
    slot = F.shiftrightunsigned("minimiser", 64 - bits)
    maps = (
        counts.where("n > 1")
        .select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(BITMAP_BITS - 1).cast("long"))).alias("bitmap"))
    )
    out = np.zeros((max(1, (1 << bits) // BITMAP_BITS), BITMAP_BITS // 8), dtype=np.uint8)
    for r in maps.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return out.ravel()


def packed_strings(docs: DataFrame, seen: Broadcast, bits: int, window: int, gram: int, with_text: bool) -> DataFrame:
    """Every super-k-mer that may have company: minimiser, digest of the packed string, number of windows, and either
    the string itself or the place (doc_id, row_key, first word) it comes from."""

    def pack(batches):
        bitmap = seen.value
        for data, starts, ends, doc_words, (doc_id, row_key) in _chunks(batches, "doc_id", "row_key"):
            values, first, windows = super_kmers(hash_words(data, starts, ends), doc_words, window, gram)
            slot = values >> U64(64 - bits)
            on = (bitmap[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1
            keep = np.flatnonzero(on)
            values, first, windows = values[keep], first[keep], windows[keep]
            raw = data.tobytes()
            strings = [b" ".join(raw[a:b].split()) for a, b in zip(starts[first].tolist(), ends[first + windows + window - 2].tolist(), strict=True)]
            digests = pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in strings], pa.binary())
            base = [pa.array(values.view(np.int64)), digests, pa.array(windows.astype(np.int32))]
            if with_text:
                yield pa.RecordBatch.from_arrays([*base, pa.array(strings, pa.binary())], ["minimiser", "digest", "windows", "words"])
            else:
                of = np.searchsorted(doc_words, first, side="right") - 1
                own = [doc_id.take(pa.array(of)), row_key.take(pa.array(of)), pa.array((first - doc_words[of]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*base, *own], ["minimiser", "digest", "windows", "doc_id", "row_key", "first"])

    more = "words binary" if with_text else "doc_id long, row_key long, first int"
    return docs.mapInArrow(pack, f"minimiser long, digest binary, windows int, {more}")


def window_keys(strings: list[bytes], windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window of every string, string after string."""
    joined = pa.array(strings, pa.large_binary())
    data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[: len(strings) + 1]
    starts, ends, docs = word_bounds(data, offsets)
    words = hash_words(data, starts, ends)
    first = np.repeat(docs[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(int(windows.sum()))
    a, b = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    other = mix(words ^ U64(0xA5A5A5A5A5A5A5A5))
    for k in range(window):
        a = a * U64(0x9E3779B97F4A7C15) + words[first + k]
        a ^= a >> U64(33)
        b = b * U64(0xC2B2AE3D27D4EB4F) + other[first + k]
        b ^= b >> U64(31)
    return mix(a), mix(b)


def _same_words(strings: list[bytes], owner: np.ndarray, place: np.ndarray, window: int, pairs: np.ndarray) -> None:
    """Compare the words of windows that sorting put together; a difference would mean a hash collision."""
    split: dict[int, list[bytes]] = {}

    def words(i: int) -> list[bytes]:
        k = int(owner[i])
        if k not in split:
            split[k] = strings[k].split(b" ")
        return split[k][int(place[i]) : int(place[i]) + window]

    for i, j in pairs:
        if words(i) != words(j):
            raise ValueError("two different windows share a 128-bit key")


def flagged_in_tasks(strings: DataFrame, window: int) -> DataFrame:
    """digest and the repeated windows (as bits) of every string that has any; ``strings`` are distinct, with their
    number of occurrences ``n``. All strings of a minimiser lie in one partition, next to each other."""

    def judge(rows: list) -> pa.RecordBatch:
        texts, windows = [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)
        times = np.repeat(np.array([r[3] for r in rows], dtype=np.int64), windows)
        a, b = window_keys(texts, windows, window)
        order = np.lexsort((b, a))
        same = np.empty(len(order), dtype=bool)
        same[0] = False
        same[1:] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        group = np.cumsum(~same) - 1
        total = np.bincount(group, weights=times[order])
        repeated = np.empty(len(order), dtype=bool)
        repeated[order] = total[group] > 1
        starts = np.concatenate([[0], np.cumsum(windows)[:-1]])
        owner = np.repeat(np.arange(len(rows)), windows)
        place = np.arange(len(owner)) - starts[owner]
        met = np.flatnonzero(same)
        _same_words(texts, owner, place, window, np.stack([order[met - 1], order[met]], axis=1).tolist() if len(met) else [])
        has = np.flatnonzero(np.add.reduceat(repeated, starts))
        bits = [np.packbits(repeated[starts[k] : starts[k] + windows[k]]).tobytes() for k in has]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in has], pa.binary()), pa.array(bits, pa.binary())], ["digest", "bits"])

    def count(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("minimiser", "digest", "words", "windows", "n")]
            for minimiser, *row in zip(*columns, strict=True):
                if minimiser != last and size >= CHUNK_BYTES:
                    yield judge(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
                last = minimiser
        if rows:
            yield judge(rows)

    dealt = strings.repartition("minimiser").sortWithinPartitions("minimiser")
    return dealt.select("minimiser", "digest", "words", "windows", "n").mapInArrow(count, "digest binary, bits binary")


def flagged_by_window(strings: DataFrame, window: int) -> DataFrame:
    """As ``flagged_in_tasks`` for buckets of any size: windows are dealt out by their own words and added up there."""

    def explode(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                windows = part.column("windows").to_numpy(zero_copy_only=False).astype(np.int64)
                a, b = window_keys(part.column("words").to_pylist(), windows, window)
                owner = np.repeat(np.arange(part.num_rows), windows)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest").take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column("n").take(pa.array(owner))],
                    ["digest", "place", "a", "b", "n"],
                )

    each = strings.select("digest", "words", "windows", "n").mapInArrow(explode, "digest binary, place int, a long, b long, n long")
    repeated = each.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").select("a", "b")
    hit = each.select("digest", "place", "a", "b").join(repeated, ["a", "b"])
    # A string has at most window - gram + 1 windows, so the list of a digest is short.
    places = hit.groupBy("digest").agg(F.collect_set("place").alias("places"))
    bit = F.transform(F.sequence(F.lit(0), F.lit(window)), lambda i: F.when(F.array_contains("places", i.cast("int")), "1").otherwise("0"))
    return places.select("digest", F.unhex(F.lpad(F.conv(F.rpad(F.array_join(bit, ""), 64, "0"), 2, 16), 16, "0")).alias("bits"))


def covered_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, row_key, spans): ranges of words covered by windows that occur more than once, as "first:end" pairs in an
    array of structs; only documents that have any. ``docs`` comes from ``with_row_key``."""
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(repeated_filter(minimiser_counts(docs, window, gram), filter_bits))
    with_text = packed_strings(docs, seen, filter_bits, window, gram, True)
    distinct = with_text.groupBy("minimiser", "digest", "windows", "words").agg(F.count(F.lit(1)).alias("n"))
    distinct = written(distinct, "super-kmers")
    crowded = distinct.groupBy("minimiser").agg(F.count(F.lit(1)).alias("strings")).where(F.col("strings") > BUCKET_STRINGS)
    crowded = written(crowded.select("minimiser"), "crowded-minimisers")
    flagged = flagged_in_tasks(distinct.join(crowded, "minimiser", "left_anti"), window).unionByName(
        flagged_by_window(distinct.join(crowded, "minimiser", "left_semi"), window)
    )
    places = packed_strings(docs, seen, filter_bits, window, gram, False).select("digest", "doc_id", "row_key", "first")
    hits = places.join(flagged, "digest")

    def ranges(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("first").to_numpy(zero_copy_only=False).astype(np.int64)
            of, at = [], []
            for k, bits in enumerate(batch.column("bits").to_pylist()):
                on = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                of.append(np.full(len(on), k))
                at.append(on + first[k])
            of, at = np.concatenate(of), np.concatenate(at)
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(at)) - 1
            pick = pa.array(of[start])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pick), batch.column("row_key").take(pick), pa.array(at[start].astype(np.int32)), pa.array((at[end] + window).astype(np.int32))],
                ["doc_id", "row_key", "first", "end"],
            )

    spans = hits.select("doc_id", "row_key", "first", "bits").mapInArrow(ranges, "doc_id long, row_key long, first int, end int")
    # At most one range per super-k-mer and window of the row: bounded by its own length. A set, as rows may repeat.
    return spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def keep_words(text: str | None, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(kept words joined by one space, number of words, number of removed words)."""
    words = (text or "").encode().split()
    n = len(words)
    if spans:
        gone = np.zeros(n + 1, dtype=np.int32)
        np.add.at(gone, [s["first"] for s in spans], 1)
        np.add.at(gone, [s["end"] for s in spans], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words), n, n - len(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """doc_id, row_key, n_words, n_removed and the kept words (joined by one space), or with ``digests`` their sha256."""
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = covered_words(keyed, window, gram)
    s = spans.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "spans")
    met = keyed.join(s, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def cut(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                out: tuple[list, ...] = ([], [], [])
                for text, spans_ in zip(batch.column("text")[lo:hi].to_pylist(), batch.column("spans")[lo:hi].to_pylist(), strict=True):
                    kept, n, removed = keep_words(text, spans_)
                    for column, value in zip(out, (n, removed, hashlib.sha256(kept).hexdigest() if digests else kept.decode()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], batch.column("row_key")[lo:hi], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                    ["doc_id", "row_key", "n_words", "n_removed", kept_name],
                )

    kept_name = "kept_sha256" if digests else "kept_text"
    return met.select("doc_id", "row_key", "text", "spans").mapInArrow(
        cut, f"doc_id long, row_key long, n_words long, n_removed long, {kept_name} string"
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the covered words taken out of ``text`` (kept words joined by one space); texts that lose nothing, and
    all other columns, stay as they are."""
    spans = covered_words(with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), window, gram)
    s = spans.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__of"), F.col("spans").alias("__spans"))
    marked = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    met = marked.join(s, (F.col("__key") == F.col("__of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left")

    def cut(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", 4 << 20):
                part = batch.slice(lo, hi - lo)
                texts = [keep_words(t, s)[0].decode() if s else t for t, s in zip(part.column("text").to_pylist(), part.column("__spans").to_pylist(), strict=True)]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part.select(part.schema.names[:-1])

    return met.select(*docs.columns, "__spans").mapInArrow(cut, docs.schema)
