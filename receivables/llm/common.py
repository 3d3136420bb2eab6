"""Helpers shared by the operators of this subpackage: table access, written tables, text buffers for numpy."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from receivables.session import ensure_checkpoint_dir

U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Local workers find this package like the driver does; a cluster gets it by its own means (--py-files).
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: later stages and retries of lost
    executors read the files, nothing is computed twice."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``row_key``, a hash of both; (doc_id, row_key) names a row up to exact repetition."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def pieces_of(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts together take about ``max_bytes`` (a single longer text is a range of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield start, stop
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; null is empty."""
    big = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(big, pa.ChunkedArray):
        big = big.combine_chunks()
    _, offsets, data = big.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[big.offset : big.offset + len(big) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and n + 1 offsets of the documents into them."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.empty(len(data) + 1, dtype=bool)
    first[0], first[-1] = True, True
    first[1:-1] = ~solid[:-1]
    first[offsets] = True  # a document's first byte starts anew, whatever stands before it
    starts = np.flatnonzero(solid & first[:-1])
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets <= len(data))]
    last[inner - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h *= MIX_B
    h ^= h >> U64(29)
    h *= MIX_A
    h ^= h >> U64(32)
    return h


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time over all words together."""
    padded = np.empty(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = length.astype(np.uint64) * MIX_A
    todo = np.arange(len(starts))
    at = 0
    while len(todo):
        left = length[todo] - at
        block = eight[starts[todo] + at]
        short = left < 8
        block[short] &= (U64(1) << (left[short].astype(np.uint64) * U64(8))) - U64(1)
        x = (h[todo] ^ block) * MIX_B
        h[todo] = (x ^ (x >> U64(31))) * MIX_A
        todo = todo[left > 8]
        at += 8
    return mix(h)


def hash_ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` consecutive word hashes (documents are not told apart here)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h *= U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(33)
        h += words[k : k + count]
    return mix(h)
