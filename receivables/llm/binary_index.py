"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A bounded sample (``SAMPLE`` vectors with the smallest id hashes) teaches two rotations by iterative quantisation; the
signs of a rotated vector are its code of ``2 * d'`` bits, filled up to whole bytes. Every row is indexed: its code is cut into 8-bit
substrings, and each block of the index keeps one bucket table per substring. A query probes, in each table, all
values within radius r // m of its own substring (m substrings): by the pigeonhole principle that finds every code
within Hamming radius r. Verification compares whole codes of every query and row of a block pair, and keeps the pairs
that were also probed: a full code scan, to whose result the probes add and take nothing. The pairs within the radius are
reranked by the inner product of the floats.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so that a larger inner product with a
query means a smaller angle. The radius is the ``REACH`` quantile of the code distances between ``PROBES`` sample
queries and their true neighbours among all rows. Queries that find fewer than k rows within it are searched again
with the full radius, which is exact.

Queries and index blocks meet block by block: each task holds one block of each, however skewed the data.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another dimension than most
take no part, as queries or as candidates; neither do rows with null vec_id; of repeated ids the smallest vector
stands; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored. Very large and very
small components are scaled by a power of two for the codes; scores are of the original vectors, and a product that overflows
a double on its way is taken from exact sums (infinite where the sum itself is beyond a double).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm import vectors
from receivables.llm.common import written

K = 20
SAMPLE = 4000
ROTATIONS = 2
ITERATIONS = 30
PROBES = 64
REACH = 0.98
INDEX_BLOCK, QUERY_BLOCK = 4096, 512

_BITS = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)
_APART = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def learned_rotations(sample: np.ndarray, seed: int = 11) -> np.ndarray:
    """(d + 1) x bits: rotations that bring the sample close to the corners of the cube (iterative quantisation)."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    out = []
    for _ in range(ROTATIONS):
        rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(ITERATIONS):
            corners = np.where(sample @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ corners)
            rotation = u @ v
        out.append(rotation)
    return np.hstack(out)


def codes(x: np.ndarray, rotations: np.ndarray, largest: float) -> np.ndarray:
    """n x m bytes."""
    return np.packbits(lift(x, largest) @ rotations >= 0, axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components (the same for equal vectors anywhere)."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        with np.errstate(over="ignore", invalid="ignore"):
            out += q[:, k] * x[:, k]
    for i in np.flatnonzero(~np.isfinite(out)):
        total = sum(Fraction(a) * Fraction(b) for a, b in zip(q[i].tolist(), x[i].tolist(), strict=True))
        try:
            out[i] = float(total)
        except OverflowError:
            out[i] = np.inf if total > 0 else -np.inf
    return out


def words(code: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    padded = np.zeros((len(code), -(-code.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : code.shape[1]] = code
    return padded.view(np.uint64)


class Buckets:
    """The bucket tables of one block: for every substring, its rows sorted by value."""

    def __init__(self, code: np.ndarray):
        self.order = np.argsort(code, axis=0, kind="stable")
        self.bounds = np.stack([np.searchsorted(code[self.order[:, s], s], np.arange(257)) for s in range(code.shape[1])])

    def within(self, queries: np.ndarray, code: np.ndarray, radius: int) -> np.ndarray:
        """Which rows (columns) have a code within the radius of each query (rows)."""
        m = code.shape[1]
        near = _APART <= radius // m
        hit = np.zeros((len(queries), len(code)), dtype=bool)
        for s in range(m):
            probes = near[queries[:, s]]  # query x value
            order, bounds = self.order[:, s], self.bounds[s].tolist()
            for value in np.flatnonzero(np.diff(bounds)).tolist():
                asked = probes[:, value].nonzero()[0]
                if len(asked):
                    hit[asked[:, None], order[bounds[value] : bounds[value + 1]]] = True
        apart = np.zeros(hit.shape, dtype=np.uint16)
        for a, b in zip(words(queries).T, words(code).T, strict=True):
            apart += np.bitwise_count(a[:, None] ^ b[None, :])
        hit &= apart <= radius
        return hit


def search_blocks(index: DataFrame, queries: DataFrame, shards: int, d: int, m: int, radius: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every query in every block."""
    left = index.select(F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), F.col("ids").alias("i"), F.col("vectors").alias("v"), F.col("code").alias("c"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ids", "vectors", "code")

    def search(batches):
        last, table = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["i"], np.int64), np.frombuffer(row["v"]).reshape(-1, d)
                code = np.frombuffer(row["c"], np.uint8).reshape(-1, m)
                if last is None or last != row["i"]:
                    last, table = row["i"], Buckets(code)
                qids, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, d)
                hit = table.within(np.frombuffer(row["code"], np.uint8).reshape(-1, m), code, radius)
                a, b = np.nonzero(hit & (qids[:, None] != ids[None, :]))
                score = exact_scores(q[a], x[b])
                top = vectors.best(a, score, ids[b], k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[a[top]]), pa.array(ids[b[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return left.join(right, "shard").drop("shard").mapInArrow(search, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query, k: int = K, reach: float = REACH) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner products found for every query."""
    spark = embeddings.sparkSession
    rows = written(vectors.valid(embeddings, allow_zero=False), "vectors")
    d = vectors.dimension(rows)
    rows = rows.where(F.size("vector") == d)
    total, most = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    exponent = int(np.frexp(most)[1])
    shrink = 1.0 if abs(exponent) < 400 else 2.0 ** -min(exponent, 1022)
    square = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x * shrink) * (x * shrink)))).first()[0]
    largest = float(square) ** 0.5
    rotations = learned_rotations(lift(vectors.sample(rows, SAMPLE) * shrink, largest))
    rotations = np.hstack([rotations, rotations[:, : -rotations.shape[1] % 8]])  # whole bytes
    m = rotations.shape[1] // 8
    code = lambda x: {"code": codes(x * shrink, rotations, largest).tobytes()}
    index = vectors.blocks(rows, d, INDEX_BLOCK, "code-index", code, "code binary")
    asked = rows.where(is_query(F.col("vec_id")))
    queries = vectors.blocks(asked, d, QUERY_BLOCK, "code-queries", code, "code binary")
    shards = max(1, index.count())
    radius = calibrated_radius(index, vectors.sample(asked, PROBES), rotations, largest, d, m, k, reach, shrink)
    found = written(ranked(search_blocks(index, queries, shards, d, m, radius, k), k), "neighbours")
    short = asked.join(found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)), F.col("vec_id") == F.col("query_id"), "left_anti")
    short = vectors.blocks(short, d, QUERY_BLOCK, "code-queries", code, "code binary")
    if not short.count():
        return found
    again = ranked(search_blocks(index, short, shards, d, m, 8 * m, k), k)
    return found.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)


def calibrated_radius(index: DataFrame, probes: np.ndarray, rotations: np.ndarray, largest: float, d: int, m: int, k: int, reach: float, shrink: float = 1.0) -> int:
    """The code distance within which a share ``reach`` of the probes' true neighbours lies; all rows are compared."""
    if not len(probes):
        return 8 * m
    probes = probes * shrink
    own = codes(probes, rotations, largest)

    def compare(batches):
        for batch in batches:
            for row in batch.select(["vectors", "code"]).to_pylist():
                x, code = np.frombuffer(row["vectors"]).reshape(-1, d), np.frombuffer(row["code"], np.uint8).reshape(-1, m)
                score = probes @ (x * shrink).T
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                a = np.repeat(np.arange(len(probes)), top.shape[1])
                b = top.ravel()
                apart = _BITS[own[a] ^ code[b]].sum(axis=1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(score[a, b]), pa.array(apart)], ["probe", "score", "apart"])

    best = Window.partitionBy("probe").orderBy(F.desc("score"), "apart")
    near = index.select("vectors", "code").mapInArrow(compare, "probe int, score double, apart int")
    near = near.withColumn("r", F.row_number().over(best)).where((F.col("r") > 1) & (F.col("r") <= k + 1))  # the first is the probe itself
    return int(near.agg(F.percentile("apart", F.lit(reach))).first()[0] or 8 * m)
