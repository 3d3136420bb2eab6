"""Exact top-k search with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, and the index is the table sorted by that key, cut
into blocks: each block is an annulus [least, most] around one pivot. A query at distance t from the pivot can be no
closer to a row of the annulus than the gap between t and the annulus (triangle inequality). The search first looks
into the query's own annulus, which gives a score it has to beat (none where that block has at most k rows: its chunk then
meets all blocks); then all annuli that can still hold a better row for some query of a chunk are joined at once, and the
score to beat is not raised in between. Nothing is estimated:
a block is left out only if its bound proves it useless.

Scores are inner products of integers, floor(``SCALE`` * x). A larger inner product is a smaller distance once rows are lifted
by one coordinate, sqrt(M^2 - |x|^2), and queries by 0: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Bounds carry a slack for
rounding. Pivots come from a bounded sample (``SAMPLE`` rows with the smallest id hashes, farthest-first); they only
decide how well the bounds prune.

Sorting by (pivot, distance, id) deals equal vectors over blocks like any others, so a vector that makes up a third of
the table fills many blocks, not one task.

Defined results: vectors that are null, hold null or non-finite components, or have another dimension than most take no
part, neither do rows with null vec_id; zero vectors do; of repeated ids the smallest vector stands; ties go to the
smaller vec_id; an empty table gives an empty result; other columns are ignored.

Scores are exact for all finite vectors. While ``d`` times the squared largest component is below 2^53, products of doubles are
exact. Beyond, vectors are scaled by a power of two for pivots, distances and bounds, doubles with a proven error select
the pairs that can be among the k best of a block, and those few are multiplied in Python's integers. A result that does not
fit a long raises; so do components that overflow a double when scaled by ``SCALE``.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.llm import vectors
from receivables.llm.common import written

K = 10
SCALE = 1024
SAMPLE = 4000
PIVOTS = 64
INDEX_BLOCK, QUERY_BLOCK = 1024, 128
SLACK = 1e-6


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE)


def rounding(d: int) -> float:
    """A bound of the relative error of sums of ``d`` products of doubles."""
    return (d + 8) * 2.0**-51


def lift(x: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(square - (x**2).sum(axis=1), 0))[:, None]])


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of the sample, each the farthest from the ones before it."""
    if not len(sample):
        return sample
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def keyed(rows: DataFrame, pivots: np.ndarray, square: float, d: int, shrink: float = 1.0) -> DataFrame:
    """Rows with their pivot and distance, as integers' vectors."""

    def key(batches):
        for batch in batches:
            x = integers(vectors.matrix(batch.column("vector"), d))
            gap = distances(lift(x * shrink, square), pivots)
            nearest = gap.argmin(axis=1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), values, pa.array(nearest.astype(np.int32)), pa.array(gap[np.arange(len(x)), nearest])], ["vec_id", "vector", "pivot", "distance"]
            )

    return rows.select("vec_id", "vector").mapInArrow(key, "vec_id long, vector array<double>, pivot int, distance double")


def annuli(rows: DataFrame, d: int, size: int) -> DataFrame:
    """The index: written blocks (block, pivot, least, most, ids, vectors, wanted) in the order of pivot and distance."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            pivot, gap = batch.column("pivot").to_numpy(zero_copy_only=False), batch.column("distance").to_numpy(zero_copy_only=False)
            ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), vectors.matrix(batch.column("vector"), d)
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False).astype(np.uint8)
            cuts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]])) if len(pivot) else []
            for a, b in zip(cuts, [*cuts[1:], len(pivot)], strict=True):
                for lo in range(a, b, size):
                    hi = min(lo + size, b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), pa.array([int(pivot[lo])], pa.int32()), pa.array([float(gap[lo:hi].min())]), pa.array([float(gap[lo:hi].max())]), pa.array([ids[lo:hi].tobytes()], pa.binary()), pa.array([x[lo:hi].tobytes()], pa.binary()), pa.array([wanted[lo:hi].tobytes()], pa.binary())],
                        ["block", "pivot", "least", "most", "ids", "vectors", "wanted"],
                    )
                    number += 1

    dealt = rows.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return written(dealt.mapInArrow(pack, "block long, pivot int, least double, most double, ids binary, vectors binary, wanted binary"), "annuli")


def _noise(square: float, q2: np.ndarray, d: int) -> np.ndarray:
    """How far rounding can put a computed distance from the true one: distances come from squares of this size."""
    return np.sqrt(8 * rounding(d) * (square + q2))


def _upper(q2: np.ndarray, square: float, gap: np.ndarray, least: float, most: float, d: int) -> np.ndarray:
    """The largest inner product that a row of the annulus can have with each query."""
    apart = np.maximum(np.maximum(gap - most, least - gap) - 2 * _noise(square, q2, d), 0)
    apart = np.maximum(apart * (1 - SLACK), 0)
    return (q2 + square - apart**2) / 2 * (1 + SLACK) + rounding(d) * (q2 + square)


def exact_best(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, beat: np.ndarray, shrink: float, k: int):
    """Query and row numbers and exact integer scores of the k best rows per query (more on near ties), where doubles are
    not exact: only pairs whose computed score, with its error, can be among them are multiplied as integers."""
    qs, xs = q * shrink, x * shrink
    near = qs @ xs.T
    error = rounding(q.shape[1]) * np.sqrt((qs**2).sum(axis=1))[:, None] * np.sqrt((xs**2).sum(axis=1))[None, :] + 1e-290
    other = qids[:, None] != ids[None, :]
    sure = np.where(other, near - error, -np.inf)
    floor = beat if x.shape[0] <= k else np.maximum(beat, np.partition(sure, x.shape[0] - k, axis=1)[:, x.shape[0] - k])
    a, b = np.nonzero(other & (near + error >= floor[:, None]))
    big = [[int(v) for v in row] for row in q], {j: [int(v) for v in x[j]] for j in np.unique(b).tolist()}
    score = [sum(u * v for u, v in zip(big[0][i], big[1][j], strict=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return a, b, score


def search(pairs: DataFrame, pivots: np.ndarray, square: float, d: int, k: int, shrink: float = 1.0) -> DataFrame:
    """(query_id, vec_id, score) from rows of a block next to a chunk of queries with the scores they have to beat; only
    rows that reach them, the k best per block."""

    def scan_exactly(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, d)
                qids, q = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["query_vectors"]).reshape(-1, d)
                beat, scaled = np.frombuffer(row["beat"]), q * shrink
                gap = distances(lift(scaled, 0.0), pivots[row["pivot"] : row["pivot"] + 1])[:, 0]
                on = np.flatnonzero(_upper((scaled**2).sum(axis=1), square, gap, row["least"], row["most"], d) >= beat)
                if not len(on):
                    continue
                a, b, score = exact_best(q[on], qids[on], x, ids, beat[on], shrink, k)
                if any(abs(v) >= 10**38 for v in score):
                    raise OverflowError("a score does not fit a long; scale the vectors down")
                numbers = pa.array([Decimal(v) for v in score], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(qids[on][a]), pa.array(ids[b]), numbers], ["query_id", "vec_id", "score"])

    if shrink != 1.0:
        return pairs.mapInArrow(scan_exactly, "query_id long, vec_id long, score decimal(38,0)")

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, d)
                qids, q = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["query_vectors"]).reshape(-1, d)
                beat = np.frombuffer(row["beat"])
                gap = distances(lift(q, 0.0), pivots[row["pivot"] : row["pivot"] + 1])[:, 0]
                on = np.flatnonzero(_upper((q**2).sum(axis=1), square, gap, row["least"], row["most"], d) >= beat)
                if not len(on):
                    continue
                score = q[on] @ x.T  # sums of integers below 2^53: exact in any order
                a, b = np.nonzero((score >= beat[on][:, None]) & (qids[on][:, None] != ids[None, :]))
                top = vectors.best(a, score[a, b], ids[b], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[on][a[top]]), pa.array(ids[b[top]]), pa.array(score[a[top], b[top]].astype(np.int64))], ["query_id", "vec_id", "score"]
                )

    return pairs.mapInArrow(scan, "query_id long, vec_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chunks(queries: DataFrame, pivots: np.ndarray, square: float, d: int, size: int, shrink: float = 1.0) -> DataFrame:
    """Written chunks of queries that lie close to each other (by pivot and distance): chunk, ids, vectors, the scores to
    beat, and for every pivot the reach of the chunk's queries around it."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), vectors.matrix(batch.column("vector"), d)
            beat = batch.column("beat").to_numpy(zero_copy_only=False)
            for lo in range(0, len(ids), size):
                q, b = x[lo : lo + size], beat[lo : lo + size]
                scaled = q * shrink
                gap = distances(lift(scaled, 0.0), pivots)
                # Rows that may still score at least b lie within this distance of the query.
                q2 = (scaled**2).sum(axis=1)
                reach = (np.sqrt(np.maximum(q2 + square - 2 * b, 0)) * (1 + SLACK) + 2 * _noise(square, q2, d))[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([ids[lo : lo + size].tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([(gap - reach).min(axis=0).tolist()]), pa.array([(gap + reach).max(axis=0).tolist()])],
                    ["chunk", "query_ids", "query_vectors", "beat", "low", "high"],
                )
                number += 1

    dealt = queries.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    schema = "chunk long, query_ids binary, query_vectors binary, beat binary, low array<double>, high array<double>"
    return written(dealt.select("vec_id", "vector", "beat").mapInArrow(pack, schema), "query-chunks")


def meet(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks next to the chunks whose reach touches their annulus; found on the small columns, then joined."""
    places = asked.select("chunk", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "r")).select("chunk", "pivot", "r.low", "r.high")
    rings = index.select("block", "pivot", "least", "most")
    near = rings.join(places, (rings["pivot"] == places["pivot"]) & (F.col("most") >= F.col("low")) & (F.col("least") <= F.col("high")))
    near = near.select("block", "chunk")
    return near.join(index.drop("wanted"), "block").join(asked.drop("low", "high"), "chunk")


def exact_top(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest integer inner products of every query."""
    spark = embeddings.sparkSession
    rows = written(vectors.valid(embeddings, allow_zero=True), "vectors")
    d = vectors.dimension(rows)
    rows = rows.where(F.size("vector") == d)
    total, largest = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top_component = largest * SCALE + 1
    if not np.isfinite(top_component):
        raise OverflowError(f"components over {np.finfo(np.float64).max / SCALE:.3g} cannot be scaled")
    shrink = 1.0 if top_component < np.sqrt(2.0**53 / d) else 2.0 ** -int(np.ceil(np.log2(top_component)))
    whole = lambda x: F.when(F.abs(x * SCALE) < 2.0**53, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE) * shrink
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + whole(x) * whole(x))
    square = float(rows.agg(F.max(size)).first()[0])
    pivots = farthest_first(lift(integers(vectors.sample(rows, SAMPLE)) * shrink, square), PIVOTS)
    placed = written(keyed(rows, pivots, square, d, shrink).withColumn("wanted", is_query(F.col("vec_id"))), "keyed")
    index = annuli(placed, d, INDEX_BLOCK)
    queries = placed.where("wanted")

    # First the annulus around each query's own place: its k-th score there is one that the answer has to reach.
    beats = starting_scores(index, d, k, shrink)
    lowest = -float(np.finfo(np.float64).max) / 4
    ready = queries.join(beats, "vec_id", "left").withColumn("beat", F.coalesce("beat", F.lit(lowest)))
    asked = chunks(ready, pivots, square, d, QUERY_BLOCK, shrink)
    best = top(search(meet(index, asked), pivots, square, d, k, shrink), k)
    return best.withColumn("score", F.col("score").cast("long"))  # raises where a long does not hold it


def starting_scores(index: DataFrame, d: int, k: int, shrink: float = 1.0) -> DataFrame:
    """(vec_id, beat): the k-th score of every query within the block that holds the query itself (if that has k others); of
    scaled vectors, less the error it may have."""

    def within(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, d)
                on = np.flatnonzero(np.frombuffer(row["wanted"], np.uint8))
                if len(ids) <= k or not len(on):
                    continue
                if shrink != 1.0:
                    x = x * shrink
                score = x[on] @ x.T
                if shrink != 1.0:
                    norm = np.sqrt((x**2).sum(axis=1))
                    score -= 2 * rounding(d) * norm[on][:, None] * norm[None, :] + 1e-290
                score[np.arange(len(on)), on] = -np.inf
                beat = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(beat)], ["vec_id", "beat"])

    return index.select("ids", "vectors", "wanted").mapInArrow(within, "vec_id long, beat double")


ORACLE = """
WITH numbered AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM numbered q JOIN numbered c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
