"""Vectors in blocks: valid rows of an embeddings table, packed into written blocks that tasks can search with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import written


def valid(embeddings: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id, vector) of the rows that take part: finite components only, one vector per vec_id (the smallest, where
    rows repeat), of the table's most frequent dimension."""
    big = float("inf")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    if not allow_zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("vector"))


def dimension(rows: DataFrame) -> int:
    """The most frequent dimension (ties: the larger); 0 for an empty table."""
    found = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """The ``n`` vectors with the smallest hashes of their ids."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vector").collect()
    return np.array([r["vector"] for r in got], dtype=np.float64)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """n x d components of a list column."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), d)


def blocks(rows: DataFrame, d: int, size: int, name: str, more: Callable[[np.ndarray], dict[str, bytes]], columns: str = "") -> DataFrame:
    """Written blocks of up to ``size`` rows: block (distinct number), n, ids and vectors (binary), and what ``more``
    makes of a block's vectors (columns given in ``columns``)."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("vector"), d)
            for lo in range(0, len(ids), size):
                part = x[lo : lo + size]
                own = more(part)
                arrays = [pa.array([number], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([ids[lo : lo + size].tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([v]) for v in own.values())], ["block", "n", "ids", "vectors", *own])
                number += 1

    schema = "block long, n int, ids binary, vectors binary" + (f", {columns}" if columns else "")
    return written(rows.select("vec_id", "vector").mapInArrow(pack, schema), name)


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores of every query, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]
