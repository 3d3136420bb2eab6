"""Connected components of an edge table by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import written

TASK_EDGES = 1 << 18  # edges that one task may finish (4 MB)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) over the given edges, by pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        before = parent.copy()
        low = np.minimum(parent[u], parent[v])
        np.minimum.at(parent, parent[u], low)
        np.minimum.at(parent, parent[v], low)
        while True:
            nxt = parent[parent]
            if np.array_equal(nxt, parent):
                break
            parent = nxt
        if np.array_equal(before, parent):
            return nodes, nodes[parent]


def _contract(batches):
    """Replace the edges of a batch by stars around their components' smallest nodes."""
    for batch in batches:
        if batch.num_rows:
            nodes, root = roots(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            own = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], ["u", "v"])


def _contract_whole(batches):
    """As ``_contract`` over all batches of a partition together."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        yield from _contract([pa.Table.from_batches(parts).combine_chunks().to_batches()[0]])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (columns ``u`` and ``v``, long); component is its smallest node.

    Each round is two aggregates and two joins on the node. No neighbourhood is ever collected: a node with very many
    edges costs one partial minimum per task, and the join is split by AQE where it is skewed. Whenever at most
    ``TASK_EDGES`` edges are left, one task of that bounded size finishes them.
    """
    schema = "u long, v long"
    now = written(edges.select("u", "v").where("u <> v").mapInArrow(_contract, schema).distinct(), "edges")
    state = None
    for _ in range(rounds):
        if now.count() <= TASK_EDGES:
            now = written(now.repartition(1).mapInArrow(_contract_whole, schema), "edges")
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))  # larger neighbours -> minimum
        large = large.where("u <> v").distinct()
        # Small star: every edge now points from the larger node u to a smaller v.
        low2 = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        now = written(small.unionByName(low2.select("u", F.col("low").alias("v"))).mapInArrow(_contract, schema).distinct(), "edges")
        # A star around each component's minimum no longer changes; the count and two sums of hashes tell.
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
