"""Near-duplicate documents by an LSH forest over MinHash signatures.

What counts as a near-duplicate is a ``Likeness``: the words of a shingle, the least similarity, and the signature that
finds such pairs. op5's contract is ``CONTRACT`` (3 words, 0.85); the corpus stage ``one_of_each`` takes ``CORPUS`` (5 words,
0.8).

Each of ``trees`` sorted orders lists the distinct shingle sets by a signature that starts with its own ``depth``
MinHash values and goes on with the others. Sets that agree on the first ``depth`` values form a region of that order;
regions are compared in full: all pairs of a region meet over all values of the signature, so a region of N distinct
sets costs about N^2 comparisons, and common prefixes beyond ``depth`` only decide ties and blocks. Two sets with similarity s share a
region of at least one order with probability 1 - (1 - s ** depth) ** trees: over 0.99999 for 0.85 with 20 orders of 5
values, and for 0.8 with 25 orders of 4 values.

The depth adapts to the region. A region that holds more sets than a block is taken deeper, to ``2 * depth`` values, and
dealt into blocks by that prefix (or by the set itself, where even the deeper region is larger than a block). Blocks
meet in pairs, each pair in a task of its own, so that no pair of a region is given up by going deeper. A block pair
compares all its pairs and gives back a spanning forest of its candidates, best agreement first, never all pairs:

1. equal sets collapse to one node first (a digest of the sorted shingle hashes);
2. candidates: within a region, signatures that agree often enough (``rough`` of 100 values, five standard deviations below the
   threshold); a forest of them per region or block pair;
3. rough components over the candidates; the full shingle sets travel once to their rough component, which is again
   cut into blocks that meet in pairs; similarity is confirmed on the full sets there, and a spanning forest of the
   true links comes back;
4. components over the true links.

Defined results: null, empty and white-space texts have no set, are linked with nothing and keep themselves; texts of
fewer words than a shingle are one shingle; repeated rows and rows with equal sets are one node, their component_id the
smallest non-null doc_id reached; a row with null ``doc_id`` takes part, is kept only where its component has no id
and gets that component's id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.llm.common import MIX_A, U64, buffers, hash_ngrams, hash_words, lower_ascii, mix, pieces_of, with_row_key, word_bounds, written
from receivables.llm.components import components

SHINGLE = 3
THRESHOLD = (85, 100)
TREES, DEPTH = 20, 5
ROUGH = 66  # of TREES * DEPTH = 100 values: 0.85 less five standard deviations
BLOCK_SETS = 512  # sets of a block
BLOCK_SHINGLES = 1_000_000  # shingles of a block of full sets
CHUNK_BYTES = 2 << 20


class Likeness(NamedTuple):
    """Which texts are near-duplicates, and the signature settings that find them."""

    shingle: int = SHINGLE  # words
    threshold: tuple[int, int] = THRESHOLD
    trees: int = TREES
    depth: int = DEPTH
    rough: int = ROUGH


CONTRACT = Likeness()
CORPUS = Likeness(shingle=5, threshold=(80, 100), trees=25, depth=4, rough=60)  # 60 of 100: 0.8 less five standard deviations


@cache
def seeds(values: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20_011).integers(0, 2**32, (2, values), dtype=np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    data, offsets = buffers(texts)
    data = lower_ascii(data)
    starts, ends, docs = word_bounds(data, offsets)
    words = hash_words(data, starts, ends)
    grams = hash_ngrams(words, shingle)
    for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True):
        n = b - a
        if n >= shingle:
            yield np.unique(grams[a : b - shingle + 1])
        elif n:  # the whole sequence as one shingle, told apart from longer ones
            placed = mix(words[a:b] + U64(7) * np.arange(1, n + 1, dtype=np.uint64))
            yield mix(np.bitwise_xor.reduce(placed, keepdims=True) ^ (np.array([n], dtype=np.uint64) * MIX_A))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, values: int = TREES * DEPTH) -> np.ndarray:
    """As many MinHash values."""
    mul, add = seeds(values)
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(values, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256, None] * mul[None, :]
        part += add[None, :]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, like: Likeness = CONTRACT) -> DataFrame:
    """doc_id, row_key, node (hash of the set; null without one), n_shingles and the signature."""

    def sign(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", CHUNK_BYTES):
                nodes, sizes, signs = [], [], []
                for s in shingle_sets(batch.column("text")[lo:hi], like.shingle):
                    sizes.append(len(s))
                    nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                    signs.append(signature(s, like.trees * like.depth).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], batch.column("row_key")[lo:hi], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                    ["doc_id", "row_key", "node", "n_shingles", "signature"],
                )

    return docs.mapInArrow(sign, "doc_id long, row_key long, node long, n_shingles long, signature binary")


def regions(nodes: DataFrame, like: Likeness = CONTRACT) -> DataFrame:
    """(region, deep, tree, node) for every order and node: hashes of the order's number and its first ``depth`` values, and
    of twice as many."""

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, like.trees, like.depth)
            h = np.arange(like.trees, dtype=np.uint64)[None, :] * MIX_A + U64(1)
            for k in range(like.depth):
                h = mix(h ^ signs[:, :, k].astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
            deep = h.copy()
            for k in range(like.depth):
                deep = mix(deep ^ np.roll(signs, -1, axis=1)[:, :, k].astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), like.trees)
            tree = np.tile(np.arange(like.trees, dtype=np.int32), len(signs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.ravel().view(np.int64)), pa.array(deep.ravel().view(np.int64)), pa.array(tree), pa.array(node)], ["region", "deep", "tree", "node"]
            )

    return nodes.select("node", "signature").mapInArrow(place, "region long, deep long, tree int, node long")


def block_pairs(df: DataFrame, block: str, blocks: str) -> DataFrame:
    """Each row once for every pair (``unit_a``, ``unit_b``) of blocks that its own block is part of."""
    others = F.sequence(F.lit(0), F.col(blocks) - 1)
    first = F.least(F.col(block), F.col("_other")).alias("unit_a")
    second = F.greatest(F.col(block), F.col("_other")).alias("unit_b")
    return df.withColumn("_other", F.explode(others)).select("*", first, second).drop("_other")


def forest(links: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of links between 0..n-1, the first ones preferred."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signature values every row of ``a`` shares with every row of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys; a unit is bounded by two blocks."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last:
                if rows:
                    yield last, rows
                last, rows = key, []
            rows.append(row)
    if rows:
        yield last, rows


def candidate_links(signed: DataFrame, rough: int = ROUGH, block_sets: int = BLOCK_SETS, *, like: Likeness = CONTRACT) -> DataFrame:
    """Forests of candidates (u, v), over all regions. ``signed``: distinct (node, signature)."""
    member = written(regions(signed, like), "regions")
    sizes = member.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block_sets).cast("int")
    met = member.join(sizes, "region").withColumn("blocks", blocks)
    # Regions beyond a block go deeper; where the deeper region is still too large, each set is dealt out for itself.
    deeper = met.where("blocks > 1").groupBy("deep").agg(F.count(F.lit(1)).alias("_sets"))
    crowded = written(deeper.where(F.col("_sets") > block_sets).select("deep", F.lit(True).alias("_crowded")), "crowded-regions")
    key = F.when(F.col("_crowded"), F.xxhash64("node")).otherwise(F.col("deep"))
    met = met.join(crowded, "deep", "left").withColumn("block", F.pmod(key, F.col("blocks")).cast("int")).join(signed, "node")
    dealt = block_pairs(met.select("region", "tree", "node", "signature", "blocks", "block"), "block", "blocks")
    dealt = dealt.repartition("region", "unit_a", "unit_b").sortWithinPartitions("region", "unit_a", "unit_b")

    def link(batches):
        us, vs = [], []
        for (_, first, second), rows in units(batches, ("region", "unit_a", "unit_b")):
            signs = np.frombuffer(b"".join(r["signature"] for r in rows), dtype=np.uint32).reshape(len(rows), -1)
            if len(rows) == 2:
                pairs = [(0, 1)] if (first == second or rows[0]["block"] != rows[1]["block"]) and int((signs[0] == signs[1]).sum()) >= rough else []
            else:
                # The order's own sort puts longest common prefixes side by side; it breaks ties of the forest.
                tree = rows[0]["tree"] * like.depth
                order = np.lexsort(np.roll(signs, -tree, axis=1)[:, ::-1].T)
                rows, signs = [rows[k] for k in order], signs[order]
                agree = agreements(signs, signs)
                agree[np.tril_indices(len(rows))] = -1
                if first != second:
                    side = np.array([r["block"] for r in rows])
                    agree[side[:, None] == side[None, :]] = -1
                i, j = np.nonzero(agree >= rough)
                best = np.lexsort((j - i, -agree[i, j]))
                pairs = forest(list(zip(i[best].tolist(), j[best].tolist(), strict=True)), len(rows))
            us += [rows[a]["node"] for a, _ in pairs]
            vs += [rows[b]["node"] for _, b in pairs]
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(link, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership matrices over the shingles that two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    on = shared[column]
    owner, column = owner[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    total = int(shared.sum())
    for lo in range(0, total, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((n, min(4096, total - lo)), dtype=np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def true_links(rough: DataFrame, docs: DataFrame, first_rows: DataFrame, like: Likeness = CONTRACT) -> DataFrame:
    """Forests of confirmed links (u, v) inside the rough components (node, component). ``first_rows`` names one row of
    the documents for every node."""
    sized = rough.join(first_rows, "node")
    total = sized.groupBy("component").agg(F.sum("n_shingles").alias("shingles"), F.count(F.lit(1)).alias("sets"))
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("sets") / BLOCK_SETS)).cast("int")
    member = sized.join(total.withColumn("blocks", blocks), "component").select(
        "node", "component", "blocks", F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")
    )
    met = docs.join(member, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def sets(batches):
        for batch in batches:
            for lo, hi in pieces_of(batch, "text", CHUNK_BYTES):
                found = [s.tobytes() for s in shingle_sets(batch.column("text")[lo:hi], like.shingle)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("node", "component", "blocks")), pa.array(found, pa.binary())], ["node", "component", "blocks", "shingles"])

    full = met.select("node", "component", "blocks", "text").mapInArrow(sets, "node long, component long, blocks int, shingles binary")
    full = full.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = block_pairs(full, "block", "blocks")
    dealt = dealt.repartition("component", "unit_a", "unit_b").sortWithinPartitions("component", "unit_a", "unit_b")
    part, whole = like.threshold

    def confirm(batches):
        for (_, first, second), rows in units(batches, ("component", "unit_a", "unit_b")):
            rows = list({r["node"]: r for r in rows}.values())  # a row that repeats stands here once
            if len(rows) < 2:
                continue
            sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
            size = np.array([len(s) for s in sets])
            if len(rows) == 2:
                same = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
            else:
                same = intersections(sets)
            linked = np.triu(same.astype(np.int64) * (whole + part) >= part * (size[:, None] + size[None, :]), 1)
            if first != second:
                side = np.array([r["block"] for r in rows])
                linked &= side[:, None] != side[None, :]
            i, j = np.nonzero(linked)
            pairs = forest(list(zip(i.tolist(), j.tolist(), strict=True)), len(rows))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[a]["node"] for a, _ in pairs], pa.int64()), pa.array([rows[b]["node"] for _, b in pairs], pa.int64())], ["u", "v"]
                )

    return dealt.mapInArrow(confirm, "u long, v long")


def near_duplicates(docs: DataFrame, like: Likeness = CONTRACT) -> DataFrame:
    """doc_id, row_key, n_shingles, component (its own name, null without a set), component_id and kept of every row of
    ``docs`` (from ``with_row_key``)."""
    signed = written(signatures(docs, like), "signatures")
    has = signed.where(F.col("node").isNotNull())
    # One row of the documents stands for each set; any of them has the same shingles.
    first_rows = has.groupBy("node").agg(F.min(F.struct("doc_id", "row_key", "n_shingles")).alias("r")).select("node", "r.*")
    smallest = has.groupBy("node").agg(F.min("doc_id").alias("smallest"))  # the smallest id that is not null
    distinct = has.select("node", "signature").dropDuplicates(["node"])
    rough = written(components(candidate_links(distinct, like.rough, like=like)), "rough-components")
    links = written(true_links(rough, docs, first_rows, like), "links")
    found = components(links)
    named = smallest.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    label = named.join(lowest, "component").select("node", "component", "component_id")
    out = signed.drop("signature").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", "component", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return near_duplicates(keyed).drop("row_key", "component")


def one_of_each(docs: DataFrame, like: Likeness = CORPUS) -> DataFrame:
    """``docs`` with one row of every component (the one with the smallest id), and all rows without words. Rows with equal
    id and text are one document."""
    keyed = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    judged = written(near_duplicates(keyed, like).where("kept").select("doc_id", "row_key", "component"), "kept")
    first = judged.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select("r.*")
    stay = first.unionByName(judged.where(F.col("component").isNull()).select("doc_id", "row_key").distinct())
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__stays"))
    marked = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    met = marked.join(stay, (F.col("__key") == F.col("__stays")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return met.dropDuplicates(["__key", "doc_id"]).select(*docs.columns)
