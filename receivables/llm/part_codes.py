"""Vector code compression: codebooks per part of the vector, with LAESA pivots in place of full distance tables.

Every component becomes an integer, floor(``scale`` * x), and a vector is cut into equal consecutive parts. A part position
has its own codebook, trained by rounds of nearest-entry assignment and integer means. Assignment follows LAESA: the
distances of all parts to a few fixed pivots are computed once and written next to the integers; in each round only the
distances between pivots and entries are new. By the triangle inequality |d(part, pivot) - d(entry, pivot)|, at its largest
over the pivots, bounds d(part, entry) from below. A part visits the entries in the order of these bounds, computes exact
integer distances, and stops at the first entry whose bound exceeds the best distance found (an equal bound is still
visited: ties go to the lower index).

A round is one pass over the written table. Tasks add up the parts of each entry before anything is shuffled, so a vector
that makes up a third of the table costs no more than any other; the driver receives one number per (part, entry,
component). Sums travel in limbs of 40 bits, so they stay exact for any number of rows.

Integers stay in 64 bits while ``d * (2 * largest)^2`` is below 2^62; larger finite components are computed with Python's
integers by the same steps (the triangle bounds then use integer roots). An error beyond a long raises.

Defined results: rows whose vector is null, empty, holds null or non-finite components, or has another dimension than most
rows, are dropped. Codebooks start at the smallest vec_ids (null ids last, then by vector); with fewer rows than entries the
codebook is smaller. Repeated rows and repeated or null vec_ids are coded each for themselves. A dimension that ``parts``
does not divide raises. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions.joins import lookup_join
from receivables.llm import vectors
from receivables.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 16, 64, 2, 256, 4
CHUNK = 4096  # parts that are compared with a codebook at a time
LIMB = 40


@dataclass(frozen=True)
class Numbers:
    """How integers, distances and bounds are computed: ``wide`` stands for components that 64 bits cannot hold."""

    wide: bool
    scale: int
    d: int
    parts: int
    small: str  # dtype of stored integers
    square: str  # dtype of stored squared distances

    @property
    def width(self) -> int:
        return self.d // self.parts

    def integers(self, x: np.ndarray) -> np.ndarray:
        if not self.wide:
            return np.floor(x * self.scale).astype(np.int64)
        near = [math.floor(v * self.scale) if abs(v) < 2.0**900 else int(v) * self.scale for v in x.ravel().tolist()]
        return np.array([*near, None], dtype=object)[:-1].reshape(x.shape)

    def squares(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((x - y) ** 2).sum(axis=-1)

    def roots(self, square: np.ndarray) -> np.ndarray:
        if not self.wide:
            return np.sqrt(square.astype(np.float64))
        return np.array([*(math.isqrt(s) for s in square.ravel().tolist()), None], dtype=object)[:-1].reshape(square.shape)

    def lower(self, gaps: np.ndarray, entry_gaps: np.ndarray) -> np.ndarray:
        """n x entries lower bounds of the distances, from distances to the pivots (n x pivots, entries x pivots)."""
        best = None
        for p in range(gaps.shape[1]):
            a, b = gaps[:, p, None], entry_gaps[None, :, p]
            # Roots are rounded: floats by parts in 2^52, integer roots by less than 1 each.
            bound = abs(a - b) - 2 if self.wide else np.abs(a - b) - (a + b) * 1e-14
            best = bound if best is None else np.maximum(best, bound)
        return np.maximum(best, 0)

    def dump(self, x: np.ndarray, dtype: str) -> list[bytes]:
        """One value per row of ``x``."""
        if self.wide:
            return [pickle.dumps(row.tolist()) for row in x]
        x = np.ascontiguousarray(x.astype(dtype))
        raw, step = x.tobytes(), x.nbytes // max(1, len(x))
        return [raw[i : i + step] for i in range(0, len(raw), step)]

    def load(self, column: pa.Array, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
        if self.wide:
            flat = [v for row in column.to_pylist() for v in np.array([*pickle.loads(row), None], dtype=object)[:-1].ravel()]
            return np.array([*flat, None], dtype=object)[:-1].reshape(-1, *shape)
        return np.frombuffer(b"".join(column.to_pylist()), dtype).astype(np.int64).reshape(-1, *shape)


def smallest_dtype(largest: int) -> str:
    return next(t for t in ("int16", "int32", "int64") if largest <= np.iinfo(t).max)


def nearest(numbers: Numbers, x: np.ndarray, gaps: np.ndarray, entries: np.ndarray, entry_gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of every row of ``x`` (ties: lowest index), its squared distance, and how many distances were
    computed for that."""
    n, kind = len(x), object if numbers.wide else np.int64
    arg, best = np.full(n, -1), np.zeros(n, kind)
    lower = numbers.lower(gaps, entry_gaps)
    seen, rows, computed = np.zeros(lower.shape, bool), np.arange(n), 0
    far = math.inf
    for _ in range(len(entries)):
        if not len(rows):
            break
        e = lower.argmin(axis=1)
        bound = lower[np.arange(len(rows)), e]
        square = bound * bound if numbers.wide else bound * bound * (1 - 1e-12)
        go = np.array((arg[rows] < 0) | (square <= best[rows]), dtype=bool) & ~seen[np.arange(len(rows)), e]
        if not go.all():
            rows, e, lower, seen = rows[go], e[go], lower[go], seen[go]
        computed += len(rows)
        found = numbers.squares(x[rows], entries[e])
        better = np.array((arg[rows] < 0) | (found < best[rows]) | ((found == best[rows]) & (e < arg[rows])), dtype=bool)
        arg[rows[better]], best[rows[better]] = e[better], found[better]
        at = np.arange(len(rows))
        lower[at, e], seen[at, e] = far, True
    return arg, best, computed


def spread_pivots(numbers: Numbers, seeds: np.ndarray, n: int) -> np.ndarray:
    """parts x pivots x width: of each part position's seeds, those farthest from the ones picked before."""
    out = []
    for p in range(numbers.parts):
        mine = seeds[:, p]
        picked = [0]
        gap = numbers.squares(mine, mine[0])
        while len(picked) < n:
            picked.append(int(np.argmax(gap)))
            gap = np.minimum(gap, numbers.squares(mine, mine[picked[-1]]))
        out.append(mine[picked])
    return np.stack(out)


def place(rows: DataFrame, numbers: Numbers, pivots: np.ndarray) -> DataFrame:
    """Written (vec_id, label, ints, gaps): the integers and every part's squared distances to the fixed pivots."""

    def run(batches):
        for batch in batches:
            x = numbers.integers(vectors.matrix(batch.column("vector"), numbers.d)).reshape(-1, numbers.parts, numbers.width)
            gaps = numbers.squares(x[:, :, None, :], pivots[None])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(numbers.dump(x.reshape(len(x), -1), numbers.small), pa.binary()), pa.array(numbers.dump(gaps.reshape(len(x), -1), numbers.square), pa.binary())],
                ["vec_id", "label", "ints", "gaps"],
            )

    return written(rows.mapInArrow(run, "vec_id long, label string, ints binary, gaps binary"), "parts")


def assigned(numbers: Numbers, batch: pa.RecordBatch, pivots: np.ndarray, books: np.ndarray):
    """Per part position of a batch: position, rows, entry of each row, squared distance to it."""
    x = numbers.load(batch.column("ints"), numbers.small, (numbers.parts, numbers.width))
    gaps = numbers.roots(numbers.load(batch.column("gaps"), numbers.square, (numbers.parts, pivots.shape[1])))
    for p in range(numbers.parts):
        entry_gaps = numbers.roots(numbers.squares(books[p][:, None, :], pivots[p][None]))
        for lo in range(0, len(x), CHUNK):
            part = x[lo : lo + CHUNK, p]
            arg, best, _ = nearest(numbers, part, gaps[lo : lo + CHUNK, p], books[p], entry_gaps)
            yield p, lo, part, arg, best


def limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def next_books(placed: DataFrame, numbers: Numbers, pivots: np.ndarray, books: np.ndarray) -> np.ndarray:
    """One round: floor means of the parts assigned to each entry; entries without parts stay."""
    entries = books.shape[1]

    def add_up(batches):
        kind = object if numbers.wide else np.int64
        sums, counts = np.zeros((numbers.parts, entries, numbers.width), kind), np.zeros((numbers.parts, entries), np.int64)
        for batch in batches:
            for p, _, part, arg, _ in assigned(numbers, batch, pivots, books):
                np.add.at(sums[p], arg, part)
                counts[p] += np.bincount(arg, minlength=entries)
        out = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts), strict=True)]
        out += [(p, e, c, j, v) for p, e, _, _, _ in list(out) for c in range(numbers.width) for j, v in enumerate(limbs(int(sums[p, e, c])))]
        columns = list(zip(*out, strict=True)) or [()] * 5
        names, types = ["part", "entry", "place", "limb", "value"], [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(map(int, c), t) for c, t in zip(columns, types, strict=True)], names)

    sums = placed.select("ints", "gaps").mapInArrow(add_up, "part int, entry int, place int, limb int, value long")
    totals: dict[tuple[int, int, int], int] = {}
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():  # bounded by the codebooks
        at = (r.part, r.entry, r.place)
        totals[at] = totals.get(at, 0) + (r.value << (LIMB * r.limb))
    out = books.copy()
    for (p, e, c), n in totals.items():
        if c < 0:
            out[p, e] = [totals.get((p, e, i), 0) // n for i in range(numbers.width)]
    return out


def coded(placed: DataFrame, numbers: Numbers, pivots: np.ndarray, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every row."""

    def run(batches):
        for batch in batches:
            code = np.zeros((batch.num_rows, numbers.parts), np.uint8)
            error = np.zeros(batch.num_rows, object if numbers.wide else np.int64)
            for p, lo, _, arg, best in assigned(numbers, batch, pivots, books):
                code[lo : lo + len(arg), p] = arg
                error[lo : lo + len(arg)] += best
            if numbers.wide and len(error) and max(error) >= 2**63:
                raise OverflowError("an error does not fit a long; scale the vectors down")
            hexes = code.tobytes().hex()
            step = 2 * numbers.parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([hexes[i : i + step] for i in range(0, len(hexes), step)], pa.string()), pa.array(error.astype(np.int64))],
                ["vec_id", "label", "code", "error"],
            )

    return placed.mapInArrow(run, "vec_id long, label string, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row; see the module."""
    if not 0 < entries <= 256:
        raise ValueError("a code holds one byte a part: from 1 to 256 entries")
    spark = embeddings.sparkSession
    value = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Equal labels add up, nulls among them: a marked string is a key that is never null.
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), key.alias("label"), value.alias("vector")).where((F.size("vector") > 0) & finite)
    largest = F.array_max(F.transform("vector", F.abs))
    shapes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("top"))
    most = shapes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    d = most["d"]
    if d % parts:
        raise ValueError(f"{parts} equal parts cannot be cut from {d} components")
    rows = rows.where(F.size("vector") == d)
    top = (int(most["top"]) + 1) * scale + 1
    wide = d * (2 * top) ** 2 >= 2**62
    numbers = Numbers(wide, scale, d, parts, "" if wide else smallest_dtype(top), "" if wide else smallest_dtype((d // parts) * (2 * top) ** 2))

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    seeds = numbers.integers(np.array([r["vector"] for r in first], dtype=np.float64)).reshape(-1, parts, d // parts)
    pivots = spread_pivots(numbers, seeds, PIVOTS)
    placed = place(rows, numbers, pivots)
    books = np.ascontiguousarray(seeds.transpose(1, 0, 2))
    for _ in range(rounds):
        books = next_books(placed, numbers, pivots, books)

    final = written(coded(placed, numbers, pivots, books), "codes")
    sums = final.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count(F.lit(1)).alias("__n"))
    joined = lookup_join(final, sums.drop("__n"), "label", "left", spread="vec_id", key_counts=sums.select("label", "__n"))
    return joined.select("vec_id", "code", "error", F.col("label_error").cast("long").alias("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds written out in SQL, every distance computed (DuckDB)."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, k AS part, x[1 + k * (len(x) // {parts}) : (k + 1) * (len(x) // {parts})] AS y FROM v, range({parts}) t(k)),
b0 AS (SELECT part, r - 1 AS entry, y FROM p WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, part, y, entry, square FROM (
    SELECT p.r, p.part, p.y, b.entry, list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS square
    FROM p JOIN b{i} b ON p.part = b.part)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY square, entry) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT part, entry, c, (s - ((s % n) + n) % n) // n AS mean FROM (
    SELECT part, entry, c, CAST(sum(y[c]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, (SELECT max(len(y)) + 1 FROM p)) t(c) GROUP BY part, entry, c)),
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.y, b.y) AS y
  FROM b{i} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY c) AS y FROM m{i} GROUP BY part, entry) n ON b.part = n.part AND b.entry = n.entry)""")
    return f"""
WITH {",".join(steps)},
e AS (
  SELECT v.vec_id, v.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.square) AS BIGINT) AS error
  FROM a{rounds} a JOIN v ON a.r = v.r GROUP BY v.r, v.vec_id, v.label),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
"""
