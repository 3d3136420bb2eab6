"""The rows of boosting in growth, one file per partition on the local disk of the executor that works on it.

A level reads every row, and a tree changes every margin, so the rows stay where their task runs: below Spark's own local
folders (Spark deletes these with the executor), mapped into memory, so that they take no heap and no copy through a pipe. The
file is a cache and nothing else: it follows from the stored blocks and the trees grown so far. A file counts the steps it has
taken in. A task takes in the steps that are missing; one that finds no file (its executor was lost, Spark sent it elsewhere) or
one left in the middle of a step builds it anew from the blocks and repeats all steps. A lock keeps two attempts of a task apart.
"""

from __future__ import annotations

import fcntl
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receivables.functions.stored import opened

HEAD = 64  # bytes before the first array; an array starts at a multiple of it
BROKEN = -1


@dataclass
class Block:
    """Rows in growth (``x``: feature x row): per model their margins and, in the tree that grows, the node where each stands;
    ``taken`` are the rows that this tree samples."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    draw: np.ndarray
    margin: np.ndarray
    node: np.ndarray
    taken: np.ndarray


def node_type(depth: int) -> np.dtype:
    return np.min_scalar_type(2 ** (depth + 1))


@dataclass(frozen=True)
class Part:
    """Rows of a partition: blocks ``lo`` to ``hi`` - 1 of each of some files."""

    number: int
    rows: int
    pieces: tuple[tuple[str, int, int], ...]


def dealt(packed: DataFrame, tasks: int) -> list[Part]:
    """The stored blocks in at most ``tasks`` runs that differ by about a block's rows."""
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")]
    found = sorted((r.path, r.at, r.n) for r in packed.select(*place, F.length("y").alias("n")).collect())
    total, before = sum(n for *_, n in found), 0
    runs: list[list[tuple[str, int, int]]] = [[] for _ in range(tasks)]
    for path, at, n in found:
        runs[(2 * before + n) * tasks // (2 * total)].append((path, at, n))
        before += n
    parts = []
    for blocks in filter(None, runs):
        files = {path: [at for p, at, _ in blocks if p == path] for path in dict.fromkeys(p for p, *_ in blocks)}
        parts.append(Part(len(parts), sum(n for *_, n in blocks), tuple((path, min(at), max(at) + 1) for path, at in files.items())))
    return parts


def stored_blocks(part: Part) -> Iterator[dict]:
    for path, lo, hi in part.pieces:
        store, name = opened(path)
        with store.open_input_file(name) as source:
            file, first = pq.ParquetFile(source, buffer_size=1 << 20), 0
            for group in range(file.num_row_groups):
                size = file.metadata.row_group(group).num_rows
                if first < hi and first + size > lo:
                    for k, batch in enumerate(file.iter_batches(1, [group])):
                        if lo <= first + k < hi:
                            yield batch.to_pylist()[0]
                first += size


@dataclass(frozen=True)
class Growth:
    """What the files of one training share: ``priors`` are the margins before the first tree, one per model."""

    name: str
    width: int
    priors: list[float]
    depth: int

    def path(self, part: Part) -> str:
        folders = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")
        return f"{folders[part.number % len(folders)]}/python/boosting-{self.name}/{part.number}"

    def mapped(self, path: str, rows: int, new: bool) -> tuple[np.ndarray, Block]:
        """The number of steps taken in and the rows, as arrays over the file."""
        models, at, out = len(self.priors), HEAD, []
        shapes = [((self.width, rows), np.uint8), (rows, np.int8), (rows, np.int8), (rows, np.uint64), ((models, rows), np.float64), ((models, rows), node_type(self.depth)), (rows, bool)]
        for shape, kind in shapes:
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            out.append((shape, kind, at, size))
            at += -(-size // HEAD) * HEAD
        if new:  # a full disk shows here, as an error, and not later as a fault of the mapped memory
            with open(path, "wb") as file:
                os.posix_fallocate(file.fileno(), 0, at)
        whole = np.memmap(path, np.uint8, "r+", shape=(at,)).view(np.ndarray)
        return whole[:8].view(np.int64), Block(*(whole[a : a + size].view(kind).reshape(shape) for shape, kind, a, size in out))

    def built(self, path: str, part: Part) -> tuple[np.ndarray, Block]:
        temporary = f"{path}.{os.getpid()}"
        steps, block = self.mapped(temporary, part.rows, True)
        lo = 0
        for row in stored_blocks(part):
            hi = lo + len(row["y"])
            block.x[:, lo:hi] = np.frombuffer(row["x"], np.uint8).reshape(self.width, -1)
            for name, kind in (("y", np.int8), ("fold", np.int8), ("draw", np.uint64)):
                getattr(block, name)[lo:hi] = np.frombuffer(row[name], kind)
            lo = hi
        if lo != part.rows:
            raise ValueError(f"{lo} of {part.rows} rows found in {part.pieces}")
        for margin, prior in zip(block.margin, self.priors, strict=True):
            margin[:] = prior
        os.replace(temporary, path)
        return steps, block

    @contextmanager
    def held(self, part: Part, last: int, step: Callable[[Block, int], None]) -> Iterator[Block]:
        """The rows after steps 0 to ``last``; nobody else changes them meanwhile."""
        path = self.path(part)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.lock", "a") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            steps, block = self.mapped(path, part.rows, False) if os.path.exists(path) else self.built(path, part)
            if steps[0] == BROKEN:
                steps, block = self.built(path, part)
            if steps[0] > last + 1:
                raise RuntimeError(f"rows of partition {part.number} are past step {last}: this attempt is out of date")
            for k in range(int(steps[0]), last + 1):
                steps[0] = BROKEN
                step(block, k)
                steps[0] = k + 1
            yield block

    def remove(self, part: Part) -> None:
        """The last one to go also removes the folder."""
        path = self.path(part)
        for name in (path, f"{path}.lock"):
            with suppress(FileNotFoundError):
                os.remove(name)
        with suppress(OSError):
            os.rmdir(os.path.dirname(path))
