"""Gradient-boosted trees, several models at once: all cross-validation folds and the final fit grow in the same jobs.

The training rows are binned once by quantiles (one byte a feature) and written as blocks. Model m < ``folds`` leaves fold m
out, model ``folds`` takes all rows. A tree grows level by level; a level is one job over the blocks that adds up, for every
(model, node, feature, bin), the rows, residuals and curvatures, so 100 trees of depth 5 take 500 jobs for all models
together. Of two siblings only the smaller is counted, the other is the parent less it. Splits are found on these sums
(their size depends on bins, nodes and features, never on rows): Friedman's improvement, least rows a leaf and a node, ties to the
first feature and then the lowest cut. Leaves take one Newton step of the logistic loss.

Residuals and curvatures are added up as integers (parts in 2^30 and 2^20), so sums, and with them all trees, do not depend
on the order or the number of partitions. The rows a tree samples are drawn by a hash of their key and the tree's number.

The blocks are dealt over as many partitions as there are cores. A partition's rows, their margins and the nodes where they
stand are in a file on the local disk of its executor (``boosting_rows``); a level's job carries the trees so far and returns
sums, no rows. A lost file is built anew from the stored blocks and these trees. The jobs run over a small cached RDD that tells
Spark where each partition's file is: planning a DataFrame for each level costs more than its work on small tables.

A table of at most ``BROADCAST_ROWS`` rows (a few MB once binned; the rows are counted first) is broadcast instead, and each model
grows in a task of its own by the same code. Since sums are exact, both ways give the same trees bit by bit.

A fitted model is a plain expression: ``margin`` walks all trees with array functions on the JVM, so scoring needs no Python.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from receivables.functions.stored import Run, written
from receivables.operators.boosting_rows import Block, Growth, Part, dealt, node_type

MOST_DIRECT = 32  # partial sums of more partitions are added up on executors first
TASK_ROWS = 1 << 15
BROADCAST_ROWS = 1 << 18
BUNDLE_CELLS = 1 << 12  # combined bins of features that are counted together; below 2^16
BLOCK_ROWS = 1 << 16
CHUNK_ROWS = 1 << 17  # rows that are looked at together: their arrays stay near the processor
DEEP_CHUNKS = 2  # times as many below the root
PACKED_ROWS = (1 << 17) - 1  # more rows would overflow the packed sums
G_UNIT, H_UNIT, COUNT_UNIT = 2.0**30, 2.0**20, 2.0**35


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    max_depth: int = 5
    learning_rate: float = 0.1
    subsample: float = 0.8
    min_samples_leaf: int = 10
    min_samples_split: int = 20
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: ``feature`` is -1 at leaves, rows with a value over ``cut`` (a bin over ``bin``) go right."""

    feature: list[int]
    bin: list[int]
    cut: list[float]
    value: list[float]

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree([-1] * n, [0] * n, [0.0] * n, [0.0] * n)


@dataclass
class BoostedTrees:
    columns: list[str]
    prior: float
    depth: int
    trees: list[Tree] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        """Log-odds of the positive class, from the feature columns. Trees are nested conditions, so that a row meets its own
        path only. They stand outside of the lambda function, which Spark would interpret with all that is inside; it is there
        because its presence keeps the projection out of whole-stage code, which is one method and too long for these trees:
        a projection of its own is compiled in many short methods."""
        def number(v: float) -> str:
            return f"{float(v)!r}D" if math.isfinite(v) else f"double('{v}')"

        def walk(tree: Tree, node: int) -> str:
            if tree.feature[node] < 0:
                return number(tree.value[node])
            return f"IF({row[tree.feature[node]]} > {number(tree.cut[node])}, {walk(tree, 2 * node + 2)}, {walk(tree, 2 * node + 1)})"

        if not self.trees:
            return F.lit(float(self.prior))
        row = ["coalesce(cast(`{}` AS double), 0D)".format(c.replace("`", "``")) for c in self.columns]
        start = F.expr(f"aggregate(array({row[0]}), {number(self.prior)}, (sum, x) -> sum)")  # the prior, whatever the row
        return reduce(lambda total, tree: total + F.expr(walk(tree, 0)), self.trees, start)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def importances(self) -> list[float]:
        """Share of each feature in all improvements."""
        total = sum(self.gains)
        return [g / total if total else 0.0 for g in self.gains]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        d = json.loads(text)
        return BoostedTrees(d["columns"], d["prior"], d["depth"], [Tree(**t) for t in d["trees"]], d["gains"])


def cut_points(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Up to ``bins - 1`` increasing cuts per feature, from quantile sketches of all rows."""
    probabilities = [i / bins for i in range(1, bins)]
    found = rows.approxQuantile(columns, probabilities, 1 / (8 * bins))
    return [sorted(set(c)) for c in found]


def binned(rows: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """The rows with ``x``, a byte for each feature, in place of the features."""
    kept = [f for f in rows.schema.fields if f.name not in columns]

    def bins(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.empty((len(columns), n), np.uint8)
            for f, c in enumerate(columns):
                x[f] = np.searchsorted(cuts[f], batch.column(c).to_numpy(zero_copy_only=False), side="left")
            ends = np.arange(n + 1, dtype=np.int32) * len(columns)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(x.T.tobytes())])
            yield pa.RecordBatch.from_arrays([packed, *(batch.column(f.name) for f in kept)], ["x", *(f.name for f in kept)])

    return rows.mapInArrow(bins, StructType([StructField("x", BinaryType()), *kept]))


def blocks(rows: DataFrame, columns: list[str], cuts: list[list[float]], size: int, run: Run, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Written blocks of up to ``size`` binned rows; ``rows`` has the features, ``label``, ``draw`` (a hash of the row's key) and
    ``fold``, unless ``deal`` adds that. ``counts`` are the rows per fold and label."""

    def whole(batches) -> Iterator[pa.Table]:
        """Tables of ``size`` rows: Spark's batches are smaller, and a block costs its cells besides its rows."""
        kept: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                kept.append(batch.slice(lo, size - n))
                lo, n = lo + kept[-1].num_rows, n + kept[-1].num_rows
                if n == size:
                    yield pa.Table.from_batches(kept)
                    kept, n = [], 0
        if kept:
            yield pa.Table.from_batches(kept)

    def pack(batches):
        for table in whole(batches):
            x = np.concatenate([each_row(c, len(columns)) for c in table.column("x").chunks])
            y, fold = (table.column(c).to_numpy().astype(np.int8) for c in ("label", "fold"))
            draw = table.column("draw").to_numpy().astype(np.int64)
            counts = np.bincount(fold.astype(np.int64) * 2 + y)
            values = [np.ascontiguousarray(x.T).tobytes(), y.tobytes(), fold.tobytes(), draw.tobytes()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in values), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["x", "y", "fold", "draw", "counts"])

    def each_row(x: pa.Array, width: int) -> np.ndarray:
        lo = np.frombuffer(x.buffers()[1], np.int32)[x.offset]
        return np.frombuffer(x.buffers()[2], np.uint8)[lo : lo + len(x) * width].reshape(-1, width)

    bytes_only = binned(rows, columns, cuts)
    dealt_rows = deal(bytes_only) if deal else bytes_only
    packed = run.few(dealt_rows.select("x", "label", "fold", "draw")).mapInArrow(pack, "x binary, y binary, fold binary, draw binary, counts array<long>")
    return run.stored(packed, "blocks")


@dataclass
class Sampled:
    """What a level reads of some rows: per model whether a row is sampled and its residual and curvature, as integers; ``node``
    where it is known already where each row stands."""

    x: np.ndarray
    on: np.ndarray
    g: np.ndarray
    h: np.ndarray
    node: np.ndarray | None = None

    def parts(self, m: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals and curvatures of ``rows`` for a model."""
        return self.g[m].take(rows).astype(np.float64), self.h[m].take(rows).astype(np.float64)


@dataclass
class Standing:
    """The same for rows of a block, whose residuals are worked out of the margins where they are read."""

    x: np.ndarray
    on: np.ndarray
    y: np.ndarray
    margin: np.ndarray
    node: np.ndarray

    def parts(self, m: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.margin[m].take(rows)
        np.negative(p, out=p)
        np.exp(p, out=p)
        p += 1
        np.divide(1, p, out=p)
        g = self.y.take(rows) - p
        g *= G_UNIT
        h = 1 - p
        h *= p
        h *= H_UNIT
        return np.rint(g, out=g), np.rint(h, out=h)


def unpacked(row, width: int, priors: list[float], depth: int) -> Block:
    """A block of a stored row, with the margins before the first tree."""
    y = np.frombuffer(row.y, np.int8)
    margin = np.repeat(np.array(priors)[:, None], len(y), axis=1)
    node = np.zeros(margin.shape, node_type(depth))
    taken = np.zeros(len(y), bool)
    return Block(np.frombuffer(row.x, np.uint8).reshape(width, -1), y, np.frombuffer(row.fold, np.int8), np.frombuffer(row.draw, np.uint64), margin, node, taken)


def sampled(draw: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether each row takes part in a tree: a 64-bit mix of its key, the tree and the seed, as a number in [0, 1)."""
    h = draw + np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 < share


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int, node: np.ndarray, start: int = 0) -> None:
    """Moves each row's ``node`` down from level ``start`` to ``levels``. A node's rows move by comparing whole columns of bytes, a
    fraction of what looking up each row's own column would take."""
    for s in range(2**start - 1, 2**levels - 1):
        if feature[s] >= 0:
            here = node == s
            right = here & (x[feature[s]] > cut[s])
            node += here * node.dtype.type(s + 1)  # to the left child, 2 s + 1
            node += right


def chunks(block: Block, rows: int | None = None) -> Iterator[slice]:
    rows = rows or CHUNK_ROWS
    for lo in range(0, len(block.y), rows):
        yield slice(lo, min(lo + rows, len(block.y)))


Grown = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature, bin and value of the nodes, each model x node


def arrays(trees: list[Tree]) -> Grown:
    return np.array([t.feature for t in trees], np.int16), np.array([t.bin for t in trees], np.int16), np.array([t.value for t in trees])


def next_tree(block: Block, grown: Grown | None, tree: int, settings: Settings) -> None:
    """Adds the trees just grown to the margins, puts all rows back to the roots and draws those of the next tree."""
    for at in chunks(block):
        if grown is not None:
            for m, (feature, cut, value) in enumerate(zip(*grown, strict=True)):
                descend(block.x[:, at], feature, cut, settings.max_depth, block.node[m, at])
                block.margin[m, at] += value[block.node[m, at]]
        block.node[:, at] = 0
        block.taken[at] = sampled(block.draw[at], tree, settings.seed, settings.subsample)


def next_level(block: Block, grown: Grown, level: int) -> None:
    """Moves the rows from ``level`` - 1 to ``level`` of the trees that grow."""
    for at in chunks(block):
        for m, (feature, cut, _) in enumerate(zip(*grown, strict=True)):
            descend(block.x[:, at], feature, cut, level, block.node[m, at], level - 1)


def drawn(block: Block, leave_out: tuple[int, ...], levels: int) -> Iterator[Standing]:
    """The rows that a tree samples; model by model, ``leave_out`` is the fold that it does not see. Below the root fewer rows are
    counted in more nodes, so more are looked at together: their cells are added up once for each."""
    for at in chunks(block, DEEP_CHUNKS * CHUNK_ROWS if levels else CHUNK_ROWS):
        on = block.taken[None, at] & (block.fold[None, at] != np.array(leave_out, np.int8)[:, None])
        yield Standing(block.x[:, at], on, block.y[at], block.margin[:, at], block.node[:, at])


Sums = list[tuple[np.ndarray, ...] | None]


def bundled(widths: list[int]) -> list[list[int]]:
    """Features whose bins are counted together: every feature once, few bundles of at most ``BUNDLE_CELLS`` combined bins."""
    out: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        at = next((k for k, (cells, _) in enumerate(out) if cells * widths[f] <= BUNDLE_CELLS), None)
        if at is None:
            out.append((widths[f], [f]))
        else:
            out[at] = out[at][0] * widths[f], out[at][1] + [f]
    return [features for _, features in out]


def level_sums(held: Iterable[Sampled | Standing], grown: list[tuple[np.ndarray, ...]], wanted: list[list[int]], levels: int, widths: list[int]) -> Iterator[Sums]:
    """Per model the residuals, curvatures and rows of a partition's sampled rows, each an array wanted node x cell; the
    cells are the features' bins, end to end. Rows are counted once per bundle of features; the sums of a feature are those of
    its bundle, added up over the other features (whole numbers, so exactly the same)."""
    starts = np.concatenate([[0], np.cumsum(widths)])
    bundles = bundled(widths)
    total = [np.zeros((3, len(nodes), starts[-1]), np.int64) if nodes else None for nodes in wanted]
    for block in held:
        codes = np.zeros((len(bundles), block.x.shape[1]), np.uint16)
        for code, features in zip(codes, bundles, strict=True):
            for f in features:
                code *= np.uint16(widths[f])
                code += block.x[f]
        for m, nodes in enumerate(wanted):
            if not nodes:
                continue
            on, node = block.on[m], None
            if levels:
                if block.node is not None:
                    node = block.node[m]
                else:
                    node = np.zeros(len(on), node_type(levels))
                    descend(block.x, *grown[m][:2], levels, node)
                here = node == nodes[0]
                for n in nodes[1:]:
                    here |= node == n
                on = on & here
            found = np.flatnonzero(on)
            for lo in range(0, len(found), PACKED_ROWS):
                add_rows(total[m], block, m, found[lo : lo + PACKED_ROWS], node, nodes, codes, bundles, widths, starts)
    yield [None if t is None else tuple(narrowed(part) for part in t) for t in total]


def add_rows(total: np.ndarray, block: Sampled | Standing, m: int, rows: np.ndarray, node: np.ndarray | None, nodes: list[int], codes: np.ndarray, bundles: list[list[int]], widths: list[int], starts: np.ndarray) -> None:
    """Adds the sums of at most ``PACKED_ROWS`` rows; curvatures and numbers of rows are added up in one number."""
    g, hc = block.parts(m, rows)
    hc += COUNT_UNIT
    number = None
    if len(nodes) > 1:
        number = np.zeros(nodes[-1] + 1, np.int64)
        number[nodes] = np.arange(len(nodes))
        number = number[node.take(rows)]
        most = len(nodes) * max(math.prod(widths[f] for f in features) for features in bundles)
        number = number.astype(np.min_scalar_type(most))
    for code, features in zip(codes, bundles, strict=True):
        own_widths = [widths[f] for f in features]
        cells = math.prod(own_widths)
        place = code.take(rows)
        if number is not None:  # in as few bytes as hold it
            place = place + number * number.dtype.type(cells)
        place = place.astype(np.int64)
        for w, packed in ((g, False), (hc, True)):
            sums = np.bincount(place, w, len(nodes) * cells).reshape(len(nodes), cells)
            for f, mine in zip(features, marginals(sums, own_widths), strict=True):
                own = slice(starts[f], starts[f + 1])
                if packed:
                    n = np.floor(mine / COUNT_UNIT)
                    total[1, :, own] += (mine - n * COUNT_UNIT).astype(np.int64)
                    total[2, :, own] += n.astype(np.int64)
                else:
                    total[0, :, own] += mine.astype(np.int64)


def marginals(sums: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """Per feature the sums (node x bin) of combined cells (node x cell), which are halved again and again: two passes over all
    cells, the rest is small."""
    if len(widths) == 1:
        return [sums]
    half = max(1, next(k for k in range(len(widths) + 1) if math.prod(widths[:k]) ** 2 >= math.prod(widths)) - 1)
    both = sums.reshape(len(sums), math.prod(widths[:half]), -1)
    return marginals(both.sum(axis=2), widths[:half]) + marginals(both.sum(axis=1), widths[half:])


def cell_places(widths: list[int]) -> np.ndarray:
    """Where each cell stands in a feature x bin table."""
    return np.concatenate([f * max(widths) + np.arange(w) for f, w in enumerate(widths)])


def narrowed(x: np.ndarray) -> np.ndarray:
    """The same integers in 4 bytes where they fit: less to move."""
    return x.astype(np.int32) if x.size and max(-int(x.min()), int(x.max())) < 2**31 else x


def added(a: Sums, b: Sums) -> Sums:
    both = zip(a, b, strict=True)
    return [y if x is None else x if y is None else tuple(p.astype(np.int64) + q for p, q in zip(x, y, strict=True)) for x, y in both]


def totalled(parts: RDD) -> Sums:
    if parts.getNumPartitions() > MOST_DIRECT:
        return parts.treeReduce(added)
    return reduce(added, parts.collect())


def best_splits(sums: np.ndarray, settings: Settings) -> list[tuple[float, int, int, np.ndarray] | None]:
    """Per node (improvement, feature, bin, left sums), or None where no split is allowed. ``sums``: 3 x node x feature x bin."""
    left = np.cumsum(sums, axis=3)[..., :-1]
    whole = sums.sum(axis=3)[..., None]
    g, n = left[0].astype(np.float64), left[2].astype(np.float64)
    rest_g, rest_n = whole[0] - g, whole[2] - n
    allowed = (n >= max(1, settings.min_samples_leaf)) & (rest_n >= max(1, settings.min_samples_leaf)) & (whole[2] >= settings.min_samples_split)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * rest_n * (g / n - rest_g / rest_n) ** 2 / (n + rest_n)
    gain = np.where(allowed & (gain > 0), gain, -1.0).reshape(gain.shape[0], -1)
    out = []
    for j, at in enumerate(gain.argmax(axis=1)):
        feature, cut = divmod(int(at), left.shape[3])
        out.append((float(gain[j, at]), feature, cut, left[:, j, feature, cut]) if gain[j, at] > 0 else None)
    return out


def grow_level_by_level(totals: Callable[..., Sums], models: int, cuts: list[list[float]], settings: Settings, gains: np.ndarray) -> list[Tree]:
    """The next tree of every model, from ``totals`` (``level_sums`` of all rows); improvements are added to ``gains`` (model
    x feature)."""
    trees = [Tree.empty(settings.max_depth) for _ in range(models)]
    known: list[dict[int, np.ndarray]] = [{} for _ in range(models)]  # sums of the nodes of a level
    wanted: list[list[int]] = [[0] for _ in range(models)]
    siblings: list[dict[int, int]] = [{} for _ in range(models)]
    parents: list[dict[int, np.ndarray]] = [{} for _ in range(models)]
    widths = [len(c) + 1 for c in cuts]
    cells = cell_places(widths)
    for level in range(settings.max_depth):
        found = totals(grown=arrays(trees), wanted=wanted, levels=level, widths=widths)
        for m in range(models):
            counted = np.zeros((3, len(wanted[m]), len(cuts) * max(widths)), np.int64)
            if found[m] is not None:
                counted[..., cells] = found[m]
            counted = counted.reshape(3, len(wanted[m]), len(cuts), max(widths))
            known[m] = {node: counted[:, j] for j, node in enumerate(wanted[m])}
            for node, other in siblings[m].items():
                known[m][other] = parents[m][(node - 1) // 2] - known[m][node]
            wanted[m], siblings[m], parents[m] = [], {}, {}
            if not known[m]:
                continue
            nodes = sorted(known[m])
            splits = best_splits(np.stack([known[m][n] for n in nodes], axis=1), settings)
            for node, split in zip(nodes, splits, strict=True):
                whole = known[m][node][:, 0].sum(axis=1)
                if level == 0:
                    trees[m].value[0] = newton(whole, settings)
                if split is None:
                    continue
                gain, feature, cut, left = split
                gains[m, feature] += gain / G_UNIT**2
                trees[m].feature[node], trees[m].bin[node], trees[m].cut[node] = feature, cut, cuts[feature][cut]
                sides = {2 * node + 1: left, 2 * node + 2: whole - left}
                for child, sums in sides.items():
                    trees[m].value[child] = newton(sums, settings)
                if level + 1 == settings.max_depth or max(s[2] for s in sides.values()) < settings.min_samples_split:
                    continue
                small, large = sorted(sides, key=lambda c: (sides[c][2], c))
                wanted[m].append(small)
                siblings[m][small] = large
                parents[m][node] = known[m][node]
        if not any(wanted):
            break
    return trees


def newton(sums: np.ndarray, settings: Settings) -> float:
    """Learning rate x residuals / curvatures of a leaf."""
    return settings.learning_rate * (int(sums[0]) / G_UNIT) / (int(sums[1]) / H_UNIT) if sums[1] else 0.0


def log_odds(positive: int, total: int) -> float:
    p = min(max(positive / total if total else 0.5, 1e-7), 1 - 1e-7)
    return math.log(p / (1 - p))


def fit(rows: DataFrame, columns: list[str], folds: int, settings: Settings, run: Run, deal: Callable[[DataFrame], DataFrame] | None = None) -> tuple[BoostedTrees, list[BoostedTrees], DataFrame]:
    """The final model, the models of the folds, and a stored table (fold, label, cv_margin, margin) with the margins of the
    training rows: by the model that left the row's fold out, and by the final one (in one row or in two). ``deal`` adds the
    ``fold`` where the rows have none."""
    total = rows.count()
    cuts = cut_points(rows, columns, settings.bins)
    # A task costs about as much as its work on TASK_ROWS rows, so small tables are dealt over fewer tasks than there are cores.
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)))
    packed = blocks(rows, columns, cuts, min(max(-(-total // tasks), 1), BLOCK_ROWS), run, deal)
    sizes = np.zeros((folds, 2), np.int64)
    for r in packed.select("counts").collect():
        sizes.reshape(-1)[: len(r.counts)] += r.counts
    priors = []
    for m in range(folds + 1):
        seen = np.delete(sizes, m, axis=0) if m < folds else sizes
        priors.append(log_odds(int(seen[:, 1].sum()), int(seen.sum())))
    grow = grow_broadcast if total <= BROADCAST_ROWS else grow_distributed
    trees, gains, margins = grow(packed, tasks, cuts, priors, settings, run)
    fitted = [BoostedTrees(columns, prior, settings.max_depth, t, g) for prior, t, g in zip(priors, trees, gains, strict=True)]
    return fitted[folds], fitted[:folds], margins


MARGINS = "fold int, label int, cv_margin double, margin double"


def step(block: Block, k: int, trees: list[Grown], settings: Settings) -> None:
    """Step ``k`` of growth: one per level, the first of a tree also takes in the tree before it."""
    tree, level = divmod(k, settings.max_depth)
    if level == 0:
        next_tree(block, trees[tree - 1] if tree else None, tree, settings)
    else:
        next_level(block, trees[tree], level)


def part_sums(parts: Iterator[Part], growth: Growth, trees: list[Grown], settings: Settings, tree: int, wanted: list[list[int]], levels: int, widths: list[int]) -> Iterator[Sums]:
    for part in parts:
        with growth.held(part, tree * settings.max_depth + levels, partial(step, trees=trees, settings=settings)) as block:
            yield from level_sums(drawn(block, tuple(range(len(wanted))), levels), [], wanted, levels, widths)


def part_margins(parts: Iterator[Part], growth: Growth, trees: list[Grown], settings: Settings, folder: str) -> Iterator[int]:
    """Writes the margins of a partition's rows; a task that runs twice writes the same file."""
    for part in parts:
        with growth.held(part, settings.n_estimators * settings.max_depth, partial(step, trees=trees, settings=settings)) as block, written(folder, f"part-{part.number:05d}.parquet") as out:
            schema = pa.schema([("fold", pa.int32()), ("label", pa.int32()), ("cv_margin", pa.float64()), ("margin", pa.float64())])
            with pq.ParquetWriter(out, schema) as writer:
                for at in chunks(block):
                    fold, margin = block.fold[at], block.margin[:, at]
                    own = margin[fold, np.arange(len(fold))]
                    writer.write_table(pa.table([fold.astype(np.int32), block.y[at].astype(np.int32), own, np.array(margin[-1])], schema=schema))
        yield part.rows


def grow_distributed(packed: DataFrame, tasks: int, cuts: list[list[float]], priors: list[float], settings: Settings, run: Run):
    """Trees and improvements of all models, and the margins table; one job per level."""
    spark, models = packed.sparkSession, len(priors)
    parts = dealt(packed, tasks)
    # A partition's place is where this small table's partition is cached: its tasks go to the executor that holds its rows.
    places = spark.sparkContext.parallelize(parts, len(parts)).persist(StorageLevel.MEMORY_ONLY)
    growth = Growth(uuid.uuid4().hex, len(cuts), priors, settings.max_depth)
    trees: list[list[Tree]] = [[] for _ in priors]
    done: list[Grown] = []
    gains = np.zeros((models, len(cuts)))
    try:
        for t in range(settings.n_estimators):

            def totals(grown: Grown, t: int = t, **k) -> Sums:
                return totalled(places.mapPartitions(partial(part_sums, growth=growth, trees=[*done, grown], settings=settings, tree=t, **k)))

            grown = grow_level_by_level(totals, models, cuts, settings, gains)
            done.append(arrays(grown))
            for m, tree in enumerate(grown):
                trees[m].append(tree)
        folder = f"{run.folder}/margins"
        places.mapPartitions(partial(part_margins, growth=growth, trees=done, settings=settings, folder=folder)).collect()
        return trees, gains.tolist(), spark.read.schema(MARGINS).parquet(folder)
    finally:
        places.foreach(growth.remove)
        places.unpersist()


def grow_broadcast(packed: DataFrame, tasks: int, cuts: list[list[float]], priors: list[float], settings: Settings, run: Run):
    """The same for a table whose blocks are small enough to be sent to every task: a task per model."""
    spark, models = packed.sparkSession, len(priors)
    folds = models - 1
    sent = spark.sparkContext.broadcast(packed.collect())  # at most BROADCAST_ROWS rows

    def grow(batches):
        for batch in batches:
            for m in batch.column("id").to_pylist():
                held = [unpacked(row, len(cuts), priors[m : m + 1], settings.max_depth) for row in sent.value]

                def totals(grown: Grown, levels: int, held=held, m=m, **k) -> Sums:
                    for block in held if levels else []:
                        next_level(block, grown, levels)
                    return next(level_sums(chain.from_iterable(drawn(block, (m,), levels) for block in held), [], levels=levels, **k))

                gains, trees, done = np.zeros((1, len(cuts))), [], None
                for t in range(settings.n_estimators + 1):
                    for block in held:
                        next_tree(block, done, t, settings)
                    if t < settings.n_estimators:
                        grown = grow_level_by_level(totals, 1, cuts, settings, gains)
                        done = arrays(grown)
                        trees.append(asdict(grown[0]))
                fold, y, margin = (np.concatenate(c) for c in zip(*((b.fold, b.y, b.margin[0]) for b in held), strict=True))
                seen = fold == m if m < folds else np.ones(len(y), bool)
                values = [m, json.dumps([trees, gains[0].tolist()]), fold[seen].tobytes(), y[seen].tobytes(), margin[seen].tobytes()]
                types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["model", "grown", "fold", "label", "margin"])

    done = run.stored(spark.range(0, models, 1, models).mapInArrow(grow, "model int, grown string, fold binary, label binary, margin binary"), "grown")
    found = {r.model: json.loads(r.grown) for r in done.select("model", "grown").collect()}
    sent.unpersist()

    def margins(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fold, label = (pa.array(np.frombuffer(row[c], np.int8).astype(np.int32)) for c in ("fold", "label"))
                own, none = pa.array(np.frombuffer(row["margin"], np.float64)), pa.nulls(len(fold), pa.float64())
                both = [own, none] if row["model"] < folds else [none, own]
                yield pa.RecordBatch.from_arrays([fold, label, *both], ["fold", "label", "cv_margin", "margin"])

    table = done.select("model", "fold", "label", "margin").mapInArrow(margins, MARGINS)
    return [[Tree(**t) for t in found[m][0]] for m in range(models)], [found[m][1] for m in range(models)], run.stored(table, "margins")
