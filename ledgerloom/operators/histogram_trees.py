"""Gradient-boosted trees on shared histograms.

Features are cut into quantile bins once and packed as byte matrices in blocks of rows; the blocks stay
on the executors. A level of a tree is one job: each task adds up gradient, curvature and row count per
(node, bin) over its blocks, and only those sums travel. Columns of few bins are counted together and told
apart at the end of a task. Of two siblings only the one with fewer rows is
added up, the other is its parent less the sibling. Values of leaves come from the same sums; for absolute
errors a leaf takes the median of its residuals, found by two passes of counting.

Blocks carry the score they had at the last of every ``store_every`` rounds; the trees since then travel
with the jobs and are applied on the fly. Lost blocks are built again from the stored bins and the trees.

A fitted model is a few matrices (tree, node) in heap order, so all trees are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.ordering import array_quantiles, condensed, merged, regrouped  # noqa: F401
from ledgerloom.scratch import materialise
from ledgerloom.settings import SEED

# Rows of a block: at most the first, and so few that a task has some blocks, but not under the second for that.
BLOCK_ROWS, SMALL_BLOCK = 32_768, 4096
# Columns are counted together while the product of their bins is at most this.
JOINT_BINS = 1024
# Up to so many rows are fitted as they lie, column by column, with edges by Spark's own percentiles: equal splits are told
# apart by the last digits of sums, so the order of adding up decides between them.
FEW_ROWS, FEW_BLOCK = 100_000, 10_000
# Values (rows x features) per task: as many tasks as this gives, up to one per core, then as many as the second.
SMALL_TASK, LARGE_TASK = 400_000, 64_000_000
RESIDUAL_BINS = 1024
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins, label, hash of the key, score


def derivatives(loss: str, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss in the score."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    if loss == "tweedie":
        down, up = y * np.exp(-f / 2), np.exp(f / 2)
        return up - down, (up + down) / 2
    if loss == "gamma":
        ratio = y * np.exp(-f)
        return 1 - ratio, ratio
    if loss == "poisson":
        return np.exp(f) - y, np.exp(f)
    if loss == "squared":
        return f - y, np.ones(len(y))
    if loss == "absolute":
        return np.sign(f - y), np.ones(len(y))
    raise ValueError(f"unknown loss {loss}")


def picked(keys: np.ndarray, number: int, share: float) -> np.ndarray:
    """Which rows a round takes: the same ones in every job and rerun."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53) < share


@dataclass
class Trees:
    """Nodes in heap order: node k has the children 2k + 1 and 2k + 2; a leaf has feature -1."""

    feature: np.ndarray    # (trees, nodes)
    threshold: np.ndarray  # the bin, or the value, up to which a row goes left
    value: np.ndarray

    def _paths(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """The way of every row as a number, a bit per level (left 0, also below a leaf), and the leaf at the end of every way.

        A node compares one column of all rows, so columns should lie in one piece; ways are put together from
        whole columns of bits, without a branch or a lookup per row.
        """
        feature, threshold = self.feature[tree], self.threshold[tree].astype(x.dtype)

        def below(node: int) -> list:
            if feature[node] < 0:
                return []
            right = x[:, feature[node]] > threshold[node]
            bits = [right]
            for a, b in zip_longest(below(2 * node + 1), below(2 * node + 2)):
                bits.append(b & right if a is None else a > right if b is None else a ^ (right & (a ^ b)))
            return bits

        bits, ends = below(0), [0]
        for _ in bits:
            ends = [child for node in ends for child in ((2 * node + 1, 2 * node + 2) if feature[node] >= 0 else (node, node))]
        way = np.zeros(1, np.uint8 if len(ends) <= 256 else np.int64)
        for bit in bits:
            way = way * 2 + bit
        return np.broadcast_to(way, len(x)), np.array(ends, np.uint8 if len(feature) <= 256 else np.int64)

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of every row."""
        way, ends = self._paths(x, tree)
        return ends.take(way)

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in range(len(self.feature)):
            way, ends = self._paths(x, tree)
            total += self.value[tree].take(ends).take(way)
        return total


def scored(trees: Trees, blocks: Iterator[Block]) -> Iterator[Block]:
    for bins, y, keys, f in blocks:
        yield bins, y, keys, f + trees.sums(bins)


def joint_columns(columns: list[int], counts: np.ndarray, most: int) -> list[list[int]]:
    """``columns`` in groups whose bins multiply to at most ``most``; a column of more bins stands alone."""
    groups: list[list[int]] = []
    sizes: list[int] = []
    for c in sorted(columns, key=lambda c: -counts[c]):
        fit = next((k for k, size in enumerate(sizes) if size * counts[c] <= most), None)
        if fit is None:
            groups.append([c])
            sizes.append(int(counts[c]))
        else:
            groups[fit].append(c)
            sizes[fit] *= int(counts[c])
    return groups


def level_sums(loss: str, number: int, share: float, grown: Trees, tree: Trees, nodes: list[int], starts: np.ndarray, size: int, columns: list[int], blocks, joint: int = JOINT_BINS) -> Iterator[np.ndarray]:
    """Gradient, curvature and rows per (node, bin of ``columns``) of the rows of a task, and the range of the residuals."""
    low, high = np.inf, -np.inf
    counts = np.diff(np.append(starts, size))
    slot = np.full(tree.feature.shape[1], -1)
    slot[nodes] = np.arange(len(nodes))
    flat = loss in ("squared", "absolute")  # their curvature is one, so its sum is the number of rows
    groups = joint_columns(columns, counts, joint)
    sums = [np.zeros((2 if flat else 3, int(np.prod(counts[g])) * len(nodes))) for g in groups]
    kind = np.uint16 if all(s.shape[1] <= 1 << 16 for s in sums) else np.int64
    held = np.zeros(0, np.int64)
    for bins, y, keys, f in scored(grown, blocks):
        g, h = derivatives(loss, y, f)
        if loss == "absolute":
            low, high = min(low, (y - f).min()), max(high, (y - f).max())
        at = slot[tree.leaves(bins, 0)] if len(nodes) > 1 or nodes[0] else np.zeros(len(y), int)
        if share < 1:
            at = np.where(picked(keys, number, share), at, -1)
        rows = np.flatnonzero(at >= 0)
        if not len(rows):
            continue
        every = len(rows) == len(at)
        slots, g, h = (at, g, h) if every else (at[rows], g[rows], h[rows])
        slots = slots.astype(kind)
        if len(held) < len(rows):  # memory asked for again and again costs more than the sums
            held = np.zeros(len(rows), np.int64)
        place = held[:len(rows)]
        for group, total in zip(groups, sums):  # one by one: nothing of rows x columns is made
            code = None
            for c in group:
                column = bins[:, c] if every else bins[:, c].take(rows)
                code = column.astype(kind) if code is None else np.add(np.multiply(code, kind(counts[c]), out=code), column, out=code)
            if len(nodes) > 1:
                np.add(np.multiply(code, kind(len(nodes)), out=code), slots, out=code)
            np.copyto(place, code)
            for part, weight in zip(total, (g, None) if flat else (g, h, None)):
                part += np.bincount(place, weight, total.shape[1])
    total = np.zeros((3, len(nodes), size))
    for group, found in zip(groups, sums):
        shaped = found.reshape(len(found), *counts[group], len(nodes))
        for k, c in enumerate(group):
            own = shaped.sum(axis=tuple(a for a in range(1, len(group) + 1) if a != k + 1)).transpose(0, 2, 1)
            total[:, :, starts[c]:starts[c] + counts[c]] = own[[0, 1, 1]] if flat else own
    yield np.append(total.ravel(), [low, high])


def residual_counts(number: int, share: float, grown: Trees, tree: Trees, low: np.ndarray, width: np.ndarray, blocks) -> Iterator[np.ndarray]:
    """Per node, residuals below ``low``, in each of the bins of this width from it on, and above."""
    total = np.zeros((len(low), RESIDUAL_BINS + 2))
    for bins, y, keys, f in scored(grown, blocks):
        rows = np.flatnonzero(picked(keys, number, share))
        node = tree.leaves(bins, 0)[rows].astype(np.int64)
        at = np.clip(np.floor(((y - f)[rows] - low[node]) / width[node]), -1, RESIDUAL_BINS).astype(int) + 1
        total += np.bincount(node * (RESIDUAL_BINS + 2) + at, minlength=total.size).reshape(total.shape)
    yield total


def side_by_side(*fits) -> list:
    """What the functions return, each called in a thread of its own."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(fit) for fit in fits]]


def dealt(blocks: RDD, parts: int) -> RDD:
    """``blocks`` in turn to ``parts`` tasks, in the same order in every run."""
    def marked(p: int, rows):
        for i, row in enumerate(rows):
            yield (p, i), row

    ways = blocks.mapPartitionsWithIndex(marked).partitionBy(parts, lambda at: at[0] + at[1])
    return ways.mapPartitions(lambda rows: (row for _, row in sorted(rows, key=lambda r: r[0])), preservesPartitioning=True)


def summed(blocks: RDD, function) -> np.ndarray:
    """The sum of what the tasks return, added up on executors where there are many tasks."""
    parts = blocks.mapPartitions(function)
    if blocks.getNumPartitions() > 64:
        return parts.treeReduce(_added)
    out = None
    for part in parts.collect():  # one array of sums per task
        out = part if out is None else _added(out, part)
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    if out.ndim == 1:  # the last two are a range
        out[-2], out[-1] = min(a[-2], b[-2]), max(a[-1], b[-1])
    return out


@dataclass
class HistogramTrees:
    """Boosting of trees for the losses of :func:`derivatives`."""

    loss: str
    rounds: int
    depth: int = 3
    step: float = 0.05
    penalty: float = 10.0
    min_rows: int = 20
    min_weight: float = 0.0    # curvature that a child needs
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 128
    store_every: int = 20
    seed: int = SEED

    def fit(self, rows: DataFrame, label: str, key: Column, features: str = "features") -> "HistogramTrees":
        """Learn from ``rows``; ``key`` tells rows apart and picks those of a round."""
        spark = rows.sparkSession
        binned = materialise(rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("k")), "trees-rows")
        n = binned.count()
        if not n:
            raise ValueError("no training rows")
        width = len(binned.first()["x"])
        cuts = self._cuts(binned, width, n)
        self.start = self._start(binned)
        slots = spark.sparkContext.defaultParallelism
        tasks = max(min(slots, -(-n * width // SMALL_TASK)), -(-n * width // LARGE_TASK))
        if n <= FEW_ROWS:
            blocks = self._blocks(binned.coalesce(tasks), cuts, min(FEW_BLOCK, BLOCK_ROWS))
        else:  # the wide rows stay where they lie; their packed blocks are dealt out evenly, as every job waits for its largest task
            blocks = dealt(self._blocks(binned, cuts, max(SMALL_BLOCK, min(BLOCK_ROWS, n // (8 * tasks)))), tasks)
        blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        joint = JOINT_BINS if n > FEW_ROWS else 1
        sizes = np.array([len(c) + 1 for c in cuts])
        layout = np.cumsum(sizes) - sizes, int(sizes.sum())
        trees: list[Trees] = []
        stored, older = 0, None
        for number in range(self.rounds):
            grown = _joined(trees[stored:], self.depth)
            trees.append(self._tree(blocks, number, grown, sizes, *layout, joint))
            if older is not None:  # that tree's first job has stored the newer blocks
                older.unpersist()
                older = None
            if len(trees) - stored >= self.store_every and number + 1 < self.rounds:
                # The closure holds these trees only; the blocks before are dropped once the new ones exist.
                since, unpacked = _joined(trees[stored:], self.depth), partial(_unpacked, self.start, width)
                older, blocks = blocks, blocks.mapPartitions(lambda rows, t=since, u=unpacked: scored(t, u(rows))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                stored = len(trees)
        blocks.unpersist()
        all_trees = _joined(trees, self.depth)
        self.feature, self.value, at = all_trees.feature, all_trees.value, all_trees.threshold.astype(int)
        padded = np.zeros((width, max(1, int(sizes.max()))))
        for f, c in enumerate(cuts):
            padded[f, :len(c)] = c
        self.threshold = padded[np.maximum(self.feature, 0), at]
        return self

    def margin(self, rows: DataFrame, output: str, features: str = "features") -> DataFrame:
        """``rows`` with the score of all trees."""
        trees, start = Trees(np.asarray(self.feature, int).reshape(len(self.feature), -1), np.asarray(self.threshold, float), np.asarray(self.value, float)), self.start

        @F.arrow_udf("double")
        def score(x: pa.Array) -> pa.Array:
            return pa.array(start + trees.sums(np.asfortranarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))))

        return rows.withColumn(output, score(vector_to_array(features)))

    # ------------------------------------------------------------ preparation

    def _start(self, rows: DataFrame) -> float:
        if self.loss == "absolute":
            return float(rows.agg(F.percentile_approx("y", 0.5, 100_000)).first()[0])
        mean = float(rows.agg(F.avg("y")).first()[0])
        if self.loss == "logistic":
            mean = min(max(mean, 1e-12), 1 - 1e-12)
            return float(np.log(mean / (1 - mean)))
        if self.loss == "squared":
            return mean
        if mean <= 0:
            raise ValueError("a log link needs a positive mean")
        return float(np.log(mean))

    def _cuts(self, rows: DataFrame, width: int, n: int | None = None) -> list[np.ndarray]:
        """Upper edges of the bins of each feature, its largest value left out."""
        shares = [i / self.bins for i in range(self.bins + 1)]
        if (rows.count() if n is None else n) <= FEW_ROWS:
            found = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"q{f}") for f in range(width)]).first()
        else:
            found = array_quantiles(rows, "x", width, shares)
        return [np.unique(np.array(q, float))[:-1] for q in found]

    @staticmethod
    def _blocks(rows: DataFrame, cuts: list[np.ndarray], size: int | None = None) -> RDD:
        most = size or BLOCK_ROWS

        def pack(batches):
            for batch in regrouped(batches, most):
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(c, np.ascontiguousarray(x[:, f]), side="left").astype(np.uint8) for f, c in enumerate(cuts)])  # column after column
                held = [bins.tobytes(), batch.column("y").to_numpy().astype("<f8").tobytes(), batch.column("k").to_numpy().astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in held], names=["bins", "y", "k"])

        return rows.mapInArrow(pack, "bins binary, y binary, k binary").rdd

    # ------------------------------------------------------------ one tree

    def _tree(self, blocks: RDD, number: int, grown: Trees, sizes: np.ndarray, starts: np.ndarray, size: int, joint: int) -> Trees:
        nodes = (1 << self.depth + 1) - 1
        tree = Trees(np.full((1, nodes), -1), np.zeros((1, nodes)), np.zeros((1, nodes)))
        width = len(sizes)
        draw = np.random.default_rng([self.seed, number])
        allowed = np.zeros(width, bool)
        allowed[draw.permutation(width)[:max(1, round(self.column_share * width))]] = True
        columns = [int(c) for c in np.flatnonzero(allowed)]
        whole = slice(starts[columns[0]], starts[columns[0]] + sizes[columns[0]])  # every row is in one of these bins
        of = np.repeat(np.arange(width), sizes)
        usable = allowed[of]
        usable[np.cumsum(sizes) - 1] = False  # nothing lies behind a feature's last bin
        parts = partial(_unpacked, self.start, width)
        sums, wanted, spread = {}, [0], None
        for level in range(self.depth):
            counted = summed(blocks, lambda rows, w=wanted: level_sums(self.loss, number, self.row_share, grown, tree, w, starts, size, columns, parts(rows), joint))
            spread = spread or (counted[-2], counted[-1])
            for node, own in zip(wanted, counted[:-2].reshape(3, len(wanted), size).transpose(1, 0, 2)):
                sums[node] = own
                if node:
                    sibling = node + 1 if node % 2 else node - 1
                    sums[sibling] = sums[(node - 1) // 2] - own
            first, wanted = (1 << level) - 1, []
            for node in range(first, 2 * first + 1):
                if node not in sums:
                    continue
                total = sums[node][:, whole].sum(axis=1)
                if node == 0:
                    tree.value[0, 0] = self._leaf(total)
                found = self._split(sums[node], total, starts, of, usable)
                if found is None:
                    continue
                at, left = found
                tree.feature[0, node], tree.threshold[0, node] = of[at], at - starts[of[at]]
                tree.value[0, 2 * node + 1], tree.value[0, 2 * node + 2] = self._leaf(left), self._leaf(total - left)
                wanted.append(2 * node + 1 if left[2] <= total[2] - left[2] else 2 * node + 2)
            if not wanted:
                break
        if self.loss == "absolute":
            self._medians(blocks, number, grown, tree, parts, *spread)
        return tree

    def _leaf(self, total: np.ndarray) -> float:
        return float(-total[0] / (total[1] + self.penalty) * self.step) if total[2] else 0.0

    def _split(self, sums, total, starts, of, usable) -> tuple[int, np.ndarray] | None:
        """(bin up to which rows go left, their sums) of the split that gains most."""
        upto = np.cumsum(sums, axis=1)
        left = upto - np.c_[np.zeros(3), upto][:, starts][:, of]
        right = total[:, None] - left
        good = usable & (left[2] >= self.min_rows) & (right[2] >= self.min_rows) & (left[1] >= self.min_weight) & (right[1] >= self.min_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + self.penalty) + right[0] ** 2 / (right[1] + self.penalty) - total[0] ** 2 / (total[1] + self.penalty)
        gain = np.where(good, gain, -np.inf)
        at = int(np.argmax(gain))
        return (at, left[:, at]) if gain[at] > 1e-9 else None

    def _medians(self, blocks, number, grown, tree, parts, low: float, high: float) -> None:
        """Values of the leaves: the medians of their residuals, to a millionth of the residuals' range."""
        nodes = tree.feature.shape[1]
        lows, widths = np.full(nodes, low), np.full(nodes, max(high - low, 1e-12) * (1 + 1e-9) / RESIDUAL_BINS)
        for last in (False, True):
            counts = summed(blocks, lambda rows, a=lows, w=widths: residual_counts(number, self.row_share, grown, tree, a, w, parts(rows)))
            half = counts.sum(axis=1) / 2
            upto = np.cumsum(counts, axis=1)
            at = np.clip((upto < half[:, None]).sum(axis=1) - 1, 0, RESIDUAL_BINS - 1)
            if not last:
                lows, widths = lows + at * widths, widths / RESIDUAL_BINS
        inside = np.maximum(counts[np.arange(nodes), at + 1], 1)
        tree.value[0] = np.where(counts.sum(axis=1) > 0, (lows + widths * (at + (half - upto[np.arange(nodes), at]) / inside)) * self.step, 0.0)


def _unpacked(start: float, width: int, rows) -> Iterator[Block]:
    """Blocks as they are stored at first (packed columns) or later (arrays with a score)."""
    for row in rows:
        if len(row) == 4:
            yield row
        else:
            y = np.frombuffer(row["y"], "<f8")
            yield np.frombuffer(row["bins"], np.uint8).reshape(width, len(y)).T, y, np.frombuffer(row["k"], "<i8").view(np.uint64), np.full(len(y), start)


def _joined(trees: list[Trees], depth: int) -> Trees:
    nodes = (1 << depth + 1) - 1
    if not trees:
        return Trees(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes)))
    return Trees(*[np.concatenate([getattr(t, name) for t in trees]) for name in ("feature", "threshold", "value")])
