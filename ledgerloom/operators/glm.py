"""Penalised generalised linear models by Newton steps on Gram matrices.

An iteration is one pass over the rows for all models that share them: each task adds up the objective,
X'r and X'KX of its blocks of rows, and only those sums travel; the driver solves the small systems.
Rows are packed once into blocks of numbers, so a pass reads no vectors and builds no rows.

Objectives are means of half the deviance (or of the logistic loss) plus half the penalty times the
squared coefficients; the intercept is free. All of them are convex, and a step that does not descend
is halved, so the fits end at the minimum from any start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.scratch import LARGE_ROWS, materialise

BLOCK_VALUES = 1 << 20  # numbers per block


@dataclass(frozen=True)
class Problem:
    """A model over ``label``; rows whose label is NULL take no part.

    The penalty is ``alpha`` on the mean objective, or 1 / (``strength`` x weights).
    """

    family: str  # "logistic", "poisson", "gamma" or "tweedie" (power 1.5), the last three with a log link
    label: str
    alpha: float = 0.0
    strength: float | None = None
    weight: str | None = None


@dataclass
class LinearScore:
    """Coefficients and intercept of a fitted model."""

    coefficients: np.ndarray
    intercept: float
    iterations: int = 0

    def margin(self, features: str = "features") -> Column:
        """The linear score of a vector column."""
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients])
        products = F.zip_with(vector_to_array(features), weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x)


def unit_terms(family: str, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its slope and its curvature in the linear score, per row."""
    if family == "logistic":
        p = 1 / (1 + np.exp(-eta))
        return np.logaddexp(0, eta) - y * eta, p - y, p * (1 - p)
    with np.errstate(over="ignore"):
        mu = np.exp(eta)
        if family == "poisson":
            return mu - y * eta, mu - y, mu
        if family == "gamma":
            ratio = y * np.exp(-eta)
            return ratio + eta, 1 - ratio, ratio
        if family == "tweedie":
            root, part = np.sqrt(mu), y * np.exp(-eta / 2)
            return 2 * (part + root), root - part, (part + root) / 2
    raise ValueError(f"unknown family {family}")


def packed(rows: DataFrame, columns: list[str], features: str = "features") -> DataFrame:
    """Blocks of rows: the matrix with a leading column of ones, and ``columns`` beside each other, as bytes."""
    def pack(batches):
        for batch in batches:
            lists = batch.column("x")
            width = len(lists[0]) if batch.num_rows else 1
            for low in range(0, batch.num_rows, max(1, BLOCK_VALUES // (width + 1))):
                part = batch.slice(low, max(1, BLOCK_VALUES // (width + 1)))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                rest = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
                held = [np.c_[np.ones(len(x)), x].tobytes(), rest.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64()), *[pa.array([b], pa.binary()) for b in held]], names=["n", "x", "rest"])

    wide = rows.select(vector_to_array(features).alias("x"), *[F.col(c).cast("double").alias(c) for c in columns])
    return materialise(wide.mapInArrow(pack, "n long, x binary, rest binary"), "glm-blocks", LARGE_ROWS)


def summed(blocks: DataFrame, function) -> np.ndarray:
    """The sum of ``function(matrix, columns)`` over all blocks, added up on executors where there are many tasks."""
    def add(rows):
        total = None
        for n, x, rest in rows:
            part = function(np.frombuffer(x).reshape(n, -1), np.frombuffer(rest).reshape(-1, n))
            total = part if total is None else total + part
        if total is not None:
            yield total

    # A row is a block of megabytes: an Arrow batch would hold all blocks of a task, rows come one by one.
    parts = blocks.rdd.mapPartitions(add)
    if parts.getNumPartitions() > 64:
        return parts.treeReduce(np.add)
    return np.sum(parts.collect(), axis=0)  # one array per task


def fit_glms(rows: DataFrame, problems: list[Problem], features: str = "features", tolerance: float = 1e-11, most: int = 60) -> list[LinearScore]:
    """Fit all ``problems`` over ``rows`` together."""
    columns = list(dict.fromkeys(c for p in problems for c in (p.label, p.weight) if c))
    blocks = packed(rows, columns, features)
    places = [(columns.index(p.label), columns.index(p.weight) if p.weight else None) for p in problems]

    def chosen(k: int, rest: np.ndarray):
        """Label and weight of the rows of a problem, and which rows these are."""
        label, weight = places[k]
        held = ~np.isnan(rest[label])
        return rest[label][held], np.ones(held.sum()) if weight is None else rest[weight][held], held

    def totals(x, rest):
        return np.array([v for k in range(len(problems)) for y, w, _ in [chosen(k, rest)] for v in (w.sum(), (w * y).sum(), x.shape[1])])

    if blocks.isEmpty():
        raise ValueError("no training rows")
    n_blocks = blocks.count()
    first = summed(blocks, totals).reshape(-1, 3)
    width = round(first[0, 2] / n_blocks)
    if (first[:, 0] <= 0).any():
        raise ValueError("no training rows")
    weights, means = first[:, 0], first[:, 1] / first[:, 0]
    penalties = []
    for p, w in zip(problems, weights):
        ridge = np.full(width, p.alpha if p.strength is None else 1 / (p.strength * w))
        ridge[0] = 0.0
        penalties.append(ridge)
    x = []
    for p, mean in zip(problems, means):
        if p.family != "logistic" and mean <= 0:
            raise ValueError("a log link needs a positive mean")
        mean = min(max(mean, 1e-9), 1 - 1e-9) if p.family == "logistic" else mean
        x.append(np.r_[np.log(mean / (1 - mean)) if p.family == "logistic" else np.log(mean), np.zeros(width - 1)])

    def terms(open_: list[int], at: list[np.ndarray]):
        def of_block(matrix, rest):
            out = []
            for k in open_:
                y, w, held = chosen(k, rest)
                own = matrix if held.all() else matrix[held]
                loss, slope, curve = unit_terms(problems[k].family, y, own @ at[k])
                out += [[(w * loss).sum()], own.T @ (w * slope), ((own * (w * curve)[:, None]).T @ own).ravel()]
            return np.concatenate(out)

        found = summed(blocks, of_block).reshape(len(open_), -1)
        for k, row in zip(open_, found):
            row = row / weights[k]
            yield k, (row[0] + (penalties[k] * at[k] ** 2).sum() / 2, row[1:1 + width] + penalties[k] * at[k],
                      row[1 + width:].reshape(width, width) + np.diag(penalties[k]))

    count = len(problems)
    objective, direction, slope, length, trial, steps = [np.inf] * count, [None] * count, [0.0] * count, [1.0] * count, list(x), [0] * count
    open_ = list(range(count))
    for _ in range(most):
        for k, (value, gradient, curvature) in terms(open_, trial):
            steps[k] += 1
            good = np.isfinite(value) and np.isfinite(gradient).all() and np.isfinite(curvature).all()
            if direction[k] is not None and not (good and value <= objective[k] + 1e-4 * length[k] * slope[k] + 1e-14 * abs(objective[k])):
                length[k] /= 2
                if length[k] < 1e-10:
                    raise RuntimeError("no descent")
                trial[k] = x[k] + length[k] * direction[k]
                continue
            x[k], objective[k] = trial[k], value
            ridge = curvature + 1e-12 * max(1.0, np.trace(curvature) / width) * np.eye(width)
            direction[k] = -np.linalg.solve(ridge, gradient)
            slope[k], length[k] = float(gradient @ direction[k]), 1.0
            trial[k] = x[k] + direction[k]
        for k in [k for k in open_ if length[k] == 1.0 and -slope[k] < tolerance * max(1.0, abs(objective[k]))]:
            x[k] = trial[k]  # the last step is smaller than the tolerance asks for
            open_.remove(k)
        if not open_:
            return [LinearScore(b[1:].copy(), float(b[0]), s) for b, s in zip(x, steps)]
    raise RuntimeError(f"no convergence in {most} iterations")
