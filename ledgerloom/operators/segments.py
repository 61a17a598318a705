"""Customer segments: K-Means candidates, their quality, soft mixtures and profiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators import kmeans
from ledgerloom.operators.design import FittedDesign, segment_design
from ledgerloom.operators.ordering import exact_medians
from ledgerloom.scratch import materialise
from ledgerloom.settings import KEYS, SEED, SEGMENT_FEATURES

MIN_SHARE = 0.025


@dataclass
class SegmentSpace:
    """Logged, scaled inputs, optionally projected to the components that keep 90 % variance."""

    use_pca: bool
    variance: float = 0.9

    def fit(self, rows: DataFrame, features: list[str] = SEGMENT_FEATURES, fitted: FittedDesign | None = None) -> "SegmentSpace":
        """``fitted`` is the design of these rows and features, if another space has it already."""
        self.fitted: FittedDesign = fitted or segment_design(features).fit(rows)
        self.dimensions, self.explained = len(self.fitted.names), None
        if self.use_pca:
            wide = self.fitted.transform(rows.select(*KEYS, *features))
            self.pca = PCA(k=self.dimensions, inputCol="features", outputCol="_pc").fit(wide)
            shares = self.pca.explainedVariance.toArray()
            self.dimensions = int(np.searchsorted(np.cumsum(shares), self.variance - 1e-12) + 1)
            self.explained = shares[:self.dimensions]
        return self

    def transform(self, rows: DataFrame, output: str = "z") -> DataFrame:
        wide = self.fitted.transform(rows)
        if not self.use_pca:
            return wide.withColumnRenamed("features", output)
        projected = self.pca.transform(wide).drop("features")
        return VectorSlicer(inputCol="_pc", outputCol=output, indices=list(range(self.dimensions))).transform(
            projected).drop("_pc")


def best_kmeans(points: DataFrame, k: int, seed: int, restarts: int = 20, max_iter: int = 500) -> kmeans.Centres:
    """Restart with the lowest cost; all restarts run in the same passes."""
    runs = [kmeans.Run("z", k, seed, i) for i in range(restarts)]
    return min(kmeans.fit_grid(kmeans.as_arrays(points, {"z": "z"}), runs, max_iter), key=lambda m: m.cost)


def shares(labels: DataFrame, column: str = "segment") -> DataFrame:
    """Size and share of every label."""
    counts = labels.groupBy(column).agg(F.count(F.lit(1)).alias("customers")).withColumn("_one", F.lit(1))
    total = counts.groupBy("_one").agg(F.sum("customers").alias("_n"))  # one row
    return counts.join(F.broadcast(total), "_one").select(
        column, "customers", (F.col("customers") / F.col("_n")).alias("customer_share"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings, corrected for chance, from their contingency table."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    pairs = lambda n: n * (n - 1) / 2
    parts = [cells.agg(F.sum(pairs(F.col("c"))).alias("v"), F.sum("c").alias("n")).withColumn("part", F.lit("cells"))]
    for name in (a, b):
        margin = cells.groupBy(name).agg(F.sum("c").alias("c"))
        parts.append(margin.agg(F.sum(pairs(F.col("c"))).alias("v"), F.sum("c").alias("n")).withColumn("part", F.lit(name)))
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = lambda name: F.max(F.when(F.col("part") == name, F.col("v")))
    row = stacked.agg(of("cells").alias("i"), of(a).alias("x"), of(b).alias("y"), F.max("n").alias("n"))
    i, x, y = F.col("i"), F.col("x"), F.col("y")
    chance = F.when(F.col("n") > 1, x * y / pairs(F.col("n"))).otherwise(0.0)
    ceiling = (x + y) / 2
    return row.select(F.when(ceiling == chance, F.lit(1.0)).otherwise((i - chance) / (ceiling - chance))
                      .alias("adjusted_rand"))


def davies_bouldin(points: DataFrame, coordinates: list[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centre distance."""
    centres = points.groupBy(label).agg(*[F.avg(c).alias(f"_c_{c}") for c in coordinates])
    # One row per cluster.
    joined = points.join(F.broadcast(centres), label)
    distance = F.sqrt(sum(((F.col(c) - F.col(f"_c_{c}")) * (F.col(c) - F.col(f"_c_{c}")) for c in coordinates), F.lit(0.0)))
    clusters = joined.groupBy(label).agg(
        F.avg(distance).alias("spread"), F.first(F.array(*[F.col(f"_c_{c}") for c in coordinates])).alias("centre"))
    table = clusters.agg(F.collect_list(F.struct(F.col(label).alias("id"), "spread", "centre")).alias("cs"))

    def ratio(p: Column, q: Column) -> Column:
        apart = F.sqrt(F.aggregate(F.zip_with(p["centre"], q["centre"], lambda u, v: (u - v) * (u - v)),
                                   F.lit(0.0), lambda acc, v: acc + v))
        return (p["spread"] + q["spread"]) / apart

    worst = F.transform("cs", lambda p: F.array_max(F.transform(
        F.filter("cs", lambda q: q["id"] != p["id"]), lambda q: ratio(p, q))))
    return table.select((F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + v) / F.size("cs")).alias("davies_bouldin"))


def silhouette(points: DataFrame, label: str = "segment") -> float:
    """Mean silhouette of all rows, with squared Euclidean distances.

    With those, a row's mean distance to a cluster follows from the cluster's size, sum and squared
    norm, so two passes over the rows suffice and no pairs are formed.
    """
    return float(ClusteringEvaluator(featuresCol="z", predictionCol=label).evaluate(points))


def kmeans_candidates(train: DataFrame, sizes: range | list[int] = range(2, 9), seeds: list[int] | None = None,
                      spaces: tuple[bool, ...] = (True, False), restarts: int = 20) -> tuple[DataFrame, dict]:
    """Grid over projections, cluster counts and seeds; returns the table and the fitted models.

    All runs of the grid share their passes over the rows, and so do the measures of the best
    restarts. The model of a size is that of the first seed.
    """
    spark = train.sparkSession
    sizes, seeds = list(sizes), seeds or [SEED, SEED + 1, SEED + 2]
    design = segment_design(SEGMENT_FEATURES).fit(train)
    fitted = {f"z{int(use_pca)}": SegmentSpace(use_pca).fit(train, fitted=design) for use_pca in spaces}
    placed = train
    for name, space in fitted.items():
        placed = space.transform(placed, name)
    points = kmeans.as_arrays(placed.select(*KEYS, *fitted), {name: name for name in fitted})
    runs = [kmeans.Run(name, k, seed, i) for name in fitted for k in sizes for seed in seeds for i in range(restarts)]
    found = kmeans.fit_grid(points, runs)
    at = range(0, len(runs), restarts)
    best = [min(range(low, low + restarts), key=lambda i: found[i].cost) for low in at]
    runs, found = [runs[i] for i in best], [found[i] for i in best]
    measured = kmeans.qualities(points, runs, found)
    first = range(0, len(runs), len(seeds))
    agreed = kmeans.agreements(points, runs, found, [(low, low + i) for low in first for i in range(1, len(seeds))])
    rows, models = [], {}
    mean = lambda v: float(np.mean(v)) if v else None
    for n, low in enumerate(first):
        run, space = runs[low], fitted[runs[low].space]
        per_seed = measured[low:low + len(seeds)]
        smallest = [float((q.sizes / q.sizes.sum()).min()) if len(q.sizes) == run.k else 0.0 for q in per_seed]
        usable = [q for q, share in zip(per_seed, smallest) if share >= MIN_SHARE]
        stability = agreed[n * (len(seeds) - 1):(n + 1) * (len(seeds) - 1)]
        name = "kmeans_pca" if space.use_pca else "kmeans_no_pca"
        rows.append((name, run.k, space.use_pca, space.dimensions, mean([q.silhouette for q in usable]), per_seed[0].silhouette,
                     mean([q.davies_bouldin for q in usable]), mean(stability), min(smallest), min(smallest) >= MIN_SHARE))
        models[(name, run.k)] = (space, found[low])
    table = spark.createDataFrame(
        rows, "model string, k int, pca boolean, pca_components int, mean_silhouette double, squared_silhouette double, "
        "mean_davies_bouldin double, mean_seed_ari double, minimum_segment_share double, eligible boolean")
    return table, models


def choose_segments(candidates: DataFrame) -> DataFrame:
    """Largest mean silhouette + 0.10 x stability among eligible candidates."""
    score = F.col("mean_silhouette") + 0.10 * F.coalesce("mean_seed_ari", F.lit(0.0))
    return candidates.filter("eligible").withColumn("selection_score", score).orderBy(
        F.col("selection_score").desc(), F.col("pca").desc(), "k").limit(1)


# --- Diagonal Gaussian mixture ------------------------------------------------------------


def _log_densities(z: np.ndarray, weights, means, variances) -> np.ndarray:
    spread = ((z[:, None, :] - means[None]) ** 2 / variances[None]).sum(axis=2)
    return np.log(weights) - 0.5 * (spread + np.log(2 * np.pi * variances).sum(axis=1))


@dataclass
class DiagonalMixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float = float("nan")
    iterations: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def bic(self, n: int) -> float:
        d = self.means.shape[1]
        return -2 * self.log_likelihood + (2 * self.k * d + self.k - 1) * float(np.log(n))

    def assign(self, points: DataFrame) -> DataFrame:
        """Most likely component and its membership probability."""
        weights, means, variances = self.weights, self.means, self.variances

        @F.pandas_udf("struct<segment int, membership double>")
        def member(z: pd.Series) -> pd.DataFrame:
            logs = _log_densities(np.array(z.tolist()), weights, means, variances)
            logs = np.exp(logs - logs.max(axis=1, keepdims=True))
            share = logs / logs.sum(axis=1, keepdims=True)
            return pd.DataFrame(dict(segment=share.argmax(axis=1).astype("int32"), membership=share.max(axis=1)))

        return (points.withColumn("_m", member(vector_to_array("z")))
                .withColumn("gmm_segment", F.col("_m.segment")).withColumn("gmm_max_membership", F.col("_m.membership"))
                .drop("_m"))


def fit_mixtures(points: DataFrame, sizes: range | list[int] = range(2, 7), starts: int = 2, floor: float = 1e-3,
                 max_iter: int = 500, tolerance: float = 1e-3, seed: int = SEED) -> list[DiagonalMixture]:
    """Expectation-maximisation for all sizes and starts together: one pass per iteration.

    Starts come from K-Means clusters, fitted together as well. A pass returns only sums per component.
    """
    stored = kmeans.as_arrays(points, {"z": "z"})
    n = stored.count()
    runs = [kmeans.Run("z", k, seed + s) for k in sizes for s in range(starts)]
    models = []
    for size, first, second in kmeans.moments(stored, runs, kmeans.fit_grid(stored, runs, 50)):
        used = size > 0
        size, first, second = size[used], first[used], second[used]
        means = first / size[:, None]
        models.append(DiagonalMixture(size / n, means, np.maximum(second / size[:, None] - means ** 2, 0) + floor))
    live = list(range(len(models)))
    for step in range(max_iter):
        if not live:
            break
        current = [(models[i].weights, models[i].means, models[i].variances) for i in live]
        offsets = np.concatenate([[0], np.cumsum([1 + len(w) + 2 * m.size for w, m, _ in current])])

        def sums(blocks, hashes, current=current):
            z, parts = blocks["z"], []
            for w, m, v in current:
                logs = _log_densities(z, w, m, v)
                top = logs.max(axis=1, keepdims=True)
                norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
                share = np.exp(logs - norm[:, None])
                parts += [[norm.sum()], share.sum(axis=0), (share.T @ z).ravel(), (share.T @ z ** 2).ravel()]
            return np.concatenate(parts)

        width = max(m.size for _, m, _ in current)
        total = kmeans.summed(stored, ["z"], width, int(offsets[-1]), sums)
        found = {i: total[offsets[k]:offsets[k + 1]] for k, i in enumerate(live)}
        still = []
        for i in live:
            model = models[i]
            values = found[i]
            k, d = model.means.shape
            size = values[1:1 + k]
            first = values[1 + k:1 + k + k * d].reshape(k, d)
            second = values[1 + k + k * d:].reshape(k, d)
            gain = values[0] / n - (model.log_likelihood / n if np.isfinite(model.log_likelihood) else -np.inf)
            means = first / size[:, None]
            models[i] = DiagonalMixture(size / n, means, np.maximum(second / size[:, None] - means ** 2, 0) + floor,
                                        float(values[0]), step + 1, bool(abs(gain) < tolerance))
            if not models[i].converged:
                still.append(i)
        live = still
    best = []
    for at in range(0, len(models), starts):
        best.append(max(models[at:at + starts], key=lambda m: m.log_likelihood))
    return best


def mixture_table(spark, mixtures: list[DiagonalMixture], n: int) -> DataFrame:
    return spark.createDataFrame([(m.k, float(m.bic(n)), m.converged, m.iterations) for m in mixtures],
                                 "k int, bic double, converged boolean, iterations int")


# --- Profiles -----------------------------------------------------------------------------


def segment_profiles(labelled: DataFrame, features: list[str] = SEGMENT_FEATURES, label: str = "segment") -> DataFrame:
    """Size, share and feature medians per segment."""
    medians = exact_medians(labelled, features, [label], "_median")
    return shares(labelled.select(label), label).join(medians, label)


def profile_index(labelled: DataFrame, features: list[str] = SEGMENT_FEATURES, label: str = "segment") -> DataFrame:
    """Segment medians relative to the population median, for features whose median is positive."""
    stored = materialise(labelled.select(label, *features), "profiles")
    population = exact_medians(stored, features).first()  # one row
    usable = [c for c in features if population[c] is not None and population[c] > 0]
    medians = exact_medians(stored, usable, [label])
    return medians.select(label, *[(F.col(c) / F.lit(float(population[c]))).alias(c) for c in usable])


def holdout_outcomes(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Later outcomes of the assigned segments, for both labelings in one pass."""
    joined = assignments.join(
        labels.filter("label_mature").select(*KEYS, "inactive", "future_revenue_gbp"), KEYS)
    long = joined.unpivot([*KEYS, "inactive", "future_revenue_gbp"], ["kmeans_segment", "gmm_segment"], "method", "segment")
    long = long.withColumn("method", F.regexp_replace("method", "_segment$", ""))
    keys = ["method", "segment"]
    sums = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("inactive").alias("inactivity_rate"),
        F.avg("future_revenue_gbp").alias("mean_future_revenue_gbp"),
        F.sum("future_revenue_gbp").alias("total_future_revenue_gbp"))
    medians = exact_medians(long, ["future_revenue_gbp"], keys).withColumnRenamed(
        "future_revenue_gbp", "median_future_revenue_gbp")
    return sums.join(medians, keys)


def projection(space: SegmentSpace, model, mixture_space: SegmentSpace, mixture: DiagonalMixture,
               snapshots: dict[str, DataFrame]) -> DataFrame:
    """First two coordinates and both labels of several snapshots."""
    out = None
    for role, rows in snapshots.items():
        z = model.transform(space.transform(rows)).withColumn("_z", vector_to_array("z")).select(
            *KEYS, F.lit(role).alias("snapshot_role"), F.col("_z")[0].alias("pc1"), F.col("_z")[1].alias("pc2"),
            F.col("segment").cast("int").alias("kmeans_segment"))
        soft = mixture.assign(mixture_space.transform(rows)).select(*KEYS, "gmm_segment", "gmm_max_membership")
        part = z.join(soft, KEYS)
        out = part if out is None else out.unionByName(part)
    return out
