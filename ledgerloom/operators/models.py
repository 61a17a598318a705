"""Inactivity and revenue models as Spark ML jobs.

Every model has ``fit(rows, label)`` and ``predict(rows, output)``; predictions are columns on
the scored rows. Training rows should come from ``available_training``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import clip, logit, mixture_quantile, normal_quantile, sigmoid
from ledgerloom.operators.design import Design, FittedDesign, scaled_sequence, sequence_scaling
from ledgerloom.operators.glm import LinearScore, Problem, fit_glms
from ledgerloom.operators.histogram_trees import HistogramTrees, side_by_side
from ledgerloom.operators.ordering import exact_medians
from ledgerloom.operators.targets import person_periods
from ledgerloom.scratch import materialise
from ledgerloom.settings import HAZARD_PERIODS, KEYS, SEED, WEEK_CHANNELS

TEMPORARY = ["features", "rawPrediction", "probability", "prediction"]


def positive_probability(df: DataFrame, output: str, column: str = "probability") -> DataFrame:
    return df.withColumn(output, vector_to_array(column)[1]).drop(*[c for c in TEMPORARY if c != output])


def logistic(rows: DataFrame, label: str, strength: float) -> LinearScore:
    """L2 logistic regression with inverse penalty ``strength`` over the vectors in ``features``."""
    return fit_glms(rows, [Problem("logistic", label, strength=strength)])[0]


class Prevalence:
    """Training mean of the label for everybody."""

    def fit(self, rows: DataFrame, label: str = "inactive") -> "Prevalence":
        self.probability = float(rows.agg(F.avg(label)).first()[0])
        return self

    def predict(self, rows: DataFrame, output: str = "p") -> DataFrame:
        return rows.withColumn(output, F.lit(self.probability))


@dataclass
class LogisticModel:
    """Design plus L2 logistic regression: recency only, full, or additive splines."""

    design: Design
    strength: float

    def fit(self, rows: DataFrame, label: str = "inactive") -> "LogisticModel":
        self.fitted: FittedDesign = self.design.fit(rows)
        self.model = logistic(self.fitted.transform(rows.select(*_inputs(rows), F.col(label).cast("double").alias(label))), label, self.strength)
        return self

    def predict(self, rows: DataFrame, output: str = "p") -> DataFrame:
        return self.fitted.transform(rows).withColumn(output, sigmoid(self.model.margin())).drop("features")


def _inputs(rows: DataFrame) -> list[str]:
    """Columns a design may read: everything but identifiers and labels."""
    skip = {"first_purchase", "last_purchase", "future_invoice_count", "future_revenue_gbp", "first_future_purchase",
            "future_purchase_days", "returned", "inactive", "label_mature", "horizon_end_exclusive"}
    return [c for c in rows.columns if c not in skip]


@dataclass
class TreeClassifier:
    """Random forest or boosted trees for a 0/1 label."""

    design: Design
    kind: str = "forest"
    trees: int = 240
    depth: int = 10
    min_rows: int = 18
    step: float = 0.04
    columns_per_split: str = "0.8"
    row_share: float = 1.0
    penalty: float = 8.0        # of boosted leaves
    min_weight: float = 0.0     # curvature that a boosted leaf needs
    seed: int = SEED

    def fit(self, rows: DataFrame, label: str = "inactive") -> "TreeClassifier":
        self.fitted = self.design.fit(rows)
        inputs = [c for c in _inputs(rows) if c not in KEYS]
        train = self.fitted.transform(rows.select(*KEYS, *inputs, F.col(label).cast("double").alias(label)))
        if self.kind != "forest":  # these store what they read themselves
            self.model = HistogramTrees("logistic", self.trees, self.depth, self.step, self.penalty, self.min_rows, self.min_weight,
                                        self.row_share, float(self.columns_per_split), seed=self.seed).fit(train, label, F.struct(*KEYS))
            return self
        train = train.select("features", label).persist()
        try:
            self.model = RandomForestClassifier(
                featuresCol="features", labelCol=label, numTrees=self.trees, maxDepth=self.depth,
                minInstancesPerNode=self.min_rows, featureSubsetStrategy=self.columns_per_split, seed=self.seed).fit(train)
        finally:
            train.unpersist()
        return self

    def predict(self, rows: DataFrame, output: str = "p") -> DataFrame:
        wide = self.fitted.transform(rows)
        if self.kind == "forest":
            return positive_probability(self.model.transform(wide), output)
        return self.model.margin(wide, "_f").withColumn(output, sigmoid(F.col("_f"))).drop("_f", "features")


@dataclass
class PurchaseHazard:
    """Weekly conditional return hazards pooled into the risk of no return within the horizon."""

    design: Design
    strength: float = 0.2
    periods: int = HAZARD_PERIODS

    def fit(self, rows: DataFrame) -> "PurchaseHazard":
        self.fitted = self.design.fit(rows)
        labels = ["cutoff", "returned", "first_future_purchase"]
        inputs = rows.select(*dict.fromkeys(_inputs(rows) + labels))
        exposed = person_periods(self.fitted.transform(inputs, "static").select("static", *labels), self.periods)
        flags = F.transform(F.sequence(F.lit(0), F.lit(self.periods - 1)),
                            lambda i: (i == F.col("period")).cast("double"))
        train = (VectorAssembler(inputCols=["static", "flags"], outputCol="features")
                 .transform(exposed.withColumn("flags", array_to_vector(flags)))
                 .select("features", F.col("event").cast("double").alias("event")))
        self.model = logistic(train, "event", self.strength)
        return self

    def predict(self, rows: DataFrame, output: str = "p") -> DataFrame:
        """Product of the survivals of all periods: the period only shifts the margin, so no
        expansion of the rows is needed."""
        size = len(self.fitted.names)
        static = LinearScore(self.model.coefficients[:size], self.model.intercept)
        shifts = F.array(*[F.lit(float(w)) for w in self.model.coefficients[size:]])
        scored = self.fitted.transform(rows, "static").withColumn("_margin", static.margin("static"))
        survival = F.aggregate(shifts, F.lit(1.0), lambda acc, s: acc * (1 - sigmoid(F.col("_margin") + s)))
        return scored.withColumn(output, clip(survival, 0.0, 1.0)).drop("_margin", "static")


class Platt:
    """One-feature logistic calibration of the logit of a probability."""

    def fit(self, rows: DataFrame, probability: str = "p", label: str = "inactive") -> "Platt":
        train = rows.select(array_to_vector(F.array(logit(F.col(probability)))).alias("features"),
                            F.col(label).cast("double").alias(label))
        model = logistic(train, label, 1.0)
        self.slope, self.intercept = float(model.coefficients[0]), float(model.intercept)
        return self

    def predict(self, rows: DataFrame, probability: str = "p", output: str = "p") -> DataFrame:
        return rows.withColumn(output, sigmoid(self.slope * logit(F.col(probability)) + self.intercept))


@dataclass
class WeeklyNetwork:
    """Feed-forward network on the flattened weekly sequence and the static design."""

    design: Design
    hidden: int = 48
    iterations: int = 100
    seed: int = SEED

    def _features(self, rows: DataFrame) -> DataFrame:
        flat = array_to_vector(scaled_sequence(WEEK_CHANNELS, self.scaling))
        wide = self.fitted.transform(rows, "static").withColumn("sequence", flat)
        return VectorAssembler(inputCols=["sequence", "static"], outputCol="features").transform(wide).drop("sequence", "static")

    def prepare(self, rows: DataFrame, label: str = "inactive") -> DataFrame:
        """The training rows as the network takes them, by the design and scaling found in them."""
        self.fitted = self.design.fit(rows)
        self.scaling = sequence_scaling(rows, WEEK_CHANNELS)
        return self._features(rows).select("features", F.col(label).cast("double").alias(label))

    def fit(self, rows: DataFrame, label: str = "inactive") -> "WeeklyNetwork":
        train = self.prepare(rows, label).persist()
        try:
            return self.fit_prepared(train, label)
        finally:
            train.unpersist()

    def fit_prepared(self, train: DataFrame, label: str = "inactive") -> "WeeklyNetwork":
        """Fit on cached rows of :meth:`prepare`."""
        size = 26 * len(WEEK_CHANNELS) + len(self.fitted.names)
        self.model = MultilayerPerceptronClassifier(
            featuresCol="features", labelCol=label, layers=[size, self.hidden, 2], maxIter=self.iterations, seed=self.seed).fit(train)
        return self

    def predict(self, rows: DataFrame, output: str = "p") -> DataFrame:
        return positive_probability(self.model.transform(self._features(rows)), output)


def seed_ensemble(make, seeds: list[int], train: DataFrame, rows: DataFrame, output: str = "p") -> DataFrame:
    """Mean probability of networks that differ only in their seed; they share the design and the prepared rows."""
    out, networks = rows, [make(seed) for seed in seeds]
    ready = networks[0].prepare(train).persist()
    try:
        for network in networks:
            network.fitted, network.scaling = networks[0].fitted, networks[0].scaling
            network.fit_prepared(ready)
    finally:
        ready.unpersist()
    for i, network in enumerate(networks):
        out = network.predict(out, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(len(seeds))), F.lit(0.0)) / len(seeds)
    return out.withColumn(output, mean).drop(*[f"_p{i}" for i in range(len(seeds))])


# --- Revenue ---------------------------------------------------------------------------


def revenue_baselines(train: DataFrame, rows: DataFrame, horizon_days: int, window: int,
                      label: str = "future_revenue_gbp") -> DataFrame:
    """Training mean and median, lifetime run rate and recent spend, one column each."""
    mean = float(train.agg(F.avg(label)).first()[0])
    median = float(exact_medians(train, [label]).first()[label])
    return rows.withColumns({
        "training_mean_baseline": F.lit(mean), "training_median_baseline": F.lit(median),
        "historical_spend_rate_baseline":
            F.col("lifetime_revenue_gbp") / F.greatest(F.col("history_days"), F.lit(1.0)) * horizon_days,
        f"recent_{window}d_spend_baseline": recent_spend(window, horizon_days)})


def recent_spend(window: int, horizon_days: int | Column) -> Column:
    return F.col(f"spend_{window}d_gbp") * (horizon_days / F.lit(float(window)))


@dataclass
class RevenueGlm:
    """``tweedie``; ``hurdle`` (propensity x gamma); or ``frequency_severity`` (count x value).

    The parts of a model are fitted in the same passes over the rows.
    """

    design: Design
    kind: str = "tweedie"
    alpha: float = 1.0
    strength: float = 0.3

    def problems(self) -> list[Problem]:
        if self.kind == "tweedie":
            return [Problem("tweedie", "_y", self.alpha)]
        if self.kind == "hurdle":
            return [Problem("gamma", "_positive", self.alpha), Problem("logistic", "_any", strength=self.strength)]
        if self.kind == "frequency_severity":
            return [Problem("gamma", "_value", self.alpha, weight="_n"), Problem("poisson", "_n", self.alpha)]
        raise ValueError(f"unknown kind {self.kind}")

    def fit(self, rows: DataFrame, label: str = "future_revenue_gbp") -> "RevenueGlm":
        self.fitted = self.design.fit(rows)
        target, count = F.greatest(F.col(label).cast("double"), F.lit(0.0)), F.col("future_invoice_count").cast("double")
        train = self.fitted.transform(rows.select(
            *_inputs(rows), target.alias("_y"), count.alias("_n"), (target > 0).cast("double").alias("_any"),
            F.when(target > 0, target).alias("_positive"), F.when(target > 0, target / count).alias("_value")))
        scores = fit_glms(train, self.problems())
        self.amount, self.rate = scores[0], scores[-1]
        return self

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        scored = self.fitted.transform(rows)
        amount = F.exp(self.amount.margin())
        if self.kind == "hurdle":
            amount = amount * sigmoid(self.rate.margin())
        elif self.kind == "frequency_severity":
            amount = amount * F.exp(self.rate.margin())
        return scored.withColumn(output, amount).drop("features")


def _score(model, rows: DataFrame, output: str) -> DataFrame:
    return model.transform(rows).withColumnRenamed("prediction", output)


@dataclass
class TreeRegressor:
    """Random forest, or boosted trees on squared or absolute error."""

    design: Design
    kind: str = "forest"
    trees: int = 220
    depth: int = 10
    min_rows: int = 18
    step: float = 0.045
    penalty: float = 10.0       # of boosted leaves
    seed: int = SEED

    def fit(self, rows: DataFrame, label: str = "future_revenue_gbp") -> "TreeRegressor":
        self.fitted = self.design.fit(rows)
        inputs = [c for c in _inputs(rows) if c not in KEYS]
        train = self.fitted.transform(rows.select(*KEYS, *inputs, F.col(label).cast("double").alias("_y")))
        if self.kind != "forest":
            self.model = HistogramTrees(self.kind, self.trees, self.depth, self.step, self.penalty, self.min_rows, seed=self.seed).fit(
                train, "_y", F.struct(*KEYS))
            return self
        train = train.select("features", "_y").persist()
        try:
            self.model = RandomForestRegressor(featuresCol="features", labelCol="_y", maxDepth=self.depth, minInstancesPerNode=self.min_rows,
                                               seed=self.seed, numTrees=self.trees, featureSubsetStrategy="0.8").fit(train)
        finally:
            train.unpersist()
        return self

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        wide = self.fitted.transform(rows)
        scored = _score(self.model, wide, "_y") if self.kind == "forest" else self.model.margin(wide, "_y")
        return scored.withColumn(output, F.greatest("_y", F.lit(0.0))).drop("_y", "features")


@dataclass
class LogNormalHurdle:
    """Boosted propensity with a log-normal positive amount: mean, variance and 90 % interval."""

    design: Design
    trees: int = 60
    depth: int = 3
    min_rows: int = 25
    step: float = 0.05
    penalty: float = 1.0
    money_scale: float = 1000.0
    seed: int = SEED

    def fit(self, rows: DataFrame, label: str = "future_revenue_gbp") -> "LogNormalHurdle":
        self.fitted = self.design.fit(rows)
        y, key = F.col(label).cast("double"), F.struct(*KEYS)
        inputs = [c for c in _inputs(rows) if c not in KEYS]
        train = self.fitted.transform(rows.select(
            *KEYS, *inputs, (y > 0).cast("double").alias("_any"),
            F.when(y > 0, F.log(y / self.money_scale)).alias("_log"))).select(*KEYS, "features", "_any", "_log")

        def trees(loss: str) -> HistogramTrees:
            return HistogramTrees(loss, self.trees, self.depth, self.step, self.penalty, self.min_rows, seed=self.seed)

        def amount() -> None:
            positive = train.filter("_any = 1")
            self.location = trees("squared").fit(positive, "_log", key)
            residual = self.location.margin(positive, "_mu").withColumn("_r2", F.pow(F.col("_log") - F.col("_mu"), 2))
            self.spread = trees("squared").fit(residual, "_r2", key)

        self.propensity = trees("logistic")
        side_by_side(lambda: self.propensity.fit(train, "_any", key), amount)  # each stores the rows it reads
        return self

    def predict(self, rows: DataFrame, output: str = "predicted", level: float = 0.90) -> DataFrame:
        """Mean with ``lower`` and ``upper``; the arithmetic mean, not the exponent of the log mean."""
        scored = self.spread.margin(self.location.margin(self.propensity.margin(self.fitted.transform(rows), "_p"), "_mu"), "_var")
        scored = scored.withColumn("_p", sigmoid(F.col("_p")))
        variance = clip(F.col("_var"), 1e-4, 4.9)
        mu, sigma = F.col("_mu"), F.sqrt(variance)
        tail = (1 - level) / 2

        def quantile(q: Column) -> Column:
            return F.exp(mu + sigma * normal_quantile(q)) * self.money_scale

        return scored.withColumns({
            output: F.col("_p") * F.exp(mu + variance / 2) * self.money_scale,
            "lower": mixture_quantile(F.col("_p"), quantile, tail),
            "upper": mixture_quantile(F.col("_p"), quantile, 1 - tail),
        }).drop("_mu", "_var", "_p", *[c for c in TEMPORARY if c != output])


def split_by_cutoff(labelled: DataFrame, splits: dict[str, list[date]]) -> dict[str, DataFrame]:
    """Mature rows of each named split; every split must have rows."""
    mature = labelled.filter("label_mature")
    present = {r[0] for r in mature.select("cutoff").distinct().collect()}  # one row per cutoff
    for name, cutoffs in splits.items():
        if not set(cutoffs) & present:
            raise ValueError(f"no mature rows for split {name}")
    return {name: mature.filter(F.col("cutoff").isin(cutoffs)) for name, cutoffs in splits.items()}


def rolling_origins(labelled: DataFrame, origins: list[date], candidates: dict, horizon: str,
                    runs=None, failure: str = "failed") -> tuple[DataFrame, DataFrame]:
    """Fit every candidate at every origin on available outcomes and score the origin's cohort.

    ``candidates`` maps a name to ``f(train, cohort) -> rows with customer_id, cutoff, predicted``, or to
    None where its library is missing. Returns predictions and a status row per (model, origin): completed,
    unavailable (no such candidate, or nothing to learn from or to score) or ``failure`` (an error or unusable
    predictions; "refit_failed" for the last refits); the others go on. With ``runs``, a
    :class:`ledgerloom.sources.runs.RunStore`, predictions and receipts are stored run by run and completed
    runs are not fitted again. The candidates of an origin are fitted side by side.
    """
    from ledgerloom.operators.metrics import prediction_violations
    from ledgerloom.operators.targets import available_training, scoring_cohort

    spark = labelled.sparkSession
    wanted = [(name, horizon, origin) for origin in origins for name in candidates]
    open_ = runs.open_runs(spark, wanted) if runs else set(wanted)
    predictions, statuses = None, []
    for origin in origins:
        todo = [name for name in candidates if (name, horizon, origin) in open_]
        if not todo:
            continue
        train, cohort = available_training(labelled, origin), scoring_cohort(labelled, origin)
        empty = train.isEmpty() or cohort.isEmpty()

        def outcome(name, train=train, cohort=cohort, empty=empty):
            """Predictions of a candidate, its status and its error."""
            if candidates[name] is None or empty:
                return None, "unavailable", "no such candidate" if candidates[name] is None else "no available training rows or no cohort"
            try:
                scored = materialise(candidates[name](train, cohort).select(
                    "customer_id", "cutoff", F.col("predicted").cast("double").alias("predicted")), "predictions")
                bad = {k: v for k, v in prediction_violations(scored, cohort).first().asDict().items() if v}
                if bad:
                    raise ValueError(f"unusable predictions: {bad}")
                return (scored.withColumn("predicted", clip(F.col("predicted"), 0.0))
                        .join(cohort.select("customer_id", "cutoff", F.col("future_revenue_gbp").alias("actual"),
                                            "horizon_end_exclusive"), ["customer_id", "cutoff"])
                        .select(F.lit(name).alias("model"), F.lit(horizon).alias("horizon"), "*")), "completed", None
            except Exception as problem:  # recorded, not hidden
                return None, failure, f"{type(problem).__name__}: {problem}"[:300]

        # Fits are many short jobs, between which cores would wait for the driver; what is found is stored in turn.
        with ThreadPoolExecutor(len(todo)) as pool:
            found = [pool.submit(outcome, name) for name in todo]
            for name, ran in zip(todo, found):
                keyed, status, error = ran.result()
                try:
                    if keyed is not None and runs:
                        runs.write(keyed)
                    elif keyed is not None:
                        predictions = keyed if predictions is None else predictions.unionByName(keyed)
                except Exception as problem:  # recorded, not hidden
                    status, error = failure, f"{type(problem).__name__}: {problem}"[:300]
                if runs:
                    runs.receipt(spark, (name, horizon, origin), status, error)
                statuses.append((name, horizon, origin, status, error))
    if runs:
        return runs.predictions(spark, wanted), runs.statuses(spark, wanted)
    table = spark.createDataFrame(statuses, "model string, horizon string, cutoff date, status string, error string")
    if predictions is None:
        raise RuntimeError(f"no candidate completed: {statuses}")
    return predictions, table
