"""Boosted trees for revenue: Tweedie, gamma and Poisson on the log scale, and a hurdle of two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import sigmoid
from ledgerloom.operators.design import Design, FittedDesign
from ledgerloom.operators.histogram_trees import HistogramTrees, side_by_side
from ledgerloom.operators.models import _inputs
from ledgerloom.settings import KEYS, SEED


@dataclass
class LogLinkBoosting:
    """Newton boosting on the log scale: leaf values are -Σg / (Σh + penalty)."""

    design: Design
    loss: str = "tweedie"
    rounds: int = 240
    depth: int = 3
    step: float = 0.035
    penalty: float = 10.0
    min_rows: int = 20
    row_share: float = 0.82
    column_share: float = 1.0
    seed: int = SEED

    def fit(self, rows: DataFrame, label: str = "future_revenue_gbp", fitted: FittedDesign | None = None) -> "LogLinkBoosting":
        """``fitted`` is the design of these rows, if another model has it already."""
        self.fitted = fitted or self.design.fit(rows)
        inputs = [c for c in _inputs(rows) if c not in KEYS]
        train = self.fitted.transform(rows.select(*KEYS, *inputs, F.col(label).cast("double").alias("_y")))
        if self.loss == "gamma":
            train = train.filter("_y > 0")
        self.trees = HistogramTrees(self.loss, self.rounds, self.depth, self.step, self.penalty, self.min_rows,
                                    row_share=self.row_share, column_share=self.column_share, seed=self.seed)
        self.trees.fit(train, "_y", F.struct(*KEYS))
        return self

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        scored = self.trees.margin(self.fitted.transform(rows), "_f")
        return scored.withColumn(output, F.exp("_f")).drop("_f", "features")


@dataclass
class BoostedHurdle:
    """Boosted propensity times boosted gamma amount."""

    design: Design
    trees: int = 180
    depth: int = 4
    step: float = 0.045
    min_rows: int = 40
    penalty: float = 10.0
    seed: int = SEED

    def fit(self, rows: DataFrame, label: str = "future_revenue_gbp") -> "BoostedHurdle":
        self.fitted = self.design.fit(rows)
        inputs = [c for c in _inputs(rows) if c not in KEYS]
        train = self.fitted.transform(rows.select(*KEYS, *inputs, (F.col(label) > 0).cast("double").alias("_any")))
        self.propensity = HistogramTrees("logistic", self.trees, self.depth, self.step, self.penalty, self.min_rows, seed=self.seed)
        self.amount = LogLinkBoosting(self.design, "gamma", self.trees, self.depth, self.step, self.penalty,
                                      self.min_rows, row_share=1.0, seed=self.seed)
        # Fits are many short jobs, between which cores would wait for the driver: the two run side by side.
        side_by_side(lambda: self.propensity.fit(train, "_any", F.struct(*KEYS)), lambda: self.amount.fit(rows, label, self.fitted))
        return self

    def predict(self, rows: DataFrame, output: str = "predicted") -> DataFrame:
        scored = self.propensity.margin(self.fitted.transform(self.amount.predict(rows, "_amount")), "_f")
        return scored.withColumn(output, sigmoid(F.col("_f")) * F.col("_amount")).drop("_amount", "_f", "features")
