"""Predictions and receipts of a rolling comparison, so that a killed run goes on where it stopped."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.selection import missing_runs
from ledgerloom.scratch import materialise

RECEIPT = "model string, horizon string, origin date, signature string, status string, error string"
STORED = "customer_id bigint, cutoff date, predicted double, actual double, horizon_end_exclusive date, horizon string, model string, origin date"


@dataclass(frozen=True)
class RunStore:
    """Predictions under ``path``/predictions, one folder per horizon, model and origin; receipts beside them.

    A run's predictions replace its folder (a repeated or half-written run leaves one copy), its receipt is
    added after them. ``signature`` names the source: runs of another source do not count as done.
    """

    path: str
    signature: str

    def receipts(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(RECEIPT).parquet(f"{self.path}/receipts")
        except AnalysisException:  # no run has been stored yet
            return spark.createDataFrame([], RECEIPT)

    def open_runs(self, spark: SparkSession, runs: list[tuple]) -> set[tuple]:
        """Those (model, horizon, origin) that are not stored as completed for this source."""
        unusable = sorted({x for model, horizon, _ in runs for x in (model, horizon) if not re.fullmatch(r"[\w.+-]+", x)})
        if unusable:
            raise ValueError(f"names of models and horizons become folders: {unusable}")
        wanted = spark.createDataFrame([(*run, self.signature) for run in runs], "model string, horizon string, origin date, signature string")
        return {(r["model"], r["horizon"], r["origin"]) for r in missing_runs(wanted, self.receipts(spark)).collect()}  # one row per run

    def write(self, predictions: DataFrame) -> None:
        """Store the predictions of one run; ``origin`` is their cutoff."""
        (predictions.selectExpr(*[c for c in predictions.columns], "cutoff AS origin").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("horizon", "model", "origin").parquet(f"{self.path}/predictions"))

    def receipt(self, spark: SparkSession, run: tuple, status: str, error: str | None) -> None:
        row = spark.createDataFrame([(*run, self.signature, status, error)], RECEIPT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/receipts")

    def statuses(self, spark: SparkSession, runs: list[tuple]) -> DataFrame:
        """model, horizon, cutoff, status and error of these runs: completed if any receipt says so.

        Stored as they are now: two reads of one growing folder are the same plan to Spark, so a query
        that unites them would read the earlier listing twice.
        """
        wanted = spark.createDataFrame(runs, "model string, horizon string, origin date")
        found = self.receipts(spark).filter(f"signature = '{self.signature}'").join(wanted, ["model", "horizon", "origin"], "left_semi")
        return materialise(found.groupBy("model", "horizon", "origin").agg({"status": "min", "error": "max"}).selectExpr(  # completed comes before all others
            "model", "horizon", "origin AS cutoff", "`min(status)` AS status", "CASE WHEN `min(status)` <> 'completed' THEN `max(error)` END AS error"), "statuses")

    def predictions(self, spark: SparkSession, runs: list[tuple]) -> DataFrame:
        """Stored predictions of the completed ones of these runs; only their folders are read."""
        done = [(r["model"], r["horizon"], r["cutoff"]) for r in self.statuses(spark, runs).filter("status = 'completed'").collect()]  # one row per run
        root = f"{self.path}/predictions"
        if not done:
            return spark.createDataFrame([], STORED).drop("origin")
        folders = [f"{root}/horizon={horizon}/model={model}/origin={origin}" for model, horizon, origin in sorted(done)]
        return spark.read.schema(STORED).option("basePath", root).parquet(*folders).drop("origin")
