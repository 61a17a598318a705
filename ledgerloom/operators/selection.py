"""Leaderboards and choices made only from outcomes that were available."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Mean metrics per model over its completed origins."""
    return metrics.filter(F.col("status") == "completed").groupBy("model").agg(
        F.avg("mae_gbp").alias("mean_mae_gbp"), F.avg("rmse_gbp").alias("mean_rmse_gbp"),
        F.avg(F.abs("aggregate_bias_pct")).alias("mean_absolute_bias_pct"),
        F.avg("aggregate_bias_pct").alias("mean_signed_bias_pct"),
        F.avg("tweedie_deviance_p1_5").alias("mean_tweedie_deviance"),
        F.avg("revenue_capture_at_capacity").alias("mean_revenue_capture_top10"),
        F.count_distinct("cutoff").alias("n_origins"))


def tag_splits(metrics: DataFrame, outcome_ends: DataFrame, final_origin: date) -> DataFrame:
    """``development`` if the origin's outcome window ended by the final origin.

    ``outcome_ends`` has one row per cutoff: (cutoff, horizon_end_exclusive).
    """
    return metrics.join(outcome_ends.distinct(), "cutoff").withColumn(
        "split", F.when(F.col("horizon_end_exclusive") <= F.lit(final_origin), "development")
        .otherwise("retrospective_robustness")).drop("horizon_end_exclusive")


def available_origins(metrics: DataFrame, outcome_ends: DataFrame, final_origin: date) -> DataFrame:
    ended = outcome_ends.filter(F.col("horizon_end_exclusive") <= F.lit(final_origin)).select("cutoff").distinct()
    return metrics.join(ended, "cutoff", "left_semi")


def eligible_models(metrics: DataFrame, outcome_ends: DataFrame, final_origin: date,
                    expected_origins: list[date] | None = None) -> DataFrame:
    """Leaderboard over available origins; eligible models completed every expected one."""
    available = available_origins(metrics, outcome_ends, final_origin)
    if expected_origins is not None:
        available = available.filter(F.col("cutoff").isin(expected_origins))
        due = outcome_ends.filter(F.col("cutoff").isin(expected_origins))
    else:
        due = outcome_ends.join(metrics.select("cutoff").distinct(), "cutoff", "left_semi")
    due = due.filter(F.col("horizon_end_exclusive") <= F.lit(final_origin)).agg(
        F.count_distinct("cutoff").alias("expected_origins"))
    table = leaderboard(available).withColumn("_one", F.lit(1))
    due = due.withColumn("_one", F.lit(1))  # a one-row aggregate
    return (table.join(F.broadcast(due), "_one").drop("_one")
            .withColumn("eligible", F.col("n_origins") == F.col("expected_origins")))


def select_revenue_model(table: DataFrame) -> DataFrame:
    """Lowest deviance, then absolute bias, then RMSE among eligible models."""
    return table.filter("eligible").orderBy(
        "mean_tweedie_deviance", "mean_absolute_bias_pct", "mean_rmse_gbp", "model").limit(1)


def select_by_error(table: DataFrame) -> DataFrame:
    """Lowest mean MAE, then mean absolute bias."""
    return table.orderBy("mean_mae_gbp", "mean_absolute_bias_pct", "model").limit(1)


def select_inactivity_model(metrics: DataFrame) -> DataFrame:
    """Highest precision at capacity, then average precision, then lowest Brier score."""
    return metrics.filter(F.col("precision_at_capacity").isNotNull()).orderBy(
        F.col("precision_at_capacity").desc(), F.col("average_precision").desc(), "brier_score", "model").limit(1)


def registry_row(winner: DataFrame, task: str, lead_model: str | None = None) -> DataFrame:
    """Chosen model of a task: the metric winner, or a configured lead; both are recorded."""
    chosen = F.lit(lead_model) if lead_model else F.col("model")
    return winner.select(F.lit(task).alias("task"), chosen.alias("selected_model"),
                         F.col("model").alias("development_metric_winner"))


def append_summary(metrics: DataFrame, table: DataFrame, task: str, origins: list[date]) -> DataFrame:
    """Metric rows plus one development-summary row per model."""
    summary = table.select(
        F.lit(task).alias("task"), "model", F.lit("development_summary").alias("split"),
        F.lit("|".join(str(o) for o in origins)).alias("cutoff"),
        F.col("mean_mae_gbp").alias("mae_gbp"), F.col("mean_rmse_gbp").alias("rmse_gbp"),
        F.col("mean_signed_bias_pct").alias("aggregate_bias_pct"),
        F.col("mean_revenue_capture_top10").alias("revenue_capture_at_capacity"),
        F.col("mean_absolute_bias_pct").alias("mean_absolute_origin_bias_pct"), "n_origins")
    rows = metrics.withColumns({"task": F.lit(task), "cutoff": F.col("cutoff").cast("string")})
    return rows.unionByName(summary, allowMissingColumns=True)


def upsert(previous: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``previous`` with the same keys.

    The last row of a key wins; ``run_order`` tells the order of runs.
    """
    both = previous.unionByName(new, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col("run_order").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def status_summary(statuses: DataFrame) -> DataFrame:
    """Origins completed and failed per model."""
    return statuses.groupBy("model").agg(
        F.count_if(F.col("status") == "completed").alias("origins_completed"),
        F.count_if(F.col("status") != "completed").alias("origins_failed"),
        F.max(F.when(F.col("status") != "completed", F.col("error"))).alias("an_error"))


def missing_runs(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """(model, horizon, origin, signature) combinations that are not stored as completed yet."""
    done = stored.filter(F.col("status") == "completed")
    return requested.join(done, ["model", "horizon", "origin", "signature"], "left_anti")


def score_table(predictions: DataFrame, models: list[str], value: str = "predicted", suffix: str = "") -> DataFrame:
    """One row per customer and cutoff with a column per model."""
    wide = predictions.groupBy("customer_id", "cutoff").pivot("model", models).agg(F.first(value))
    return wide.select("customer_id", "cutoff", *[F.col(f"`{m}`").alias(f"{m}{suffix}") for m in models])
