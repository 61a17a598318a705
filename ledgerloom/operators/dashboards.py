"""Result tables behind the review and model pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Reading names of the profile features.
FEATURE_TITLES = {
    "recency_days": "Recency (days)", "purchase_day_count": "Purchase days",
    "purchase_count": "Repeat purchase occasions", "lifetime_revenue_gbp": "Historical revenue (£)",
    "avg_order_value_gbp": "Average order value (£)", "avg_basket_units": "Average basket units",
    "product_diversity": "Product diversity", "spend_365d_gbp": "Spend in prior 365 days (£)",
}
SHOWN_SPLITS = ["development", "development_ensemble", "final_test_platt"]


def model_comparison(metrics: DataFrame, splits: list[str] = SHOWN_SPLITS) -> DataFrame:
    return metrics.filter(F.col("split").isin(splits)).orderBy(
        "split", F.col("precision_at_capacity").desc(), "model")


def metric_by_split(metrics: DataFrame, value: str = "average_precision", splits: list[str] = SHOWN_SPLITS) -> DataFrame:
    """Models as rows, splits as columns."""
    return metrics.filter(F.col("split").isin(splits)).groupBy("model").pivot("split", splits).agg(F.first(value))


def top_risk(scores: DataFrame, risk_column: str, limit: int = 500) -> DataFrame:
    return scores.select("customer_id", "cutoff", F.col(risk_column).alias("inactive_90d_probability")).orderBy(
        F.col("inactive_90d_probability").desc(), "customer_id").limit(limit)


def top_forecasts(scores: DataFrame, limit: int = 100) -> DataFrame:
    wanted = ["customer_id", "cutoff", "selected_model", "predicted_revenue_gbp", "lower_90_gbp", "upper_90_gbp"]
    return scores.select(*[c for c in wanted if c in scores.columns]).orderBy(
        F.col("predicted_revenue_gbp").desc(), "customer_id").limit(limit)


def portfolio_view(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("split").isin("development", "final_test")).orderBy("split", "mae_gbp", "model")


def profile_index_by_feature(index: DataFrame, segments: list[int]) -> DataFrame:
    """Profile index transposed: one row per feature, one column per segment."""
    features = [c for c in index.columns if c != "segment"]
    titles = F.create_map(*[F.lit(x) for pair in FEATURE_TITLES.items() for x in pair])
    long = index.unpivot(["segment"], features, "feature", "value")
    wide = long.groupBy("feature").pivot("segment", segments).agg(F.first("value"))
    return wide.select(F.coalesce(titles[F.col("feature")], F.col("feature")).alias("feature"),
                       *[F.col(f"`{s}`").alias(f"segment_{s}") for s in segments])


def review_points(placed: DataFrame) -> DataFrame:
    """Per customer: risk in percent and the queue flag as text."""
    return placed.select("customer_id", "avg_order_value_gbp", "review_group",
                         (F.col("inactive_probability_90d") * 100).alias("inactivity_percent"),
                         F.when(F.col("in_review_queue"), "In review queue").otherwise("Outside queue").alias("queue_status"))


def queue_display(placed: DataFrame, limit: int = 100) -> DataFrame:
    return (placed.filter("in_review_queue").orderBy("review_rank").limit(limit)
            .withColumn("inactive_probability_90d", F.col("inactive_probability_90d") * 100))


def customer_record(placed: DataFrame, customer_id: int) -> DataFrame:
    return placed.filter(F.col("customer_id") == customer_id)


def holdout_view(outcomes: DataFrame, method: str = "kmeans") -> DataFrame:
    return outcomes.filter(F.col("method") == method).withColumn(
        "segment_label", F.concat(F.lit("Segment "), F.col("segment").cast("string")))


def membership_head(assignments: DataFrame, limit: int = 100) -> DataFrame:
    return assignments.orderBy("customer_id", "cutoff").limit(limit)
