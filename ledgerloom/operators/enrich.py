"""Extra history features and the known future calendar of each cutoff."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.columns import autumn_exposure, finite_or_null, from_units, month_angle
from ledgerloom.operators.history import joined
from ledgerloom.operators.panel import invoices_as_of
from ledgerloom.settings import CALENDAR_FEATURES, EXTRA_FEATURES, KEYS, Horizon, add_months


def forecast_calendar(spark: SparkSession, cutoffs: list[date], horizon: Horizon) -> DataFrame:
    """Calendar features of every cutoff: position in the year and Oct-Dec share of the horizon."""
    rows = spark.createDataFrame([(c, horizon.end(c)) for c in cutoffs], "cutoff date, _end date")
    length = F.datediff("_end", "cutoff")
    return rows.select(
        "cutoff", F.sin(month_angle(F.col("cutoff"))).alias("cutoff_month_sin"),
        F.cos(month_angle(F.col("cutoff"))).alias("cutoff_month_cos"),
        (autumn_exposure(F.col("cutoff"), F.col("_end")) / length).alias("forecast_q4_share"),
        length.alias("horizon_days"))


def last_year_activity(grain: DataFrame, cutoffs: list[date], horizon: Horizon) -> DataFrame:
    """Spend and invoices in the same window one year before the forecast window."""
    windows = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(add_months(c, -12)).alias("low"),
                                 F.lit(_prior_end(c, horizon)).alias("high")) for c in cutoffs])
    inside = (F.col("purchase_day") >= F.col("_w.low")) & (F.col("purchase_day") < F.col("_w.high"))
    return (grain.withColumn("_w", F.explode(windows)).filter(inside)
            .select("customer_id", "_w.cutoff", "invoice_id", "revenue_units")
            .groupBy(*KEYS).agg(F.expr(f"{from_units('sum(revenue_units)')} AS _spend"),
                                F.count_distinct("invoice_id").cast("double").alias("_orders")))


def _prior_end(cutoff: date, horizon: Horizon) -> date:
    prior = add_months(cutoff, -12)
    # Days are counted from the earlier start; calendar months go back from the later end.
    end = add_months(horizon.end(cutoff), -12) if horizon.months else horizon.end(prior)
    if end > cutoff:
        raise ValueError("the window of last year must end before the cutoff")
    return end


def order_value_extras(invoices: DataFrame) -> DataFrame:
    """Value of the latest order and sample deviation of order values."""
    return invoices.groupBy(*KEYS).agg(
        F.expr(f"max(struct(last_at, first_position, {from_units('revenue_units')} AS amount)).amount AS last_order_value_gbp"),
        F.expr(f"stddev_samp({from_units('revenue_units')}) AS order_value_std_gbp"))


def enriched_features(panel: DataFrame, grain: DataFrame, cutoffs: list[date], source_start: date,
                      horizon: Horizon, parts: int | None = None, extras: DataFrame | None = None) -> DataFrame:
    """The panel with calendar and extra columns; a window the source does not cover is NULL.

    ``extras`` are the order value extras, if they are there already.
    """
    spark = panel.sparkSession
    extras = order_value_extras(invoices_as_of(grain, cutoffs)) if extras is None else extras
    prior = last_year_activity(grain, cutoffs, horizon)
    # One row per cutoff of the request.
    calendar = F.broadcast(forecast_calendar(spark, cutoffs, horizon))
    seen = [f"DATE '{c}'" for c in cutoffs if add_months(c, -12) >= source_start]
    covered = f"cutoff IN ({', '.join(seen)})" if seen else "FALSE"
    out = joined(joined(panel.drop("horizon_days").join(calendar, "cutoff"), extras, parts, "left"), prior, parts, "left")
    ratio = "recency_days / (CASE WHEN mean_days_between_purchase_days IS NOT NULL THEN greatest(mean_days_between_purchase_days, 1D) END)"
    return out.selectExpr(
        *[c for c in out.columns if c not in ("_spend", "_orders")],
        "try_divide(spend_30d_gbp, orders_30d) AS recent_order_value_30d",
        "try_divide(spend_90d_gbp, orders_90d) AS recent_order_value_90d",
        "greatest(spend_180d_gbp - spend_90d_gbp, 0D) AS prior_90d_spend_gbp",
        f"{finite_or_null(ratio)} AS recency_over_mean_gap",
        f"CASE WHEN {covered} THEN coalesce(_spend, 0D) END AS spend_same_future_window_last_year_gbp",
        f"CASE WHEN {covered} THEN coalesce(_orders, 0D) END AS orders_same_future_window_last_year")


ENRICHED_COLUMNS = CALENDAR_FEATURES + EXTRA_FEATURES
