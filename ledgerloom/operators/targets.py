"""Future labels with end-exclusive windows and explicit maturity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.history import dealt, joined
from ledgerloom.settings import KEYS, NINETY_DAYS, SIX_MONTHS, Horizon


def forward_windows(rows: DataFrame, day: str, cutoffs: list[date], horizons: list[Horizon]) -> DataFrame:
    """Rows repeated for every (cutoff, horizon) window ``[cutoff, end)`` that holds their day."""
    options = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(h.name).alias("horizon"), F.lit(h.end(c)).alias("end"))
                        for c in sorted(cutoffs) for h in horizons])
    inside = (F.col(day) >= F.col("_w.cutoff")) & (F.col(day) < F.col("_w.end"))
    return rows.withColumn("_w", F.explode(options)).filter(inside).select("*", "_w.cutoff", "_w.horizon").drop("_w")


def future_activity(purchases: DataFrame, cutoffs: list[date], horizons: list[Horizon], parts: int | None = None) -> DataFrame:
    """Invoices, revenue, first purchase and purchase days inside each forward window."""
    daily = dealt(purchases, parts).groupBy("customer_id", "invoice_id", "purchase_day").agg(
        F.sum("revenue").alias("revenue"), F.min("invoice_date").alias("first_at"))
    # One exchange serves both groupings, and no row is repeated per distinct count.
    window = ["customer_id", "cutoff", "horizon"]
    inside = forward_windows(daily, "purchase_day", cutoffs, horizons)
    inside = inside.repartition(*window) if parts is None else inside
    invoices = inside.groupBy(*window, "invoice_id").agg(F.sum("revenue").alias("revenue"), F.min("first_at").alias("first_at"))
    invoices = invoices.groupBy(*window).agg(
        F.count("invoice_id").alias("future_invoice_count"), F.sum("revenue").cast("double").alias("future_revenue_gbp"),
        F.min("first_at").alias("first_future_purchase"))
    days = inside.select(*window, "purchase_day").distinct().groupBy(*window).agg(F.count("purchase_day").alias("future_purchase_days"))
    return joined(invoices, days, parts, on=window)


def build_targets(purchases: DataFrame, cohort: DataFrame, cutoffs: list[date], complete_end: date,
                  horizons: list[Horizon] = (NINETY_DAYS, SIX_MONTHS), parts: int | None = None) -> DataFrame:
    """One row per cohort member and horizon; labels of unfinished windows are NULL, never zero."""
    horizons = list(horizons)
    ends = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(h.name).alias("horizon"),
                              F.lit(h.end(c)).alias("horizon_end_exclusive"),
                              F.lit(h.end(c) <= complete_end).alias("label_mature"))
                     for c in sorted(cutoffs) for h in horizons])
    rows = (cohort.select(*KEYS).withColumn("_h", F.explode(ends)).filter(F.col("_h.cutoff") == F.col("cutoff"))
            .select(*KEYS, "_h.horizon", "_h.horizon_end_exclusive", "_h.label_mature"))
    labelled = joined(rows, future_activity(purchases, cutoffs, horizons, parts), parts, "left", KEYS + ["horizon"])
    mature = F.col("label_mature")
    count = F.coalesce("future_invoice_count", F.lit(0))

    def label(c: Column) -> Column:
        return F.when(mature, c)

    returned = (count > 0).cast("tinyint")
    return labelled.select(
        *KEYS, "horizon", "horizon_end_exclusive", "label_mature",
        label(count.cast("int")).alias("future_invoice_count"),
        label(F.coalesce("future_revenue_gbp", F.lit(0.0))).alias("future_revenue_gbp"),
        label(F.col("first_future_purchase")).alias("first_future_purchase"),
        label(F.coalesce("future_purchase_days", F.lit(0)).cast("smallint")).alias("future_purchase_days"),
        label(returned).alias("returned"), label((F.lit(1) - returned).cast("tinyint")).alias("inactive"))


def source_span(purchases: DataFrame) -> tuple[date, date]:
    """First and last purchase day; the last day is incomplete, so it ends the safe range."""
    row = purchases.agg(F.min("purchase_day"), F.max("purchase_day")).first()
    if row[0] is None:
        raise ValueError("no purchase history")
    return row[0], row[1]


def available_training(labelled: DataFrame, origin: date) -> DataFrame:
    """Rows a model fitted at ``origin`` may learn from: earlier cutoffs, finished outcomes."""
    return labelled.filter(F.col("label_mature") & (F.col("cutoff") < F.lit(origin))
                           & (F.col("horizon_end_exclusive") <= F.lit(origin)))


def scoring_cohort(labelled: DataFrame, origin: date) -> DataFrame:
    return labelled.filter(F.col("label_mature") & (F.col("cutoff") == F.lit(origin)))


def cohort_summary(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """Size, inactivity, returns, revenue and recently active customers per cutoff."""
    labels = targets.groupBy("cutoff").agg(
        F.count_distinct("customer_id").alias("customers"), F.avg("inactive").alias("inactive_rate"),
        F.sum("returned").alias("returned"), F.sum("future_revenue_gbp").alias("future_revenue_gbp"))
    recent = panel.groupBy("cutoff").agg(F.count_if(F.col("orders_365d") > 0).alias("active_365d_customers"))
    return labels.join(recent, "cutoff", "left").withColumn(
        "active_365d_customers", F.coalesce("active_365d_customers", F.lit(0)))


def label_panel(panel: DataFrame, targets: DataFrame, parts: int | None = None) -> DataFrame:
    """Features and labels of the same customer and cutoff, one to one."""
    return joined(panel, targets, parts)


def person_periods(labelled: DataFrame, periods: int = 13) -> DataFrame:
    """Weekly exposure rows until the first return; the last row of a returner is the event."""
    elapsed = F.datediff(F.to_date("first_future_purchase"), F.col("cutoff"))
    event = F.when((F.col("returned") == 1) & F.col("first_future_purchase").isNotNull(),
                   F.least(F.floor(F.greatest(elapsed, F.lit(0)) / 7), F.lit(periods - 1)).cast("int"))
    last = F.coalesce("_event", F.lit(periods - 1))
    return (labelled.withColumn("_event", event)
            .withColumn("period", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("event", F.coalesce(F.col("period") == F.col("_event"), F.lit(False)).cast("int"))
            .drop("_event"))


def period_grid(rows: DataFrame, periods: int = 13) -> DataFrame:
    """Every row at every period, for scoring."""
    return rows.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
