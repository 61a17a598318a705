"""Data profiling of raw lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.history import as_of
from ledgerloom.operators.ingest import is_credit, is_product, last_country
from ledgerloom.operators.ordering import exact_quantiles, ranked
from ledgerloom.operators.targets import forward_windows
from ledgerloom.settings import RAW_COLUMNS, Horizon


def null_profile(lines: DataFrame, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """NULL rows and percentage per column, long form."""
    counts = lines.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["_n"], columns, "column_name", "null_rows").select(
        "column_name", "null_rows", (F.col("null_rows") / F.col("_n") * 100).alias("null_pct"))


def monthly_profile(lines: DataFrame) -> DataFrame:
    month = F.date_format("invoice_date", "yyyy-MM")
    return (lines.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("customer_id").isNull()).alias("missing_customer_rows"),
        F.count_distinct("customer_id").alias("known_customers"))
        .withColumn("missing_customer_pct", F.col("missing_customer_rows") / F.col("rows") * 100))


def special_codes(lines: DataFrame, top: int = 25) -> DataFrame:
    """Most frequent non-product codes with the first description in source order."""
    position = F.struct("batch_order", "source_row")
    return (lines.filter(~is_product()).groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(F.col("description").isNotNull(), F.struct(position.alias("at"), "description")))
        ["description"].alias("description_example"))
        .orderBy(F.col("rows").desc(), "stock_code").limit(top))


def duplicate_groups(lines: DataFrame, raw_columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Distinct raw rows with their number of copies."""
    return lines.groupBy(*raw_columns).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_summary(lines: DataFrame, raw_columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Excess duplicates, rows in duplicate groups and raw rows seen in several batches."""
    copies = lines.groupBy(*raw_columns, "source_sheet").agg(F.count(F.lit(1)).alias("copies"))
    groups = copies.groupBy(*raw_columns).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("batches"))
    return groups.agg(
        F.sum(F.col("copies") - 1).alias("exact_duplicate_excess_rows"),
        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("rows_in_exact_duplicate_groups"),
        F.count_if(F.col("batches") > 1).alias("cross_batch_duplicate_rows"))


def duplicate_excess_by_month(lines: DataFrame, raw_columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Copies beyond the first one, by month (the month is part of the raw row)."""
    return (duplicate_groups(lines, raw_columns).filter("copies > 1")
            .groupBy(F.date_format("invoice_date", "yyyy-MM").alias("month"))
            .agg(F.sum(F.col("copies") - 1).alias("excess_rows")))


def key_consistency(lines: DataFrame) -> DataFrame:
    """How many keys have more than one value of an attribute that should be unique."""
    known = F.col("customer_id").isNotNull()
    checks = [
        ("invoice_ids_with_multiple_known_customers", lines.filter(known), "invoice_id", "customer_id"),
        ("invoice_ids_with_multiple_timestamps", lines, "invoice_id", "invoice_date"),
        ("invoice_ids_with_multiple_countries", lines, "invoice_id", "country"),
        ("customer_ids_with_multiple_countries", lines.filter(known), "customer_id", "country"),
    ]
    # min <> max finds a second value without keeping the distinct values of a key.
    parts = [rows.groupBy(key).agg((F.min(value) != F.max(value)).alias("_many"))
             .agg(F.lit(name).alias("check_name"), F.count_if("_many").alias("violations"))
             for name, rows, key, value in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_counts(lines: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return lines.agg(count("customer_id").alias("distinct_known_customers"),
                     count("invoice_id").alias("distinct_invoice_ids"),
                     count("stock_code").alias("distinct_stock_codes"),
                     count("country").alias("distinct_countries"))


def anomaly_counters(lines: DataFrame) -> DataFrame:
    q, p = F.col("quantity"), F.col("unit_price")
    sale = F.coalesce((q > 0) & (p > 0), F.lit(False)) & ~is_credit()
    known = F.col("customer_id").isNotNull()
    return lines.agg(
        F.count_if(is_credit()).alias("cancel_prefix_rows"), F.count_if(q < 0).alias("negative_quantity_rows"),
        F.count_if(is_credit() & F.coalesce(q >= 0, F.lit(True))).alias("cancel_prefix_nonnegative_quantity_rows"),
        F.count_if((q < 0) & ~is_credit()).alias("negative_quantity_without_cancel_prefix_rows"),
        F.count_if(q == 0).alias("zero_quantity_rows"), F.count_if(p <= 0).alias("nonpositive_price_rows"),
        F.count_if(p < 0).alias("negative_price_rows"),
        F.count_if(~is_product()).alias("nonproduct_code_rows"),
        F.count_if(sale).alias("positive_noncancel_rows_all_ids"),
        F.count_if(sale & known).alias("identified_positive_noncancel_rows"),
        F.count_distinct(F.when(sale & known, F.col("customer_id"))).alias("identified_positive_noncancel_customers"))


def value_quantiles(lines: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Exact quantiles of several columns."""
    return exact_quantiles(lines, columns, probabilities).select("variable", "probability", "quantile")


def customer_orders(purchases: DataFrame) -> DataFrame:
    invoices = purchases.groupBy("customer_id", "invoice_id").agg(F.sum("revenue").alias("revenue"))
    return invoices.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("revenue"))


def scenario_counts(purchases: DataFrame) -> DataFrame:
    """Lines, orders, one-order and repeat customers, repeat-day customers, revenue."""
    days = purchases.select("customer_id", "purchase_day").distinct().groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("days"))
    lines = purchases.groupBy("customer_id").agg(F.count(F.lit(1)).alias("lines"))
    c = customer_orders(purchases).join(days, "customer_id").join(lines, "customer_id")
    return c.agg(
        F.sum("lines").alias("candidate_product_rows"), F.sum("orders").alias("orders"),
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") == 1).alias("one_order_customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_order_customers"),
        F.count_if(F.col("days") > 1).alias("repeat_purchase_day_customers"),
        F.count_if(F.col("days") == 1).alias("one_purchase_day_customers"),
        F.sum("revenue").cast("double").alias("positive_sales_revenue_gbp"))


def revenue_concentration(purchases: DataFrame, shares: tuple[float, ...] = (0.01, 0.10)) -> DataFrame:
    """Percentage of revenue from the top customers."""
    order = [F.col("revenue").desc(), F.col("customer_id").asc()]
    placed = ranked(customer_orders(purchases), order, rank="place", size="n")
    total = F.sum("revenue").cast("double")
    return placed.agg(*[
        (F.sum(F.when(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(s))), F.col("revenue")))
         .cast("double") / total * 100).alias(f"top_{round(s * 100)}pct_customer_revenue_share_pct") for s in shares])


def snapshot_feasibility(purchases: DataFrame, cutoffs: list[date], horizon_days: list[int],
                         safe_end: date) -> DataFrame:
    """Cohort size, activity and outcomes per cutoff and horizon; unfinished outcomes are NULL."""
    horizons = [Horizon(str(d), days=d) for d in horizon_days]
    days = purchases.groupBy("customer_id", "purchase_day").agg(F.sum("revenue").alias("revenue"))
    past = as_of(days, "purchase_day", cutoffs).groupBy("customer_id", "cutoff").agg(
        F.max("purchase_day").alias("last_day"))
    future = forward_windows(days, "purchase_day", cutoffs, horizons).groupBy(
        "customer_id", "cutoff", "horizon").agg(F.sum("revenue").alias("future"))
    grid = past.withColumn("horizon", F.explode(F.array(*[F.lit(h.name) for h in horizons])))
    rows = grid.join(future, ["customer_id", "cutoff", "horizon"], "left")
    recent = F.col("last_day") >= F.date_sub("cutoff", 365)
    returned = F.col("future").isNotNull()
    n = F.col("horizon").cast("int")
    out = rows.groupBy("cutoff", n.alias("horizon_days")).agg(
        F.count(F.lit(1)).alias("historical_customers"),
        F.count_if(recent).alias("active_within_365d_customers"),
        F.count_if(returned).alias("_returned"),
        (F.count_if(~returned) / F.count(F.lit(1)) * 100).alias("_inactive"),
        (F.try_divide(F.count_if(~returned & recent), F.count_if(recent)) * 100).alias("_inactive_recent"),
        F.coalesce(F.sum("future").cast("double"), F.lit(0.0)).alias("_revenue"))
    end = F.date_add("cutoff", F.col("horizon_days"))
    seen = end <= F.lit(safe_end)
    return out.select(
        "cutoff", "horizon_days", end.alias("label_end_exclusive"), seen.alias("fully_observed"),
        "historical_customers", "active_within_365d_customers",
        F.when(seen, F.col("_returned")).alias("returned_customers"),
        F.when(seen, F.col("_inactive")).alias("inactivity_pct_all_history"),
        F.when(seen, F.col("_inactive_recent")).alias("inactivity_pct_active_365d"),
        F.when(seen, F.col("_revenue")).alias("future_positive_sales_revenue_gbp"))


def absent_dates(lines: DataFrame) -> DataFrame:
    """Calendar days without any line."""
    days = lines.select(F.to_date("invoice_date").alias("day")).filter("day IS NOT NULL").distinct()
    bounds = days.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    calendar = bounds.select(F.explode(F.expr("sequence(low, high, INTERVAL 1 DAY)")).alias("day"))
    return calendar.join(days, "day", "left_anti")


def absent_dates_by_weekday(lines: DataFrame) -> DataFrame:
    return absent_dates(lines).groupBy(F.date_format("day", "EEEE").alias("weekday")).agg(
        F.count(F.lit(1)).alias("dates_without_rows"))


def partition_checks(batch_rows: DataFrame, total_rows: DataFrame, scenario: DataFrame,
                     feasibility: DataFrame) -> DataFrame:
    """Violations of the audit's accounting identities, one row per check; all must be zero.

    ``batch_rows`` has rows per batch, ``total_rows`` one row with ``raw_lines``.
    """
    stacked = (batch_rows.agg(F.sum("rows").alias("v")).withColumn("side", F.lit(1))
               .unionByName(total_rows.select(F.col("raw_lines").alias("v"), F.lit(-1).alias("side"))))
    total = stacked.agg(F.lit("batch_rows_sum_to_total").alias("check_name"),
                        F.abs(F.sum(F.col("v") * F.col("side"))).alias("violations"))
    split = scenario.select(
        F.lit("one_order_plus_repeat_is_customers").alias("check_name"),
        F.abs(F.col("one_order_customers") + F.col("repeat_order_customers") - F.col("customers")).alias("violations"))
    rates = [F.col("inactivity_pct_all_history"), F.col("inactivity_pct_active_365d")]
    outcomes = rates + [F.col("returned_customers"), F.col("future_positive_sales_revenue_gbp")]
    unseen = F.lit(False)
    for c in outcomes:
        unseen = unseen | c.isNotNull()
    outside = F.lit(False)
    for c in rates:
        outside = outside | F.coalesce((c < 0) | (c > 100), F.lit(False))
    open_windows = feasibility.agg(F.lit("unfinished_windows_are_null").alias("check_name"),
                                   F.count_if(~F.col("fully_observed") & unseen).alias("violations"))
    bounded = feasibility.agg(F.lit("rates_within_0_100").alias("check_name"),
                              F.count_if(outside).alias("violations"))
    return total.unionByName(split).unionByName(open_windows).unionByName(bounded)
