"""Customer snapshots as of many cutoffs, built in one pass."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import days_between, finite_or_null, from_units, to_units
from ledgerloom.operators.history import as_of, dealt, history_grain, joined, last_country
from ledgerloom.operators.ordering import exact_medians
from ledgerloom.scratch import bucketed, materialise
from ledgerloom.settings import KEYS, NUMERIC_FEATURES, SPEND_WINDOWS, WEEK_CHANNELS, WEEKS

WINDOW_DAYS = WEEKS * 7


def invoices_as_of(grain: DataFrame, cutoffs: list[date]) -> DataFrame:
    """Invoices as they stood before each cutoff.

    ``last_day`` is the day of the latest line before the cutoff, so an invoice has a line in
    ``[cutoff - N, cutoff)`` exactly if ``last_day >= cutoff - N``; spend sums the lines.
    """
    spend = [f"sum(CASE WHEN purchase_day >= date_sub(cutoff, {n}) THEN revenue_units END) AS spend_{n}"
             for n in SPEND_WINDOWS]
    return as_of(grain, "purchase_day", cutoffs).groupBy("customer_id", "cutoff", "invoice_id").agg(*map(F.expr, (
        "min(first_at) AS invoice_date", "max(last_at) AS last_at", "max(purchase_day) AS last_day",
        "sum(revenue_units) AS revenue_units", "sum(units) AS units", "sum(lines) AS lines",
        "min(first_position) AS first_position", *spend)))


def order_features(invoices: DataFrame) -> DataFrame:
    """Recency, frequency, money, gaps and trailing windows per customer and cutoff (no median)."""
    orders = [f"CAST(count_if(last_day >= date_sub(cutoff, {n})) AS DOUBLE) AS orders_{n}d" for n in SPEND_WINDOWS]
    spend = [f"{from_units(f'coalesce(sum(spend_{n}), 0)')} AS spend_{n}d_gbp" for n in SPEND_WINDOWS]
    sums = invoices.groupBy(*KEYS).agg(*map(F.expr, (
        "min(invoice_date) AS first_purchase", "max(invoice_date) AS last_purchase", "count(*) AS purchase_count",
        f"{from_units('sum(revenue_units)')} AS lifetime_revenue_gbp",
        f"{from_units('max(revenue_units)')} AS max_order_value_gbp", "sum(units) AS _units", "sum(lines) AS _lines",
        "count(DISTINCT to_date(invoice_date)) AS purchase_day_count", *orders, *spend)))
    midnight = "CAST(cutoff AS TIMESTAMP_NTZ)"
    windows = [f"{kind}_{n}d{unit}" for kind, unit in (("orders", ""), ("spend", "_gbp")) for n in SPEND_WINDOWS]
    timed = sums.selectExpr(
        "*", f"{days_between(midnight, 'last_purchase')} AS recency_days",
        f"{days_between(midnight, 'first_purchase')} AS tenure_days")
    return timed.selectExpr("*", "greatest(tenure_days, 1D) AS history_days").selectExpr(
        *KEYS, "first_purchase", "last_purchase", "purchase_count", "purchase_day_count", "lifetime_revenue_gbp",
        "max_order_value_gbp", *windows, "recency_days", "tenure_days", "history_days",
        "lifetime_revenue_gbp / purchase_count AS avg_order_value_gbp", "_units / purchase_count AS avg_basket_units",
        "_lines / purchase_count AS avg_basket_lines",
        "greatest(purchase_day_count - 1, 0) AS repeat_purchase_day_count",
        # The mean of successive gaps telescopes to the span of the days.
        "try_divide(datediff(to_date(last_purchase), to_date(first_purchase)), purchase_day_count - 1) "
        "AS mean_days_between_purchase_days",
        "(spend_90d_gbp + 1) / (spend_180d_gbp - spend_90d_gbp + 1) AS spend_recent90_over_prior90",
        "purchase_day_count / greatest(history_days / 30, 1D) AS purchase_days_per_30d",
        "lifetime_revenue_gbp / history_days AS revenue_per_history_day_gbp")


def product_features(purchases: DataFrame, cutoffs: list[date], parts: int | None = None) -> DataFrame:
    """Distinct products bought before each cutoff, from each product's first purchase day."""
    first = dealt(purchases, parts).groupBy("customer_id", "stock_code").agg(F.min("purchase_day").alias("_first"))
    return as_of(first, "_first", cutoffs).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("product_diversity"))


def credit_features(credits: DataFrame, cutoffs: list[date], parts: int | None = None) -> DataFrame:
    """Credit amount of the last 365 days and credit invoices of the whole history."""
    daily = dealt(credits, parts).groupBy("customer_id", "invoice_id", "credit_day").agg(
        F.sum("credit_amount_abs").alias("amount"))
    per_invoice = as_of(daily, "credit_day", cutoffs).groupBy(*KEYS, "invoice_id").agg(
        F.expr("sum(CASE WHEN credit_day >= date_sub(cutoff, 365) THEN amount END) AS amount"))
    return per_invoice.groupBy(*KEYS).agg(
        F.expr("CAST(coalesce(sum(amount), 0) AS DOUBLE) AS credit_amount_365d_gbp"),
        F.expr("count(*) AS credit_invoices"))


def weekly_bins(purchases: DataFrame, cutoffs: list[date], parts: int | None = None) -> DataFrame:
    """Activity in the 26 seven-day bins that end at the cutoff; only weeks with purchases."""
    daily = dealt(purchases, parts).groupBy("customer_id", "invoice_id", "stock_code", "purchase_day").agg(
        F.expr(f"sum({to_units('revenue')}) AS revenue_units"), F.expr("sum(quantity) AS units"))
    binned = as_of(daily, "purchase_day", cutoffs, WINDOW_DAYS).selectExpr(
        "*", f"CAST(floor(datediff(purchase_day, date_sub(cutoff, {WINDOW_DAYS})) / 7) AS INT) AS week_index")
    # Both countings group by more than the customer and cutoff that the rows are dealt by: one exchange serves them,
    # and no row is repeated per distinct count.
    binned, week = binned.repartition(*KEYS) if parts is None else binned, [*KEYS, "week_index"]
    orders = binned.groupBy(*week, "invoice_id").agg(F.expr("sum(revenue_units) AS revenue_units"), F.expr("sum(units) AS units"))
    orders = orders.groupBy(*week).agg(F.expr("count(invoice_id) AS orders"), F.expr(f"greatest({from_units('sum(revenue_units)')}, 0D) AS revenue_gbp"),
                                       F.expr("greatest(sum(units), 0D) AS units"))
    products = binned.select(*week, "stock_code").distinct().groupBy(*week).agg(F.expr("count(stock_code) AS product_codes"))
    return joined(orders, products, parts, on=week)


def dense_weeks(bins: DataFrame, first_days: DataFrame, parts: int | None = None) -> DataFrame:
    """Fixed 26-week sequence per customer and cutoff, as an array of channel structs.

    ``first_days`` has (customer_id, cutoff, first_purchase). At most 26 entries are gathered.
    """
    active = bins.groupBy(*KEYS).agg(
        F.expr("map_from_entries(collect_list(struct(week_index, struct(orders, revenue_gbp, units, product_codes)))) AS _weeks"),
        F.expr("count(*) AS _active"))
    start = (f"greatest(0, least({WEEKS - 1}, floor(datediff(to_date(first_purchase), "
             f"date_sub(cutoff, {WINDOW_DAYS})) / 7))) AS _start")
    values = ", ".join(f"'{c}', coalesce(CAST(_weeks[i].{c} AS FLOAT), 0F)" for c in WEEK_CHANNELS[:4])
    week = (f"named_struct({values}, '{WEEK_CHANNELS[4]}', CAST(_weeks[i] IS NOT NULL AS FLOAT), "
            f"'{WEEK_CHANNELS[5]}', CAST(i >= _start AS FLOAT))")
    return joined(first_days.selectExpr(*KEYS, start), active, parts, "left").selectExpr(
        *KEYS, f"transform(sequence(0, {WEEKS - 1}), i -> {week}) AS weeks",
        f"{WEEKS} - coalesce(_active, 0) AS zero_purchase_weeks_26w")


def median_order_values(invoices: DataFrame, parts: int | None = None) -> DataFrame:
    """Exact median order value, by ranks that gather no customer's invoices; where a part holds whole customers, inside it."""
    if parts is not None:
        return invoices.groupBy(*KEYS).agg(F.expr(f"{from_units('percentile(revenue_units, 0.5D)')} AS median_order_value_gbp"))
    values = invoices.selectExpr(*KEYS, f"{from_units('revenue_units')} AS median_order_value_gbp")
    return exact_medians(values, ["median_order_value_gbp"], KEYS)


def build_panel(purchases: DataFrame, credits: DataFrame, cutoffs: list[date], horizon_days: int = 90,
                grain: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """All snapshot features, the weekly sequence included, for every cutoff at once.

    Every branch ends grouped by (customer, cutoff), so the joins between them reuse that
    partitioning. Pass a ``grain`` to share it with other operators. With ``parts`` (see
    ``history.by_customer``) each branch moves its columns of the lines once and stores nothing.
    """
    if parts is None:
        grain = materialise(history_grain(purchases), "grain") if grain is None else grain
        invoices = materialise(invoices_as_of(grain, cutoffs), "invoices")
    else:
        invoices = invoices_as_of(history_grain(purchases, parts) if grain is None else grain, cutoffs)
    orders = order_features(invoices)
    firsts = orders if parts is None else dealt(purchases, parts).groupBy("customer_id").agg(
        F.expr("min(invoice_date) AS first_purchase"), F.expr("min(purchase_day) AS _first"))
    firsts = orders if parts is None else as_of(firsts, "_first", cutoffs)
    weeks = dense_weeks(weekly_bins(purchases, cutoffs, parts), firsts.select(*KEYS, "first_purchase"), parts)
    if parts is not None:  # a task that held all branches at once would need memory for some seventy operators
        weeks = bucketed(weeks, parts, "customer_id", "weeks")
    panel = joined(orders, median_order_values(invoices, parts), parts, "left")
    panel = joined(panel, last_country(purchases, cutoffs, parts=parts), parts, "left")
    panel = joined(panel, product_features(purchases, cutoffs, parts), parts)
    panel = joined(joined(panel, credit_features(credits, cutoffs, parts), parts, "left"), weeks, parts)
    panel = panel.selectExpr(
        *[c for c in panel.columns if c not in ("credit_amount_365d_gbp", "credit_invoices")],
        "coalesce(credit_amount_365d_gbp, 0D) AS credit_amount_365d_gbp",
        "coalesce(credit_invoices, 0) / greatest(purchase_count, 1) AS return_invoice_rate")
    numeric = [f"CAST({finite_or_null(c)} AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES]
    return panel.selectExpr(*KEYS, "country", "first_purchase", "last_purchase", f"{horizon_days} AS horizon_days",
                            *numeric, "weeks")
