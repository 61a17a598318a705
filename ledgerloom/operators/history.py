"""The history grain and per-customer purchase-day summaries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.functions.columns import to_units
from ledgerloom.scratch import bucketed
from ledgerloom.settings import KEYS, MONTH_DAYS

# Rows of a part after they have been repeated for every cutoff, and lines of a customer from which on they are not kept in one part.
PART_ROWS, HOT_LINES = 400_000, 200_000


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """``rows`` with all of a customer's in one of ``parts`` partitions; as they are without ``parts``.

    Whatever is then grouped by the customer and more stays in its partition, so the rows are moved once,
    before they are repeated for every cutoff; after that only one row per customer and cutoff is.
    """
    return rows if parts is None else rows.repartition(parts, "customer_id")


def joined(left: DataFrame, right: DataFrame, parts: int | None, how: str = "inner", on: list[str] = KEYS) -> DataFrame:
    """``left.join(right, on, how)``; of tables dealt into ``parts``, without moving a row.

    Spark moves rows dealt by the customer again to join them by the customer and more. So the customer alone is
    the key here and the rest is compared, within the few rows (cutoffs, horizons, weeks) that a customer has.
    """
    if parts is None:
        return left.join(right, on, how)
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = F.col("customer_id") == F.col("_on_customer_id")
    for c in on:
        if c != "customer_id":
            same = same & (F.col(c) >= F.col(f"_on_{c}")) & (F.col(c) <= F.col(f"_on_{c}"))
    more = [c for table in (left, right) for c in table.columns if c not in on]
    return left.join(other, same, how).select(*on, *more)


def by_customer(tables: list[DataFrame], cutoffs: list, build: Callable) -> DataFrame:
    """``build(tables, parts)`` over stored ``tables`` of lines, in parts that hold whole customers.

    The tables are moved once, into buckets of customers; whatever reads them is dealt as it should be.
    Customers of very many lines are built apart with ``parts`` None, which gathers none of them.
    """
    counts = [t.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_LINES) for t in tables]
    hot = sorted({r[0] for c in counts for r in c.collect() if r[0] is not None})  # one row per HOT_LINES lines at most
    lines = sum(t.count() for t in tables)
    parts = max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-lines * len(cutoffs) // PART_ROWS))
    if not hot:
        return build([bucketed(t, parts, "customer_id", "dealt") for t in tables], parts)
    few = F.col("customer_id").isin(hot)
    return build([bucketed(t.filter(~few), parts, "customer_id", "dealt") for t in tables], parts).unionByName(
        build([t.filter(few) for t in tables], None))


def history_grain(purchases: DataFrame, parts: int | None = None) -> DataFrame:
    """Lines summed to customer x invoice x day.

    Cutoffs are midnights, so a day lies wholly before or after each of them: this grain answers
    every as-of question while an invoice with lines on both sides of a cutoff stays split.
    Only numbers and times are carried: a text value in the aggregates would turn every
    aggregation that follows into a sort.
    """
    return dealt(purchases, parts).groupBy("customer_id", "invoice_id", "purchase_day").agg(*map(F.expr, (
        "min(invoice_date) AS first_at", "max(invoice_date) AS last_at",
        f"sum({to_units('revenue')}) AS revenue_units", "sum(quantity) AS units", "count(*) AS lines",
        "min(line_position) AS first_position")))


def as_of(rows: DataFrame, day: str, cutoffs: list[date], trailing_days: int | None = None) -> DataFrame:
    """Rows repeated for every cutoff they precede, optionally only the last days before it."""
    listed = ", ".join(f"DATE '{c}'" for c in sorted(cutoffs))
    out = rows.selectExpr("*", f"explode(array({listed})) AS cutoff").filter(f"{day} < cutoff")
    return out if trailing_days is None else out.filter(f"{day} >= date_sub(cutoff, {trailing_days})")


def cohort(purchases: DataFrame, cutoffs: list[date], parts: int | None = None) -> DataFrame:
    """Customers with a purchase before each cutoff."""
    first = dealt(purchases, parts).groupBy("customer_id").agg(F.min("purchase_day").alias("_first"))
    return as_of(first, "_first", cutoffs).select("customer_id", "cutoff")


def last_country(purchases: DataFrame, cutoffs: list[date], of_invoice: bool = True, parts: int | None = None) -> DataFrame:
    """Country of the latest invoice (or line) before each cutoff, one row per customer and cutoff.

    Nearly all customers have one country, found by grouping on it. Only customers with several
    go through the ordering: an invoice is placed by its earliest line and has the country of its
    last line; lines are placed by their time.
    """
    known = dealt(purchases.filter(F.col("country").isNotNull()), parts)
    per_country = known.groupBy("customer_id", "country").agg(F.min("purchase_day").alias("first_day"))
    per_customer = per_country.groupBy("customer_id").agg(
        F.min("first_day").alias("first_day"), F.min("country").alias("country"), F.max("country").alias("_other"))
    several = per_customer.filter(F.col("country") != F.col("_other")).select("customer_id")
    rows = as_of(known.join(several, "customer_id", "left_semi"), "purchase_day", cutoffs)
    if of_invoice:
        rows = rows.groupBy("customer_id", "cutoff", "invoice_id").agg(
            F.min("invoice_date").alias("invoice_date"), F.min("line_position").alias("at"),
            F.max(F.struct("line_position", "country"))["country"].alias("country"))
    else:
        rows = rows.withColumn("at", F.col("line_position"))
    ordered = rows.groupBy("customer_id", "cutoff").agg(
        F.max(F.struct("invoice_date", "at", "country"))["country"].alias("_last"))
    return joined(as_of(per_customer, "first_day", cutoffs), ordered, parts, "left").select(
        *KEYS, F.when(F.col("country") == F.col("_other"), F.col("country")).otherwise(F.col("_last")).alias("country"))


def purchase_day_summary(purchases: DataFrame, cutoffs: list[date]) -> DataFrame:
    """Occasions, frequency, recency and age in months, and repeat-day mean spend per cutoff."""
    daily = (purchases.groupBy("customer_id", "purchase_day").agg(F.sum("revenue").alias("spend")))
    # Running sums up to each day cannot be shared between cutoffs; the first day is the same
    # for all of them because every cutoff of a customer lies after it.
    firsts = purchases.groupBy("customer_id").agg(F.min("purchase_day").alias("first_day"))
    daily = daily.join(firsts, "customer_id")
    repeat = "purchase_day > first_day"
    out = as_of(daily, "purchase_day", cutoffs).groupBy("customer_id", "cutoff").agg(*map(F.expr, (
        "min(first_day) AS first_day", "max(purchase_day) AS last_day", "count(*) AS occasions",
        f"CAST(sum(CASE WHEN {repeat} THEN spend END) AS DOUBLE) AS _spend", f"count_if({repeat}) AS _repeat_days",
        f"count_if({repeat} AND month(purchase_day) >= 10) AS q4_repeat_count")))
    return out.selectExpr(
        "customer_id", "cutoff", "first_day", "last_day", "occasions", "occasions - 1 AS frequency",
        f"datediff(last_day, first_day) / {MONTH_DAYS}D AS recency_months",
        f"datediff(cutoff, first_day) / {MONTH_DAYS}D AS age_months", "nullif(_repeat_days, 0) AS repeat_day_count",
        "try_divide(_spend, _repeat_days) AS repeat_mean_daily_spend", "q4_repeat_count")


def history_summary(purchases: DataFrame, cutoffs: list[date], home_country: str) -> DataFrame:
    """Purchase-day summary with the last country and the non-home flag."""
    country = last_country(purchases, cutoffs, of_invoice=False)
    return (purchase_day_summary(purchases, cutoffs).join(country, ["customer_id", "cutoff"], "left")
            .withColumn("foreign", F.coalesce(F.col("country") != home_country, F.lit(True)).cast("double")))


def purchase_gaps(purchases: DataFrame) -> DataFrame:
    """Days between successive purchase days; the first day of a customer has none.

    A customer has at most one row per calendar day, so the window is bounded by the calendar.
    """
    days = purchases.select("customer_id", "purchase_day").distinct()
    w = W.partitionBy("customer_id").orderBy("purchase_day")
    return days.withColumn("gap_days", F.datediff("purchase_day", F.lag("purchase_day").over(w)))
