"""Parameters and fixed vocabularies shared by the operators."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

# --- Fixed values: names and formats that results are compared on -----------------------

# Accepted source headers and the canonical column each one becomes.
HEADER_ALIASES = {
    "Invoice": "invoice_id", "InvoiceNo": "invoice_id",
    "StockCode": "stock_code", "Description": "description",
    "Quantity": "quantity", "InvoiceDate": "invoice_date",
    "Price": "unit_price", "UnitPrice": "unit_price",
    "Customer ID": "customer_id", "CustomerID": "customer_id",
    "Country": "country",
}
RAW_COLUMNS = ["invoice_id", "stock_code", "description", "quantity",
               "invoice_date", "unit_price", "customer_id", "country"]
OPTIONAL_COLUMNS = ["description"]
LINE_COLUMNS = ["invoice_id", "stock_code", "invoice_date", "quantity", "unit_price",
                "customer_id", "country", "source_sheet", "source_row"]

# Five digits and optional letters, nothing after them (not even a newline).
PRODUCT_CODE = r"\A\d{5}[A-Za-z]*\z"

NUMERIC_FEATURES = [
    "recency_days", "tenure_days", "history_days", "purchase_count",
    "purchase_day_count", "repeat_purchase_day_count", "lifetime_revenue_gbp",
    "avg_order_value_gbp", "median_order_value_gbp", "max_order_value_gbp",
    "avg_basket_units", "avg_basket_lines", "product_diversity",
    "mean_days_between_purchase_days", "purchase_days_per_30d",
    "orders_30d", "orders_90d", "orders_180d", "orders_365d",
    "spend_30d_gbp", "spend_90d_gbp", "spend_180d_gbp", "spend_365d_gbp",
    "spend_recent90_over_prior90", "return_invoice_rate", "credit_amount_365d_gbp",
    "revenue_per_history_day_gbp", "zero_purchase_weeks_26w",
]
WEEK_CHANNELS = ["orders", "revenue_gbp", "units", "product_codes",
                 "has_purchase", "after_first_observed_purchase"]
CALENDAR_FEATURES = ["cutoff_month_sin", "cutoff_month_cos", "forecast_q4_share"]
EXTRA_FEATURES = [
    "recent_order_value_30d", "recent_order_value_90d", "prior_90d_spend_gbp",
    "recency_over_mean_gap", "last_order_value_gbp", "order_value_std_gbp",
    "spend_same_future_window_last_year_gbp", "orders_same_future_window_last_year",
]
SEGMENT_FEATURES = [
    "recency_days", "purchase_day_count", "purchase_count", "lifetime_revenue_gbp",
    "avg_order_value_gbp", "avg_basket_units", "product_diversity",
    "mean_days_between_purchase_days", "spend_90d_gbp", "spend_365d_gbp",
]
LOGISTIC_SPLINE_FEATURES = [
    "recency_days", "tenure_days", "purchase_day_count", "purchase_count",
    "orders_90d", "orders_365d", "spend_90d_gbp", "lifetime_revenue_gbp",
    "mean_days_between_purchase_days", "spend_recent90_over_prior90",
]
REVENUE_SPLINE_FEATURES = [
    "recency_days", "tenure_days", "purchase_count", "avg_order_value_gbp",
    "spend_90d_gbp", "spend_365d_gbp", "last_order_value_gbp", "order_value_std_gbp",
]
REVIEW_HISTORY = ["country", "recency_days", "tenure_days", "purchase_count",
                  "avg_order_value_gbp", "lifetime_revenue_gbp", "spend_90d_gbp",
                  "spend_365d_gbp"]

# Ranking policies of the review: key -> (column ranked by, title).
POLICIES = {
    "risk_value": ("review_priority_score", "Risk × historical average order value"),
    "risk": ("inactive_probability_90d", "Inactivity risk only"),
    "forecast_value": ("predicted_revenue_90d_gbp", "Expected 90-day revenue only"),
    "historical_value": ("spend_365d_gbp", "Historical 365-day spend only"),
}
REVIEW_GROUPS = ["Higher value, higher risk", "Higher value, lower risk",
                 "Lower value, higher risk", "Lower value, lower risk"]

SPEND_WINDOWS = (30, 90, 180, 365)
WEEKS = 26
MONTH_DAYS = 30.436875
HAZARD_PERIODS = 13
SEED = 20261001
CAPACITY = 0.10

# ---------------------------------------------------------------------------------------

KEYS = ["customer_id", "cutoff"]

# Money is exact: sums do not depend on row order or partitioning.
MONEY = "DECIMAL(18, 4)"


def add_months(day: date, months: int) -> date:
    """Calendar month arithmetic, clamped to the month end."""
    years, month0 = divmod(day.month - 1 + months, 12)
    year, month = day.year + years, month0 + 1
    return date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


@dataclass(frozen=True)
class Horizon:
    """A forecast horizon in days or calendar months."""

    name: str
    days: int = 0
    months: int = 0

    def end(self, cutoff: date) -> date:
        return add_months(cutoff, self.months) if self.months else cutoff + timedelta(days=self.days)

    def length(self, cutoff: date) -> int:
        return (self.end(cutoff) - cutoff).days


NINETY_DAYS = Horizon("90d", days=90)
SIX_MONTHS = Horizon("6m", months=6)


def month_starts(first: date, last: date) -> list[date]:
    """First days of every month from ``first`` to ``last`` inclusive."""
    start = first if first.day == 1 else add_months(first.replace(day=1), 1)
    out = []
    while start <= last:
        out.append(start)
        start = add_months(start, 1)
    return out
