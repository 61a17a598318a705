"""Plain SQL over the given tables with the same results as the registered queries."""

from __future__ import annotations

from ledgerloom.operators.dashboards import FEATURE_TITLES
from ledgerloom.plans import inputs as I
from ledgerloom.settings import (NINETY_DAYS, POLICIES, REVIEW_GROUPS, SEGMENT_FEATURES, SIX_MONTHS, Horizon, add_months)

ORACLES: dict[str, str] = {}


def r(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def rs(*columns: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def dates(values) -> str:
    return ", ".join(f"(DATE '{v}')" for v in values)


# --- Common tables, in dependency order ----------------------------------------------------

CTES: dict[str, str] = {}

CTES["base"] = """
SELECT concat(CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END, l_orderkey) AS invoice_id,
       CASE WHEN l_linenumber = 7 THEN 'POST' ELSE lpad(CAST(l_partkey AS VARCHAR), 5, '0') END AS stock_code,
       concat('Part ', l_partkey) AS description,
       CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
       l_shipdate AS invoice_date, l_extendedprice / l_quantity AS unit_price,
       CASE WHEN o_custkey % 13 <> 0 THEN o_custkey END AS customer_id, n_name AS country,
       l_orderkey * 8 + l_linenumber AS source_row,
       CAST(l_extendedprice AS DECIMAL(18, 2)) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey"""
CTES["raw"] = """
SELECT *, 'A' AS source_sheet, 'legacy' AS source_sheet_role, 0 AS batch_order FROM base WHERE invoice_date < DATE '1998-07-01'
UNION ALL
SELECT *, 'B', 'current', 1 FROM base WHERE invoice_date >= DATE '1998-01-01'"""
CTES["lines"] = """
SELECT *, CASE WHEN invoice_date < DATE '1998-07-01' THEN 'A' ELSE 'B' END AS source_sheet,
       CASE WHEN invoice_date < DATE '1998-07-01' THEN 'legacy' ELSE 'current' END AS source_sheet_role,
       CASE WHEN invoice_date < DATE '1998-07-01' THEN 0 ELSE 1 END AS batch_order,
       upper(invoice_id) LIKE 'C%' AS is_credit,
       regexp_full_match(stock_code, '[0-9]{5}[A-Za-z]*') AS is_product
FROM base"""
CTES["sold"] = """
SELECT *, price AS revenue, CAST(invoice_date AS DATE) AS purchase_day,
       CAST(batch_order AS BIGINT) * 281474976710656 + source_row AS line_position
FROM lines
WHERE quantity > 0 AND unit_price > 0 AND NOT is_credit AND customer_id IS NOT NULL AND is_product AND invoice_date IS NOT NULL"""
CTES["credited"] = """
SELECT *, price AS credit_amount_abs, CAST(invoice_date AS DATE) AS credit_day
FROM lines WHERE is_credit AND quantity < 0 AND customer_id IS NOT NULL AND invoice_date IS NOT NULL"""
CTES["cutoffs"] = f"SELECT CAST(col0 AS DATE) AS cutoff FROM (VALUES {dates(I.CUTOFFS)}) t(col0)"
CTES["inv"] = """
SELECT customer_id, cutoff, invoice_id, min(invoice_date) AS invoice_date, max(invoice_date) AS last_at,
       sum(revenue) AS revenue, sum(quantity) AS units, count(*) AS lines, min(line_position) AS first_position,
       last(country ORDER BY line_position) AS country,
       bool_or(purchase_day >= cutoff - 30) AS in30, bool_or(purchase_day >= cutoff - 90) AS in90,
       bool_or(purchase_day >= cutoff - 180) AS in180, bool_or(purchase_day >= cutoff - 365) AS in365,
       sum(revenue) FILTER (purchase_day >= cutoff - 30) AS s30, sum(revenue) FILTER (purchase_day >= cutoff - 90) AS s90,
       sum(revenue) FILTER (purchase_day >= cutoff - 180) AS s180, sum(revenue) FILTER (purchase_day >= cutoff - 365) AS s365
FROM sold JOIN cutoffs ON purchase_day < cutoff GROUP BY ALL"""


def _rfm(source: str) -> str:
    return f"""
SELECT *, greatest(tenure_days, 1) AS history_days,
       purchase_day_count / greatest(greatest(tenure_days, 1) / 30, 1) AS purchase_days_per_30d,
       lifetime_revenue_gbp / greatest(tenure_days, 1) AS revenue_per_history_day_gbp
FROM (SELECT customer_id, cutoff, last(country ORDER BY invoice_date, first_position) AS country,
       min(invoice_date) AS first_purchase, max(invoice_date) AS last_purchase,
       epoch_us(CAST(cutoff AS TIMESTAMP) - max(invoice_date)) / CAST(86400000000 AS DOUBLE) AS recency_days,
       epoch_us(CAST(cutoff AS TIMESTAMP) - min(invoice_date)) / CAST(86400000000 AS DOUBLE) AS tenure_days,
       count(DISTINCT invoice_id) AS purchase_count, count(DISTINCT CAST(invoice_date AS DATE)) AS purchase_day_count,
       greatest(count(DISTINCT CAST(invoice_date AS DATE)) - 1, 0) AS repeat_purchase_day_count,
       CAST(sum(revenue) AS DOUBLE) AS lifetime_revenue_gbp,
       CAST(sum(revenue) AS DOUBLE) / count(*) AS avg_order_value_gbp,
       median(CAST(revenue AS DOUBLE)) AS median_order_value_gbp, CAST(max(revenue) AS DOUBLE) AS max_order_value_gbp,
       sum(units) / count(*) AS avg_basket_units, CAST(sum(lines) AS DOUBLE) / count(*) AS avg_basket_lines,
       CASE WHEN count(DISTINCT CAST(invoice_date AS DATE)) > 1 THEN
            CAST(CAST(max(invoice_date) AS DATE) - CAST(min(invoice_date) AS DATE) AS DOUBLE)
            / (count(DISTINCT CAST(invoice_date AS DATE)) - 1) END AS mean_days_between_purchase_days,
       CAST(count(*) FILTER (in30) AS DOUBLE) AS orders_30d, CAST(count(*) FILTER (in90) AS DOUBLE) AS orders_90d,
       CAST(count(*) FILTER (in180) AS DOUBLE) AS orders_180d, CAST(count(*) FILTER (in365) AS DOUBLE) AS orders_365d,
       CAST(coalesce(sum(s30), 0) AS DOUBLE) AS spend_30d_gbp, CAST(coalesce(sum(s90), 0) AS DOUBLE) AS spend_90d_gbp,
       CAST(coalesce(sum(s180), 0) AS DOUBLE) AS spend_180d_gbp, CAST(coalesce(sum(s365), 0) AS DOUBLE) AS spend_365d_gbp
      FROM {source} GROUP BY customer_id, cutoff)"""


CTES["rfm"] = _rfm("inv")
CTES["diversity"] = """
SELECT customer_id, cutoff, count(DISTINCT stock_code) AS product_diversity
FROM sold JOIN cutoffs ON purchase_day < cutoff GROUP BY ALL"""
CTES["credit"] = """
SELECT customer_id, cutoff,
       CAST(coalesce(sum(credit_amount_abs) FILTER (credit_day >= cutoff - 365), 0) AS DOUBLE) AS credit_amount_365d_gbp,
       count(DISTINCT invoice_id) AS credit_invoices
FROM credited JOIN cutoffs ON credit_day < cutoff GROUP BY ALL"""
CTES["weekly"] = """
SELECT customer_id, cutoff, CAST((purchase_day - (cutoff - 182)) // 7 AS INTEGER) AS week_index,
       count(DISTINCT invoice_id) AS orders, greatest(CAST(sum(revenue) AS DOUBLE), 0) AS revenue_gbp,
       greatest(sum(quantity), 0) AS units, count(DISTINCT stock_code) AS product_codes
FROM sold JOIN cutoffs ON purchase_day < cutoff AND purchase_day >= cutoff - 182 GROUP BY ALL"""
CTES["firsts"] = """
SELECT customer_id, cutoff, f AS first_day
FROM (SELECT customer_id, min(purchase_day) AS f FROM sold GROUP BY 1) JOIN cutoffs ON f < cutoff"""


def _labels(horizon: Horizon, cutoffs=I.CUTOFFS, firsts: str = "firsts") -> str:
    ends = ", ".join(f"(DATE '{c}', DATE '{horizon.end(c)}')" for c in cutoffs)
    return f"""
SELECT customer_id, cutoff, '{horizon.name}' AS horizon, horizon_end_exclusive, label_mature,
       CASE WHEN label_mature THEN n END AS future_invoice_count,
       CASE WHEN label_mature THEN rev END AS future_revenue_gbp,
       CASE WHEN label_mature THEN first_at END AS first_future_purchase,
       CASE WHEN label_mature THEN days END AS future_purchase_days,
       CASE WHEN label_mature THEN CAST(n > 0 AS BIGINT) END AS returned,
       CASE WHEN label_mature THEN CAST(n = 0 AS BIGINT) END AS inactive
FROM (SELECT c.customer_id, c.cutoff, w.e AS horizon_end_exclusive,
             w.e <= (SELECT max(purchase_day) FROM sold) AS label_mature,
             count(DISTINCT invoice_id) AS n, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS rev,
             min(invoice_date) AS first_at, count(DISTINCT purchase_day) AS days
      FROM {firsts} c JOIN (VALUES {ends}) w(c, e) ON w.c = c.cutoff
      LEFT JOIN sold s ON s.customer_id = c.customer_id AND s.purchase_day >= c.cutoff AND s.purchase_day < w.e
      GROUP BY c.customer_id, c.cutoff, w.e)"""


CTES["y90"] = _labels(NINETY_DAYS)
CTES["y6m"] = _labels(SIX_MONTHS)
CTES["month_starts"] = f"SELECT CAST(col0 AS DATE) AS cutoff FROM (VALUES {dates(I.MONTHLY)}) t(col0)"
CTES["month_inv"] = CTES["inv"].replace("JOIN cutoffs", "JOIN month_starts")
CTES["month_rfm"] = _rfm("month_inv")
CTES["month_firsts"] = CTES["firsts"].replace("JOIN cutoffs", "JOIN month_starts")
CTES["month_labels"] = (_labels(NINETY_DAYS, I.MONTHLY, "month_firsts") + "\nUNION ALL" + _labels(SIX_MONTHS, I.MONTHLY, "month_firsts"))
CTES["daily"] = "SELECT customer_id, purchase_day, sum(revenue) AS spend FROM sold GROUP BY ALL"
CTES["summary"] = """
SELECT customer_id, cutoff, first_day, max(purchase_day) AS last_day, count(*) AS occasions, count(*) - 1 AS frequency,
       CAST(max(purchase_day) - first_day AS DOUBLE) / CAST(30.436875 AS DOUBLE) AS recency_months,
       CAST(cutoff - first_day AS DOUBLE) / CAST(30.436875 AS DOUBLE) AS age_months,
       nullif(count(*) FILTER (purchase_day > first_day), 0) AS repeat_day_count,
       CAST(sum(spend) FILTER (purchase_day > first_day) AS DOUBLE)
           / nullif(count(*) FILTER (purchase_day > first_day), 0) AS repeat_mean_daily_spend,
       count(*) FILTER (purchase_day > first_day AND month(purchase_day) >= 10) AS q4_repeat_count
FROM daily JOIN firsts USING (customer_id) WHERE purchase_day < cutoff GROUP BY customer_id, cutoff, first_day"""
_SPLIT = (f"CASE cutoff WHEN DATE '{I.FINAL}' THEN 'final_test' WHEN DATE '{I.CALIBRATION}' THEN 'calibration' "
          f"WHEN DATE '{I.DEVELOPMENT}' THEN 'development' ELSE 'training' END")
CTES["scores"] = f"""
SELECT 'recency_curve' AS model, {_SPLIT} AS split, customer_id, cutoff, inactive AS y, recency_days / (recency_days + 90) AS p
FROM rfm JOIN y90 USING (customer_id, cutoff)
UNION ALL
SELECT 'order_count', {_SPLIT}, customer_id, cutoff, inactive, CAST(1 AS DOUBLE) / (orders_365d + 1)
FROM rfm JOIN y90 USING (customer_id, cutoff)"""
CTES["forecasts"] = f"""
SELECT 'recent_spend' AS model, {_SPLIT} AS split, customer_id, cutoff, future_revenue_gbp AS actual, spend_90d_gbp AS predicted
FROM rfm JOIN y90 USING (customer_id, cutoff)
UNION ALL
SELECT 'run_rate', {_SPLIT}, customer_id, cutoff, future_revenue_gbp, lifetime_revenue_gbp / history_days * 90
FROM rfm JOIN y90 USING (customer_id, cutoff)"""


def _threshold(capacity: str) -> str:
    return f"""
SELECT model, split, cutoff, y, pc, n, k, place <= k AS chosen
FROM (SELECT *, least(greatest(p, CAST(1e-8 AS DOUBLE)), 1 - CAST(1e-8 AS DOUBLE)) AS pc,
             row_number() OVER (PARTITION BY model, split, cutoff ORDER BY p DESC, customer_id) AS place,
             count(*) OVER (PARTITION BY model, split, cutoff) AS n,
             greatest(1, ceil(count(*) OVER (PARTITION BY model, split, cutoff) * CAST({capacity} AS DOUBLE))) AS k FROM scores)"""


CTES["placed10"] = _threshold("0.10")
CTES["placed07"] = _threshold("0.07")
CTES["curve"] = """
SELECT *, sum(pos) OVER w AS cum_pos, sum(alln) OVER w AS cum_all, sum(pos) OVER g AS total_pos, sum(alln) OVER g AS total
FROM (SELECT model, split, cutoff, p, sum(y) AS pos, count(*) AS alln FROM scores GROUP BY ALL)
WINDOW w AS (PARTITION BY model, split, cutoff ORDER BY p DESC), g AS (PARTITION BY model, split, cutoff)"""
CTES["curve_metrics"] = """
SELECT model, split, cutoff,
       sum(CAST(pos AS DOUBLE) / total_pos * (CAST(cum_pos AS DOUBLE) / cum_all)) AS average_precision,
       sum(pos * (CAST((total - total_pos) - (cum_all - cum_pos) AS DOUBLE) + (alln - pos) / CAST(2 AS DOUBLE)))
           / (max(total_pos) * (max(total) - max(total_pos))) AS roc_auc
FROM curve GROUP BY ALL"""


def _capacity(source: str) -> str:
    return f"""
SELECT model, split, cutoff, CAST(sum(y) FILTER (chosen) AS DOUBLE) / max(k) AS precision_at_capacity,
       CAST(sum(y) FILTER (chosen) AS DOUBLE) / greatest(1, sum(y)) AS recall_at_capacity,
       CAST(max(k) AS DOUBLE) / max(n) AS contact_capacity_fraction FROM {source} GROUP BY ALL"""


CTES["cap10"] = _capacity("placed10")
CTES["cap07"] = _capacity("placed07")
CTES["classified"] = """
SELECT model, split, cutoff, count(*) AS n_customers, avg(CAST(y AS DOUBLE)) AS positive_rate,
       CASE WHEN count(*) FILTER (pc >= 0.5) = 0 THEN 0
            ELSE CAST(count(*) FILTER (pc >= 0.5 AND y = 1) AS DOUBLE) / count(*) FILTER (pc >= 0.5) END AS precision_threshold_0_5,
       CASE WHEN sum(y) = 0 THEN 0
            ELSE CAST(count(*) FILTER (pc >= 0.5 AND y = 1) AS DOUBLE) / sum(y) END AS recall_threshold_0_5,
       CASE WHEN count(*) FILTER (pc >= 0.5) + sum(y) = 0 THEN 0
            ELSE 2 * CAST(count(*) FILTER (pc >= 0.5 AND y = 1) AS DOUBLE) / (count(*) FILTER (pc >= 0.5) + sum(y)) END AS f1_threshold_0_5,
       avg((pc - y) * (pc - y)) AS brier_score, avg(-ln(CASE WHEN y = 1 THEN pc ELSE 1 - pc END)) AS log_loss
FROM placed10 GROUP BY ALL"""
CTES["revenue"] = """
SELECT model, split, cutoff, n_customers, a AS actual_revenue_gbp, b AS predicted_revenue_gbp, b - a AS aggregate_bias_gbp,
       CASE WHEN a <> 0 THEN (b - a) / a END AS aggregate_bias_pct, mae_gbp, rmse_gbp,
       CASE WHEN a <> 0 THEN top / a END AS revenue_capture_at_capacity, top AS actual_at_capacity_gbp, tweedie_deviance_p1_5
FROM (SELECT model, split, cutoff, count(*) AS n_customers, sum(actual) AS a, sum(predicted) AS b,
             avg(abs(actual - predicted)) AS mae_gbp, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse_gbp,
             sum(CASE WHEN place <= greatest(1, ceil(n * CAST(0.10 AS DOUBLE))) THEN actual ELSE 0 END) AS top,
             avg(4 * (actual / sqrt(greatest(predicted, CAST(1e-6 AS DOUBLE))) + sqrt(greatest(predicted, CAST(1e-6 AS DOUBLE)))
                      - 2 * sqrt(actual))) AS tweedie_deviance_p1_5
      FROM (SELECT *, row_number() OVER (PARTITION BY model, split, cutoff ORDER BY predicted DESC, customer_id) AS place,
                   count(*) OVER (PARTITION BY model, split, cutoff) AS n FROM forecasts)
      GROUP BY model, split, cutoff)"""


def _board(where: str = "TRUE") -> str:
    return f"""
SELECT model, avg(mae_gbp) AS mean_mae_gbp, avg(rmse_gbp) AS mean_rmse_gbp, avg(abs(aggregate_bias_pct)) AS mean_absolute_bias_pct,
       avg(aggregate_bias_pct) AS mean_signed_bias_pct, avg(tweedie_deviance_p1_5) AS mean_tweedie_deviance,
       avg(revenue_capture_at_capacity) AS mean_revenue_capture_top10, count(DISTINCT cutoff) AS n_origins
FROM revenue WHERE {where} GROUP BY model"""


_DONE = ", ".join(f"DATE '{c}'" for c in I.CUTOFFS if NINETY_DAYS.end(c) <= I.FINAL)
_DONE_COUNT = sum(NINETY_DAYS.end(c) <= I.FINAL for c in I.CUTOFFS)
CTES["board"] = _board()
CTES["combined"] = f"""
SELECT customer_id, cutoff, country, recency_days / (recency_days + 90) AS inactive_probability_90d,
       spend_90d_gbp AS predicted_revenue_90d_gbp, avg_order_value_gbp, spend_365d_gbp, recency_days,
       recency_days / (recency_days + 90) * avg_order_value_gbp AS review_priority_score,
       CAST(purchase_count >= 8 AS INTEGER) AS kmeans_segment
FROM rfm WHERE cutoff = DATE '{I.FINAL}'"""


def _group(risk: str, value: str) -> str:
    g = REVIEW_GROUPS
    return (f"CASE WHEN avg_order_value_gbp >= {value} AND inactive_probability_90d >= {risk} THEN '{g[0]}' "
            f"WHEN avg_order_value_gbp >= {value} THEN '{g[1]}' WHEN inactive_probability_90d >= {risk} THEN '{g[2]}' ELSE '{g[3]}' END")


_TIES = "inactive_probability_90d DESC, predicted_revenue_90d_gbp DESC, customer_id"
CTES["grouped"] = f"SELECT *, {_group('CAST(0.6 AS DOUBLE)', '100000')} AS review_group FROM combined"


def _queue(source: str, column: str, capacity: str) -> str:
    return f"""
SELECT *, review_rank <= ceil(filtered_population_customers * CAST({capacity} AS DOUBLE)) AS in_review_queue
FROM (SELECT *, row_number() OVER (ORDER BY {column} DESC, {_TIES}) AS review_rank,
             count(*) OVER () AS filtered_population_customers FROM {source})"""


CTES["seg_profile"] = f"""
SELECT CAST(purchase_count >= 8 AS INTEGER) AS segment, median(purchase_day_count) AS m
FROM rfm WHERE cutoff = DATE '{I.CALIBRATION}' GROUP BY 1"""
CTES["seg_label"] = """
SELECT segment, concat('Segment ', segment,
       CASE WHEN (SELECT count(*) FROM seg_profile) <> 2 OR (SELECT min(m) = max(m) FROM seg_profile) THEN ''
            WHEN m = (SELECT max(m) FROM seg_profile) THEN ': repeat purchase history' ELSE ': sparse purchase history' END) AS segment_label
FROM seg_profile"""
CTES["threshold"] = f"SELECT quantile_cont(avg_order_value_gbp, 0.75) AS v FROM rfm WHERE cutoff = DATE '{I.CALIBRATION}'"
CTES["labelled_review"] = f"""
SELECT c.*, coalesce(segment_label, concat('Segment ', kmeans_segment)) AS segment_label,
       {_group('0.5', '(SELECT v FROM threshold)')} AS review_group,
       CAST(0.5 AS DOUBLE) AS risk_threshold, (SELECT v FROM threshold) AS historical_order_value_threshold_gbp
FROM combined c LEFT JOIN seg_label ON kmeans_segment = segment"""
CTES["review"] = _queue("labelled_review", "review_priority_score", "0.10")
CTES["segs"] = f"""
SELECT *, least(3, purchase_count // 5) AS segment, least(3, CAST(floor(recency_days / 150) AS BIGINT)) AS other_segment
FROM rfm JOIN diversity USING (customer_id, cutoff) WHERE cutoff = DATE '{I.CALIBRATION}'"""
CTES["index_rows"] = "SELECT segment, {} FROM segs GROUP BY segment".format(", ".join(
    f"median({c}) / (SELECT median({c}) FROM segs) AS {c}" for c in SEGMENT_FEATURES))

_ORDER = list(CTES)


def _used(sql: str, found: set[str]) -> set[str]:
    import re
    for name in _ORDER:
        if name not in found and re.search(rf"\b{name}\b", sql):
            found.add(name)
            _used(CTES[name], found)
    return found


def oracle(name: str, sql: str, extra: dict[str, str] | None = None) -> None:
    """Register ``sql`` with the common tables it needs."""
    local = extra or {}
    needed = _used(" ".join([sql, *local.values()]), set())
    parts = [f"{n} AS ({CTES[n]})" for n in _ORDER if n in needed] + [f"{n} AS ({s})" for n, s in local.items()]
    ORACLES[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


# --- Ingestion ------------------------------------------------------------------------

_RAW8 = "invoice_id, stock_code, description, quantity, invoice_date, unit_price, customer_id, country"
oracle("batch_profile", """SELECT source_sheet, count(*) AS rows, min(invoice_date) AS date_min, max(invoice_date) AS date_max,
count(*) FILTER (customer_id IS NULL) AS missing_customer_rows FROM raw GROUP BY 1""")
oracle("reconcile_lines", f"""SELECT invoice_id, stock_code, description, quantity, invoice_date, {r('unit_price')} AS unit_price,
customer_id, country, source_sheet, source_row, source_sheet_role FROM (
SELECT *, row_number() OVER (PARTITION BY {_RAW8} ORDER BY batch_order, source_row) AS copy,
       max(copies) OVER (PARTITION BY {_RAW8}) AS allowed
FROM (SELECT *, count(*) OVER (PARTITION BY {_RAW8}, source_sheet) AS copies FROM raw)) WHERE copy <= allowed""")
oracle("quality_counters", """SELECT (SELECT count(*) FROM raw) AS raw_lines,
(SELECT count(*) FROM raw) - count(*) AS overlap_excess_lines_removed, count(*) AS reconciled_lines,
count(*) FILTER (quantity > 0 AND unit_price > 0 AND NOT is_credit AND customer_id IS NOT NULL AND is_product) AS identified_purchase_lines,
count(*) FILTER (is_credit AND quantity < 0 AND customer_id IS NOT NULL) AS identified_credit_lines,
count(*) FILTER (quantity > 0 AND unit_price > 0 AND NOT is_credit AND customer_id IS NULL AND is_product) AS anonymous_candidate_purchase_lines,
count(*) FILTER (quantity > 0 AND unit_price > 0 AND NOT is_credit AND customer_id IS NOT NULL AND NOT is_product)
    AS known_customer_nonproduct_sale_lines_excluded,
count(*) FILTER (customer_id IS NULL) AS missing_customer_ids, count(*) FILTER (is_credit) AS cancel_prefix_lines,
count(*) FILTER (quantity < 0 AND NOT is_credit) AS negative_quantity_lines_without_cancel_prefix,
count(*) FILTER (unit_price <= 0) AS nonpositive_price_lines FROM lines""")
_LINE = f"invoice_id, stock_code, invoice_date, quantity, {r('unit_price')} AS unit_price, customer_id, country, source_sheet, source_row"
oracle("purchase_lines", f"SELECT {_LINE}, {r('revenue')} AS revenue, purchase_day FROM sold")
oracle("credit_lines", f"SELECT {_LINE}, {r('credit_amount_abs')} AS credit_amount_abs, credit_day FROM credited")
oracle("purchase_invoices", f"""SELECT customer_id, invoice_id, min(invoice_date) AS invoice_date, {r('sum(revenue)')} AS revenue,
sum(quantity) AS units, count(*) AS line_count, count(DISTINCT stock_code) AS product_count,
last(country ORDER BY line_position) AS country FROM sold GROUP BY customer_id, invoice_id""")
ORACLES["prepared_invoices"] = ORACLES["purchase_invoices"]

# --- Panel ----------------------------------------------------------------------------

_RFM = ["recency_days", "tenure_days", "history_days", "lifetime_revenue_gbp", "avg_order_value_gbp", "median_order_value_gbp",
        "max_order_value_gbp", "avg_basket_units", "avg_basket_lines", "mean_days_between_purchase_days", "purchase_days_per_30d",
        "revenue_per_history_day_gbp"]
_WINDOWS = [f"orders_{n}d" for n in (30, 90, 180, 365)] + [f"spend_{n}d_gbp" for n in (30, 90, 180, 365)]
_RATIO = "(spend_90d_gbp + 1) / (spend_180d_gbp - spend_90d_gbp + 1)"
oracle("customer_rfm", f"""SELECT customer_id, cutoff, country, first_purchase, last_purchase, purchase_count, purchase_day_count,
repeat_purchase_day_count, {rs(*_RFM)} FROM rfm""")
oracle("trailing_windows", f"SELECT customer_id, cutoff, {rs(*_WINDOWS)}, {r(_RATIO)} AS spend_recent90_over_prior90 FROM rfm")
oracle("product_diversity", "SELECT * FROM diversity")
oracle("credit_features", f"SELECT customer_id, cutoff, {rs('credit_amount_365d_gbp')}, credit_invoices FROM credit")
oracle("weekly_bins", f"SELECT customer_id, cutoff, week_index, orders, {rs('revenue_gbp', 'units')}, product_codes FROM weekly")
oracle("dense_weeks", f"""SELECT f.customer_id, f.cutoff,
CAST(26 - count(w.week_index) OVER (PARTITION BY f.customer_id, f.cutoff) AS BIGINT) AS zero_purchase_weeks_26w, CAST(i AS INTEGER) AS week_index,
{r('CAST(coalesce(w.orders, 0) AS FLOAT)')} AS orders, {r('CAST(coalesce(w.revenue_gbp, 0) AS FLOAT)')} AS revenue_gbp,
{r('CAST(coalesce(w.units, 0) AS FLOAT)')} AS units, {r('CAST(coalesce(w.product_codes, 0) AS FLOAT)')} AS product_codes,
{r('CASE WHEN w.week_index IS NULL THEN 0 ELSE 1 END')} AS has_purchase,
{r('CASE WHEN i >= least(25, greatest(0, floor((first_day - (f.cutoff - 182)) / 7))) THEN 1 ELSE 0 END')} AS after_first_observed_purchase
FROM firsts f CROSS JOIN range(26) g(i) LEFT JOIN weekly w
ON w.customer_id = f.customer_id AND w.cutoff = f.cutoff AND w.week_index = i""")
oracle("customer_panel", f"""SELECT customer_id, cutoff, country, first_purchase, last_purchase, CAST(90 AS INTEGER) AS horizon_days,
{rs(*_RFM, 'purchase_count', 'purchase_day_count', 'repeat_purchase_day_count', 'product_diversity', *_WINDOWS)},
{r(_RATIO)} AS spend_recent90_over_prior90,
{r('coalesce(credit_invoices, 0) / CAST(greatest(purchase_count, 1) AS DOUBLE)')} AS return_invoice_rate,
{r('coalesce(credit_amount_365d_gbp, 0)')} AS credit_amount_365d_gbp,
{r('26 - coalesce(active, 0)')} AS zero_purchase_weeks_26w
FROM rfm JOIN diversity USING (customer_id, cutoff) LEFT JOIN credit USING (customer_id, cutoff)
LEFT JOIN (SELECT customer_id, cutoff, count(*) AS active FROM weekly GROUP BY ALL) USING (customer_id, cutoff)""")
_EV = f"DATE '{I.EVENT_CUTOFF}'"
oracle("event_recency", f"""SELECT customer_id, cutoff, {rs('recency_days', 'tenure_days')}, purchase_count, purchase_day_count,
{rs('mean_days_between_purchase_days', 'lifetime_revenue_gbp', 'median_order_value_gbp', 'orders_30d')} FROM ev_rfm""", {
    "ev": f"""SELECT user_id AS customer_id, {_EV} AS cutoff, CAST(event_id AS VARCHAR) AS invoice_id, ts AS invoice_date,
              CAST(value AS DECIMAL(18, 2)) AS revenue, 1.0 AS units, 1 AS lines, event_id AS first_position, 'Unknown' AS country,
              CAST(ts AS DATE) >= {_EV} - 30 AS in30, TRUE AS in90, TRUE AS in180, TRUE AS in365,
              0 AS s30, 0 AS s90, 0 AS s180, 0 AS s365
              FROM events WHERE event_type = 'purchase' AND ts < {_EV}""",
    "ev_rfm": _rfm("ev")})
_LABEL = f"""customer_id, cutoff, horizon, horizon_end_exclusive, label_mature, CAST(future_invoice_count AS BIGINT) AS future_invoice_count,
{rs('future_revenue_gbp')}, first_future_purchase, CAST(future_purchase_days AS BIGINT) AS future_purchase_days, returned, inactive"""
oracle("targets_90d", f"SELECT {_LABEL} FROM y90")
oracle("targets_6m", f"SELECT {_LABEL} FROM y6m")
_MONTH = f"""SELECT customer_id, cutoff, horizon, {rs('recency_days')}, purchase_count, {rs('orders_90d', 'spend_90d_gbp', 'avg_order_value_gbp')},
horizon_end_exclusive, label_mature, {rs('future_revenue_gbp')}, inactive FROM month_labels JOIN month_rfm USING (customer_id, cutoff)"""
oracle("monthly_panel", _MONTH)
oracle("quarterly_six_months", _MONTH + " WHERE horizon = '6m' AND month(cutoff) IN (3, 6, 9, 12)")
oracle("cohort_summary", f"""SELECT cutoff, count(DISTINCT customer_id) AS customers, {r('avg(inactive)')} AS inactive_rate,
CAST(sum(returned) AS BIGINT) AS returned, {r('sum(future_revenue_gbp)')} AS future_revenue_gbp,
count(*) FILTER (orders_365d > 0) AS active_365d_customers FROM y90 JOIN rfm USING (customer_id, cutoff) GROUP BY cutoff""")
oracle("available_training_rows", """SELECT o.cutoff AS origin, horizon, count(*) AS train_rows, max(horizon_end_exclusive) AS latest_label_end
FROM cutoffs o JOIN (SELECT * FROM y90 UNION ALL SELECT * FROM y6m) y
ON y.cutoff < o.cutoff AND y.label_mature AND y.horizon_end_exclusive <= o.cutoff GROUP BY ALL""")
oracle("purchase_day_summary", f"""SELECT customer_id, cutoff, first_day, last_day, occasions, frequency,
{rs('recency_months', 'age_months')}, repeat_day_count, {rs('repeat_mean_daily_spend')} FROM summary""")
oracle("history_extras", f"""SELECT customer_id, cutoff, q4_repeat_count, country, {r(f"CASE WHEN country = '{I.HOME}' THEN 0 ELSE 1 END")} AS foreign
FROM summary JOIN (SELECT customer_id, cutoff, last(country ORDER BY invoice_date, line_position) AS country
FROM sold JOIN cutoffs ON purchase_day < cutoff GROUP BY ALL) USING (customer_id, cutoff)""")
oracle("purchase_gaps", """SELECT customer_id, purchase_day, CAST(purchase_day - lag(purchase_day) OVER
(PARTITION BY customer_id ORDER BY purchase_day) AS INTEGER) AS gap_days FROM (SELECT DISTINCT customer_id, purchase_day FROM sold)""")


def _enriched(horizon: Horizon) -> str:
    rows = []
    for c in I.CUTOFFS:
        low = add_months(c, -12)
        high = add_months(horizon.end(c), -12) if horizon.months else horizon.end(low)
        rows.append(f"(DATE '{c}', DATE '{horizon.end(c)}', DATE '{low}', DATE '{high}')")
    return f"""SELECT customer_id, cutoff, CAST(e - cutoff AS INTEGER) AS horizon_days,
{r('sin(2 * pi() * (month(cutoff) - 1) / 12)')} AS cutoff_month_sin, {r('cos(2 * pi() * (month(cutoff) - 1) / 12)')} AS cutoff_month_cos,
{r('(SELECT count(*) FROM range(CAST(e - cutoff AS BIGINT)) g(i) WHERE month(cutoff + CAST(i AS INTEGER)) >= 10) / CAST(e - cutoff AS DOUBLE)')}
    AS forecast_q4_share,
{r('CASE WHEN orders_30d > 0 THEN spend_30d_gbp / orders_30d END')} AS recent_order_value_30d,
{r('CASE WHEN orders_90d > 0 THEN spend_90d_gbp / orders_90d END')} AS recent_order_value_90d,
{r('greatest(spend_180d_gbp - spend_90d_gbp, 0)')} AS prior_90d_spend_gbp,
{r('recency_days / greatest(mean_days_between_purchase_days, 1 + 0 * mean_days_between_purchase_days)')} AS recency_over_mean_gap,
{r('last_order_value_gbp')} AS last_order_value_gbp, {r('order_value_std_gbp')} AS order_value_std_gbp,
{r('CASE WHEN low >= (SELECT min(purchase_day) FROM sold) THEN coalesce(ly_spend, 0) END')} AS spend_same_future_window_last_year_gbp,
{r('CASE WHEN low >= (SELECT min(purchase_day) FROM sold) THEN coalesce(ly_orders, 0) END')} AS orders_same_future_window_last_year
FROM rfm JOIN (VALUES {', '.join(rows)}) w(c, e, low, high) ON w.c = cutoff
JOIN (SELECT customer_id, cutoff, last(CAST(revenue AS DOUBLE) ORDER BY last_at, first_position) AS last_order_value_gbp,
      stddev_samp(CAST(revenue AS DOUBLE)) AS order_value_std_gbp FROM inv GROUP BY ALL) USING (customer_id, cutoff)
LEFT JOIN (SELECT customer_id, c AS cutoff, sum(revenue) AS ly_spend, count(DISTINCT invoice_id) AS ly_orders
      FROM sold JOIN (VALUES {', '.join(rows)}) w(c, e, low, high) ON purchase_day >= low AND purchase_day < high GROUP BY ALL)
USING (customer_id, cutoff)"""


oracle("enriched_features", _enriched(NINETY_DAYS))
oracle("enriched_features_6m", _enriched(SIX_MONTHS))
oracle("person_periods", """SELECT cutoff, period, count(*) AS at_risk, count(*) FILTER (period = event_period) AS events
FROM (SELECT cutoff, CASE WHEN returned = 1 THEN least(12, (CAST(first_future_purchase AS DATE) - cutoff) // 7) END AS event_period
      FROM y90 WHERE label_mature) JOIN range(13) g(period) ON period <= coalesce(event_period, 12) GROUP BY ALL""")

# --- Audit ----------------------------------------------------------------------------

oracle("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_rows, "
    f"{r(f'count(*) FILTER ({c} IS NULL) / CAST(count(*) AS DOUBLE) * 100')} AS null_pct FROM raw" for c in _RAW8.split(", ")))
oracle("monthly_profile", f"""SELECT strftime(invoice_date, '%Y-%m') AS month, count(*) AS rows,
count(*) FILTER (customer_id IS NULL) AS missing_customer_rows, count(DISTINCT customer_id) AS known_customers,
{r('count(*) FILTER (customer_id IS NULL) / CAST(count(*) AS DOUBLE) * 100')} AS missing_customer_pct FROM raw GROUP BY 1""")
oracle("special_codes", """SELECT stock_code, count(*) AS rows, first(description ORDER BY batch_order, source_row, description) AS description_example
FROM lines WHERE NOT is_product GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
oracle("duplicate_summary", f"""SELECT CAST(sum(copies - 1) AS BIGINT) AS exact_duplicate_excess_rows,
CAST(coalesce(sum(copies) FILTER (copies > 1), 0) AS BIGINT) AS rows_in_exact_duplicate_groups,
count(*) FILTER (batches > 1) AS cross_batch_duplicate_rows
FROM (SELECT {_RAW8}, count(*) AS copies, count(DISTINCT source_sheet) AS batches FROM raw GROUP BY ALL)""")
oracle("duplicate_excess_by_month", f"""SELECT strftime(invoice_date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS excess_rows
FROM (SELECT invoice_date, row_number() OVER (PARTITION BY {_RAW8}) AS n FROM raw) WHERE n > 1 GROUP BY 1""")
oracle("first_copies", f"""SELECT invoice_id, stock_code, description, quantity, invoice_date, {r('unit_price')} AS unit_price, customer_id, country,
       source_sheet, source_row, source_sheet_role, batch_order, count(*) OVER copies AS copies
FROM raw WINDOW copies AS (PARTITION BY {_RAW8}), ordered AS (PARTITION BY {_RAW8} ORDER BY batch_order, source_row)
QUALIFY row_number() OVER ordered = 1""")
oracle("exact_dedup_count", f"SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT {_RAW8} FROM raw)")
oracle("key_consistency", " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) AS violations FROM (SELECT {k} FROM lines WHERE {w} GROUP BY {k} HAVING count(DISTINCT {v}) > 1)"
    for n, k, v, w in [
        ("invoice_ids_with_multiple_known_customers", "invoice_id", "customer_id", "customer_id IS NOT NULL"),
        ("invoice_ids_with_multiple_timestamps", "invoice_id", "invoice_date", "TRUE"),
        ("invoice_ids_with_multiple_countries", "invoice_id", "country", "TRUE"),
        ("customer_ids_with_multiple_countries", "customer_id", "country", "customer_id IS NOT NULL")]))
oracle("distinct_counts", """SELECT count(DISTINCT customer_id) AS distinct_known_customers, count(DISTINCT invoice_id) AS distinct_invoice_ids,
count(DISTINCT stock_code) AS distinct_stock_codes, count(DISTINCT country) AS distinct_countries FROM lines""")
oracle("anomaly_counters", """SELECT count(*) FILTER (is_credit) AS cancel_prefix_rows, count(*) FILTER (quantity < 0) AS negative_quantity_rows,
count(*) FILTER (is_credit AND NOT quantity < 0) AS cancel_prefix_nonnegative_quantity_rows,
count(*) FILTER (quantity < 0 AND NOT is_credit) AS negative_quantity_without_cancel_prefix_rows,
count(*) FILTER (quantity = 0) AS zero_quantity_rows, count(*) FILTER (unit_price <= 0) AS nonpositive_price_rows,
count(*) FILTER (unit_price < 0) AS negative_price_rows, count(*) FILTER (NOT is_product) AS nonproduct_code_rows,
count(*) FILTER (quantity > 0 AND unit_price > 0 AND NOT is_credit) AS positive_noncancel_rows_all_ids,
count(*) FILTER (quantity > 0 AND unit_price > 0 AND NOT is_credit AND customer_id IS NOT NULL) AS identified_positive_noncancel_rows,
count(DISTINCT customer_id) FILTER (quantity > 0 AND unit_price > 0 AND NOT is_credit) AS identified_positive_noncancel_customers
FROM lines""")
oracle("value_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {r(str(p))} AS probability, {r(f'quantile_cont({c}, {p})')} AS quantile FROM lines"
    for c in ("quantity", "unit_price") for p in (0.0, 0.01, 0.5, 0.99, 1.0)))
oracle("order_value_quantiles", " UNION ALL ".join(
    f"SELECT {r(str(p))} AS probability, {r(f'quantile_cont(v, {p})')} AS quantile, count(*) AS n FROM orders_v"
    for p in (0.5, 0.9, 0.99, 1.0)), {
    "orders_v": "SELECT CAST(sum(revenue) AS DOUBLE) AS v FROM sold GROUP BY customer_id, invoice_id"})
CUSTOMERS = """SELECT customer_id, count(*) AS lines, count(DISTINCT invoice_id) AS orders, count(DISTINCT purchase_day) AS days,
sum(revenue) AS revenue FROM sold GROUP BY 1"""
oracle("scenario_counts", f"""SELECT CAST(sum(lines) AS BIGINT) AS candidate_product_rows, CAST(sum(orders) AS BIGINT) AS orders,
count(*) AS customers, count(*) FILTER (orders = 1) AS one_order_customers, count(*) FILTER (orders > 1) AS repeat_order_customers,
count(*) FILTER (days > 1) AS repeat_purchase_day_customers, count(*) FILTER (days = 1) AS one_purchase_day_customers,
{r('sum(revenue)')} AS positive_sales_revenue_gbp FROM buyers""", {"buyers": CUSTOMERS})
oracle("revenue_concentration", "SELECT " + ", ".join(
    r(f"CAST(sum(revenue) FILTER (place <= greatest(1, ceil(n * CAST({p} AS DOUBLE)))) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) * 100")
    + f" AS top_{name}pct_customer_revenue_share_pct" for p, name in ((0.01, 1), (0.1, 10))) + " FROM placed_buyers", {
    "buyers": CUSTOMERS,
    "placed_buyers": "SELECT *, row_number() OVER (ORDER BY revenue DESC, customer_id) AS place, count(*) OVER () AS n FROM buyers"})
oracle("snapshot_feasibility", f"""SELECT cutoff, horizon_days, cutoff + CAST(horizon_days AS INTEGER) AS label_end_exclusive, seen AS fully_observed,
historical_customers, active_within_365d_customers, CASE WHEN seen THEN back END AS returned_customers,
{r('CASE WHEN seen THEN gone / CAST(historical_customers AS DOUBLE) * 100 END')} AS inactivity_pct_all_history,
{r('CASE WHEN seen THEN gone_recent / CAST(nullif(active_within_365d_customers, 0) AS DOUBLE) * 100 END')} AS inactivity_pct_active_365d,
{r('CASE WHEN seen THEN revenue END')} AS future_positive_sales_revenue_gbp FROM (
SELECT cutoff, horizon_days, cutoff + CAST(horizon_days AS INTEGER) <= any_value(safe_end) AS seen,
       count(*) AS historical_customers, count(*) FILTER (recent) AS active_within_365d_customers,
       count(*) FILTER (n > 0) AS back, count(*) FILTER (n = 0) AS gone, count(*) FILTER (n = 0 AND recent) AS gone_recent,
       sum(rev) AS revenue
FROM (SELECT p.customer_id, p.cutoff, horizon_days, recent, count(DISTINCT invoice_id) AS n, coalesce(sum(revenue), 0) AS rev
      FROM (SELECT customer_id, cutoff, max(purchase_day) >= cutoff - 365 AS recent FROM sold JOIN cutoffs ON purchase_day < cutoff GROUP BY customer_id, cutoff) p
      CROSS JOIN (VALUES (CAST(90 AS BIGINT)), (180)) h(horizon_days)
      LEFT JOIN sold s ON s.customer_id = p.customer_id AND s.purchase_day >= p.cutoff AND s.purchase_day < p.cutoff + CAST(horizon_days AS INTEGER)
      GROUP BY ALL) CROSS JOIN (SELECT max(purchase_day) AS safe_end FROM sold) GROUP BY cutoff, horizon_days)""")
oracle("absent_dates_by_weekday", """SELECT dayname(d) AS weekday, count(*) AS dates_without_rows
FROM (SELECT unnest(range(min(x), max(x) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM days) WHERE CAST(d AS DATE) NOT IN (SELECT x FROM days)
GROUP BY 1""", {"days": "SELECT DISTINCT CAST(invoice_date AS DATE) AS x FROM lines WHERE is_credit AND NOT is_product"})
oracle("partition_checks", """SELECT * FROM (VALUES ('batch_rows_sum_to_total', CAST(0 AS BIGINT)), ('one_order_plus_repeat_is_customers', 0),
('unfinished_windows_are_null', 0), ('rates_within_0_100', 0)) t(check_name, violations)""")

# --- Metrics --------------------------------------------------------------------------

_CAP = ["precision_at_capacity", "recall_at_capacity", "contact_capacity_fraction"]
oracle("classification_metrics", f"""SELECT model, split, cutoff, n_customers, {rs('positive_rate', 'precision_threshold_0_5',
'recall_threshold_0_5', 'f1_threshold_0_5', 'brier_score', 'log_loss', *_CAP, 'average_precision', 'roc_auc')}
FROM classified JOIN cap10 USING (model, split, cutoff) JOIN curve_metrics USING (model, split, cutoff)""")
oracle("capacity_metrics", f"SELECT model, split, cutoff, {rs(*_CAP)} FROM cap07")
oracle("ranking_metrics", f"SELECT model, split, cutoff, {rs('average_precision', 'roc_auc')} FROM curve_metrics")
_REV = ["actual_revenue_gbp", "predicted_revenue_gbp", "aggregate_bias_gbp", "aggregate_bias_pct", "mae_gbp", "rmse_gbp",
        "revenue_capture_at_capacity", "actual_at_capacity_gbp", "tweedie_deviance_p1_5"]
oracle("revenue_metrics", f"SELECT model, split, cutoff, n_customers, {rs(*_REV)} FROM revenue")
oracle("interval_diagnostics", f"""SELECT model, split, cutoff, outcome_group, count(*) AS customers,
{r('avg(CASE WHEN actual BETWEEN predicted * 0.5 AND predicted * 2 + 1000 THEN 1.0 ELSE 0.0 END)')} AS coverage,
{r('avg(predicted * 2 + 1000 - predicted * 0.5)')} AS mean_width_gbp
FROM forecasts JOIN (VALUES ('all'), ('positive'), ('zero')) g(outcome_group)
ON outcome_group = 'all' OR (outcome_group = 'positive' AND actual > 0) OR (outcome_group = 'zero' AND actual = 0) GROUP BY ALL""")
oracle("error_diagnostics", f"""SELECT model, split, cutoff, count(*) AS n, {r('avg(CASE WHEN actual = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_fraction,
{r('sum(CASE WHEN top THEN actual ELSE 0 END) / sum(actual)')} AS top1pct_revenue_fraction,
{r('sum(CASE WHEN top THEN predicted - actual ELSE 0 END)')} AS top1pct_signed_error_gbp,
{r('sum(predicted - actual)')} AS all_signed_error_gbp,
{r('avg(predicted) FILTER (actual = 0)')} AS zero_customer_mean_prediction_gbp,
{r('avg(abs(predicted - actual)) FILTER (actual > 0)')} AS positive_customer_mae_gbp
FROM (SELECT *, row_number() OVER (PARTITION BY model, split, cutoff ORDER BY actual DESC, customer_id)
      <= ceil(count(*) OVER (PARTITION BY model, split, cutoff) * CAST(0.01 AS DOUBLE)) AS top FROM forecasts) GROUP BY ALL""")
_PAIR = """SELECT customer_id, cutoff, a.actual, a.predicted AS pa, b.predicted AS pb FROM forecasts a JOIN forecasts b USING (customer_id, cutoff)
WHERE a.model = 'recent_spend' AND b.model = 'run_rate'"""
oracle("blend", f"SELECT customer_id, cutoff, {r('actual')} AS actual, {r('(pa + pb) / 2')} AS predicted FROM pairs", {"pairs": _PAIR})
_DEV = "4 * (actual / sqrt(greatest({0}, CAST(1e-6 AS DOUBLE))) + sqrt(greatest({0}, CAST(1e-6 AS DOUBLE))) - 2 * sqrt(actual))"
oracle("paired_improvement", f"""SELECT metric, count(*) FILTER (d > 0) AS positive_origin_improvements, count(*) AS origins,
{r('avg(d)')} AS mean_improvement FROM (
SELECT 'mae' AS metric, cutoff, avg(abs(actual - pa) - abs(actual - pb)) AS d FROM pairs GROUP BY cutoff
UNION ALL SELECT 'deviance', cutoff, avg({_DEV.format('pa')} - {_DEV.format('pb')}) FROM pairs GROUP BY cutoff) GROUP BY metric""",
       {"pairs": _PAIR})
oracle("pairing_report", f"""SELECT count(*) FILTER (cutoff >= DATE '2001-01-01') AS only_left, CAST(0 AS BIGINT) AS only_right,
{r('0')} AS max_actual_difference FROM rfm""")
oracle("prediction_guards", f"""SELECT count(*) FILTER (predicted - 1000 <= 0) AS floored, {r('min(greatest(predicted - 1000, 0))')} AS lowest,
CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS not_finite FROM forecasts""")

# --- Selection ------------------------------------------------------------------------

_BOARD = ["mean_mae_gbp", "mean_rmse_gbp", "mean_absolute_bias_pct", "mean_signed_bias_pct", "mean_tweedie_deviance",
          "mean_revenue_capture_top10"]
oracle("leaderboard", f"SELECT model, {rs(*_BOARD)}, n_origins FROM board")
oracle("eligible_models", f"""SELECT model, {rs(*_BOARD)}, n_origins, CAST({_DONE_COUNT} AS BIGINT) AS expected_origins,
n_origins = {_DONE_COUNT} AS eligible FROM open_board""", {"open_board": _board(
    f"cutoff IN ({_DONE}) AND NOT (model = 'run_rate' AND cutoff = DATE '2000-06-01')")})
oracle("selected_revenue_model", f"""SELECT model, {rs('mean_tweedie_deviance')}, n_origins FROM open_board
ORDER BY open_board.mean_tweedie_deviance, mean_absolute_bias_pct, mean_rmse_gbp, model LIMIT 1""",
       {"open_board": _board(f"cutoff IN ({_DONE})")})
oracle("selected_by_error", """SELECT 'future_revenue_90d' AS task, model AS selected_model, model AS development_metric_winner
FROM board ORDER BY mean_mae_gbp, mean_absolute_bias_pct, model LIMIT 1""")
oracle("selected_inactivity_model", """SELECT 'inactivity_90d' AS task, 'order_count' AS selected_model, model AS development_metric_winner
FROM classified JOIN cap10 USING (model, split, cutoff) JOIN curve_metrics USING (model, split, cutoff) WHERE split = 'development'
ORDER BY precision_at_capacity DESC, average_precision DESC, brier_score, model LIMIT 1""")
_6M = ", ".join(f"DATE '{c}'" for c in I.CUTOFFS if SIX_MONTHS.end(c) <= I.FINAL)
oracle("split_tags", f"""SELECT model, cutoff, {rs('mae_gbp')},
CASE WHEN cutoff IN ({_6M}) THEN 'development' ELSE 'retrospective_robustness' END AS split FROM revenue""")
oracle("summary_rows", f"""SELECT 'future_revenue_90d' AS task, model, split, CAST(cutoff AS VARCHAR) AS cutoff,
{rs('mae_gbp', 'rmse_gbp', 'aggregate_bias_pct', 'revenue_capture_at_capacity')}, CAST(NULL AS DOUBLE) AS mean_absolute_origin_bias_pct,
CAST(NULL AS BIGINT) AS n_origins FROM revenue UNION ALL
SELECT 'future_revenue_90d', model, 'development_summary', '{"|".join(map(str, I.CUTOFFS))}', {r('mean_mae_gbp')}, {r('mean_rmse_gbp')},
{r('mean_signed_bias_pct')}, {r('mean_revenue_capture_top10')}, {r('mean_absolute_bias_pct')}, n_origins FROM board""")
oracle("latest_metrics", f"""SELECT model, cutoff, {r("CASE WHEN cutoff >= DATE '2000-12-01' THEN mae_gbp + 1 ELSE mae_gbp END")} AS mae_gbp,
CASE WHEN cutoff >= DATE '2000-12-01' THEN CAST(2 AS BIGINT) ELSE 1 END AS run_order FROM revenue""")
oracle("score_table", f"""SELECT customer_id, cutoff, {r("max(p) FILTER (model = 'recency_curve')")} AS recency_curve_risk,
{r("max(p) FILTER (model = 'order_count')")} AS order_count_risk FROM scores GROUP BY ALL""")
_TRAIN = f"FROM y90 WHERE label_mature AND cutoff < DATE '{I.FINAL}' AND horizon_end_exclusive <= DATE '{I.FINAL}'"
oracle("revenue_baselines", f"""SELECT customer_id, cutoff, {r(f'(SELECT avg(future_revenue_gbp) {_TRAIN})')} AS training_mean_baseline,
{r(f'(SELECT median(future_revenue_gbp) {_TRAIN})')} AS training_median_baseline,
{r('lifetime_revenue_gbp / history_days * 90')} AS historical_spend_rate_baseline, {r('spend_90d_gbp')} AS recent_90d_spend_baseline
FROM rfm JOIN y90 USING (customer_id, cutoff) WHERE cutoff = DATE '{I.FINAL}' AND label_mature""")
oracle("prevalence_baseline", f"""SELECT customer_id, cutoff, {r(f"(SELECT avg(inactive) FROM y90 WHERE cutoff IN ({', '.join(f'DATE {chr(39)}{c}{chr(39)}' for c in I.TRAINING)}))")} AS p
FROM y90 WHERE cutoff = DATE '{I.DEVELOPMENT}'""")

# --- Behaviour with fixed parameters -----------------------------------------------------

oracle("alive_probability", f"""SELECT customer_id, cutoff, {r('''CASE WHEN frequency = 0 THEN 1 ELSE 1 / (1 + exp(
(0.8::DOUBLE + frequency) * ln((8 + age_months) / (8 + recency_months)) + ln(1.4::DOUBLE / (3 + greatest(frequency, 1) - 1)))) END''')} AS alive FROM summary""")
oracle("conditional_spend", f"""SELECT customer_id, cutoff, {r('''CASE WHEN frequency = 0 THEN 40000 * 2.0::DOUBLE / (3 - 1)
ELSE 2 * (40000 + frequency * coalesce(repeat_mean_daily_spend, 0)) / CAST(2 * frequency + 3 - 1 AS DOUBLE) END''')} AS expected_spend FROM summary""")

# --- Segments -----------------------------------------------------------------------------

oracle("adjusted_rand", f"SELECT {r('(i - x * y / t) / ((x + y) / 2 - x * y / t)')} AS adjusted_rand FROM sums", {
    "cells": "SELECT segment, other_segment, count(*) AS c FROM segs GROUP BY ALL",
    "sums": """SELECT (SELECT sum(c * (c - 1) / 2.0::DOUBLE) FROM cells) AS i,
        (SELECT sum(a * (a - 1) / 2.0::DOUBLE) FROM (SELECT sum(c) AS a FROM cells GROUP BY segment)) AS x,
        (SELECT sum(a * (a - 1) / 2.0::DOUBLE) FROM (SELECT sum(c) AS a FROM cells GROUP BY other_segment)) AS y,
        (SELECT sum(c) * (sum(c) - 1) / 2.0::DOUBLE FROM cells) AS t"""})
oracle("segment_profile", "SELECT segment, count(*) AS customers, " + r("count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM segs)")
       + " AS customer_share, " + ", ".join(f"{r(f'median({c})')} AS {c}_median" for c in SEGMENT_FEATURES) + " FROM segs GROUP BY segment")
oracle("profile_index", f"SELECT segment, {rs(*SEGMENT_FEATURES)} FROM index_rows")
oracle("profile_index_by_feature", " UNION ALL ".join(
    f"SELECT '{FEATURE_TITLES.get(c, c)}' AS feature, " + ", ".join(
        f"{r(f'max({c}) FILTER (segment = {s})')} AS segment_{s}" for s in range(4)) + " FROM index_rows" for c in SEGMENT_FEATURES))
oracle("davies_bouldin", f"""SELECT {r('avg(worst)')} AS davies_bouldin FROM (
SELECT a.segment, max((a.s + b.s) / sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS worst
FROM spread a JOIN spread b ON a.segment <> b.segment GROUP BY 1)""", {
    "pts": "SELECT segment, ln(1 + lifetime_revenue_gbp) AS x, ln(1 + recency_days) AS y FROM segs",
    "centre": "SELECT segment, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1",
    "spread": "SELECT segment, cx, cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s FROM pts JOIN centre USING (segment) GROUP BY ALL"})
oracle("holdout_outcomes", f"""SELECT method, CAST(segment AS BIGINT) AS segment, count(*) AS customers, {r('avg(inactive)')} AS inactivity_rate,
{r('avg(future_revenue_gbp)')} AS mean_future_revenue_gbp, {r('sum(future_revenue_gbp)')} AS total_future_revenue_gbp,
{r('median(future_revenue_gbp)')} AS median_future_revenue_gbp FROM (
SELECT 'kmeans' AS method, CAST(purchase_count >= 8 AS INTEGER) AS segment, inactive, future_revenue_gbp
FROM rfm JOIN y90 USING (customer_id, cutoff) WHERE cutoff = DATE '{I.FINAL}' AND label_mature
UNION ALL SELECT 'gmm', least(2, CAST(floor(recency_days / 200) AS INTEGER)), inactive, future_revenue_gbp
FROM rfm JOIN y90 USING (customer_id, cutoff) WHERE cutoff = DATE '{I.FINAL}' AND label_mature) GROUP BY ALL""")

# --- Review -------------------------------------------------------------------------------

_SCORES = ["inactive_probability_90d", "predicted_revenue_90d_gbp", "avg_order_value_gbp", "review_priority_score"]
oracle("retention_review", f"""SELECT customer_id, cutoff, country, {rs(*_SCORES)}, cutoff + 90 AS forecast_end_exclusive, segment_label,
review_group, {rs('risk_threshold', 'historical_order_value_threshold_gbp')}, review_rank, in_review_queue,
'{POLICIES["risk_value"][1]}' AS ranking_policy, {r('0.10')} AS review_capacity_fraction, filtered_population_customers FROM review""")
oracle("review_summary", f"""SELECT segment_label, review_group, count(*) AS customers, count(*) FILTER (in_review_queue) AS queue_customers,
{r('avg(inactive_probability_90d)')} AS mean_inactivity_probability, {r('sum(predicted_revenue_90d_gbp)')} AS predicted_revenue_90d_gbp,
{r('median(avg_order_value_gbp)')} AS median_historical_order_value_gbp FROM review GROUP BY ALL""")
oracle("filtered_ranking", f"""SELECT customer_id, cutoff, review_group, {rs('spend_365d_gbp')}, review_rank, in_review_queue,
filtered_population_customers FROM queue""", {
    "kept": """SELECT * FROM grouped WHERE kmeans_segment = 1 AND country = 'NATION_3' AND inactive_probability_90d >= 0.3
               AND contains(CAST(customer_id AS VARCHAR), '1')""",
    "queue": _queue("kept", "spend_365d_gbp", "0.25")})
oracle("policy_comparison", " UNION ALL ".join(
    f"""SELECT '{k}' AS policy, '{title}' AS ranking, count(*) AS customers, {r('avg(inactive_probability_90d)')} AS mean_inactivity_probability,
{r('median(avg_order_value_gbp)')} AS median_historical_order_value_gbp, {r('coalesce(sum(predicted_revenue_90d_gbp), 0)')} AS predicted_revenue_90d_gbp
FROM ({_queue('combined', column, '0.07')}) WHERE in_review_queue""" for k, (column, title) in POLICIES.items()))
_GROUPS = ", ".join(f"('{g}')" for g in REVIEW_GROUPS)
oracle("queue_by_group", f"""SELECT review_group, selection, count(c) AS customers
FROM (VALUES {_GROUPS}) g(review_group) CROSS JOIN (VALUES ('In review queue', TRUE), ('Outside queue', FALSE)) s(selection, flag)
LEFT JOIN (SELECT review_group AS rg, in_review_queue AS q, customer_id AS c FROM queue) ON rg = review_group AND q = flag
GROUP BY review_group, selection""", {"queue": _queue("grouped", "inactive_probability_90d", "0.2")})
oracle("review_headline", f"""SELECT count(*) AS filtered_customers, count(*) FILTER (in_review_queue) AS queue_customers,
{r('avg(inactive_probability_90d) FILTER (in_review_queue)')} AS queue_mean_inactivity_probability,
{r('coalesce(sum(predicted_revenue_90d_gbp) FILTER (in_review_queue), 0)')} AS queue_expected_revenue_gbp FROM queue""",
       {"queue": _queue("grouped", "predicted_revenue_90d_gbp", "0.1")})
_RISK_VALUE = {"queue": _queue("grouped", "review_priority_score", "0.1")}
oracle("review_points", f"""SELECT customer_id, {rs('avg_order_value_gbp')}, review_group, {r('inactive_probability_90d * 100')} AS inactivity_percent,
CASE WHEN in_review_queue THEN 'In review queue' ELSE 'Outside queue' END AS queue_status FROM queue""", _RISK_VALUE)
oracle("queue_display", f"""SELECT review_rank, customer_id, review_group, country, {r('inactive_probability_90d * 100')} AS inactive_probability_90d,
{r('recency_days')} AS recency_days FROM queue WHERE in_review_queue ORDER BY review_rank LIMIT 100""", _RISK_VALUE)
oracle("coverage_report", f"""SELECT 'risk' AS source, count(*) FILTER (NOT inactive_probability_90d < 0.9) AS missing_keys, CAST(0 AS BIGINT) AS extra_keys FROM combined
UNION ALL SELECT 'revenue', CAST(0 AS BIGINT), count(*) FROM rfm WHERE cutoff = DATE '{I.CALIBRATION}'""")
oracle("top_risk", f"""SELECT customer_id, cutoff, {r('p')} AS inactive_90d_probability FROM scores
WHERE model = 'recency_curve' AND split = 'final_test' ORDER BY p DESC, customer_id LIMIT 500""")
oracle("top_forecasts", f"""SELECT customer_id, cutoff, 'run_rate' AS selected_model, {r('predicted')} AS predicted_revenue_gbp FROM forecasts
WHERE model = 'run_rate' AND split = 'final_test' ORDER BY predicted DESC, customer_id LIMIT 100""")
oracle("model_comparison", f"""SELECT model, split, n_customers, {rs('precision_at_capacity', 'average_precision', 'roc_auc', 'brier_score')}
FROM classified JOIN cap10 USING (model, split, cutoff) JOIN curve_metrics USING (model, split, cutoff)
WHERE split IN ('development', 'final_test')""")
oracle("precision_by_split", "SELECT model, " + ", ".join(
    f"{r(f'''max(average_precision) FILTER (split = '{s}')''')} AS {s}" for s in ("development", "calibration", "final_test"))
       + " FROM curve_metrics WHERE split <> 'training' GROUP BY model")
