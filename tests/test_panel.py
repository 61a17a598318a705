from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import enrich, history, ingest, panel, targets
from ledgerloom.settings import KEYS, NINETY_DAYS, SIX_MONTHS, Horizon, add_months, month_starts

CUTOFFS = [date(2010, 6, 1), date(2010, 9, 1)]


def sold(spark, rows):
    """Purchase lines from (customer, invoice, time, product, quantity, price, country)."""
    df = spark.createDataFrame(
        [(str(i), s, None, float(q), t, float(p), c, k, "A", 0, n) for n, (c, i, t, s, q, p, k) in enumerate(rows)],
        "invoice_id string, stock_code string, description string, quantity double, invoice_date string, unit_price double, "
        "customer_id bigint, country string, source_sheet string, batch_order int, source_row bigint")
    return ingest.purchase_lines(ingest.standardise(df))


BASE = [(1, 10, "2010-05-31 23:00:00", "11111", 1, 10, "UK"), (1, 10, "2010-06-01 01:00:00", "22222", 2, 10, "FR"),
        (1, 11, "2010-03-01 12:00:00", "11111", 1, 5, "UK"), (2, 12, "2010-01-01 08:00:00", "33333", 3, 1, None),
        (1, 13, "2010-08-30 00:00:00", "44444", 1, 7, "UK")]


@pytest.fixture(scope="module")
def lines(spark):
    return sold(spark, BASE)


@pytest.fixture(scope="module")
def snapshots(spark, lines):
    rows = panel.build_panel(lines, lines.limit(0).withColumn("credit_amount_abs", F.col("revenue")).withColumn(
        "credit_day", F.col("purchase_day")), CUTOFFS).collect()
    return {(r["customer_id"], r["cutoff"]): r for r in rows}


def test_lines_are_cut_before_invoices(snapshots):
    early, late = snapshots[1, CUTOFFS[0]], snapshots[1, CUTOFFS[1]]
    assert early["purchase_count"] == 2 and early["lifetime_revenue_gbp"] == 15 and early["product_diversity"] == 1
    assert early["country"] == "UK" and early["recency_days"] == pytest.approx(1 / 24)
    assert late["purchase_count"] == 3 and late["lifetime_revenue_gbp"] == 42 and late["product_diversity"] == 3
    # The invoice keeps its earliest timestamp for recency but counts as recent through its last line.
    assert late["orders_90d"] == 1 and late["orders_180d"] == 2 and late["spend_180d_gbp"] == 37
    assert late["median_order_value_gbp"] == 7


def test_one_day_customer(snapshots):
    row = snapshots[2, CUTOFFS[0]]
    assert row["mean_days_between_purchase_days"] is None and row["country"] is None
    assert row["zero_purchase_weeks_26w"] == 25 and row["repeat_purchase_day_count"] == 0


def test_weeks_add_up_to_the_window(snapshots):
    for (customer, cutoff), row in snapshots.items():
        weeks = row["weeks"]
        assert len(weeks) == 26 and sum(w["has_purchase"] for w in weeks) == 26 - row["zero_purchase_weeks_26w"]
        flags = [w["after_first_observed_purchase"] for w in weeks]
        assert flags == sorted(flags) and flags[-1] == 1
    assert sum(w["revenue_gbp"] for w in snapshots[1, CUTOFFS[0]]["weeks"]) == 15


def test_later_lines_change_no_feature(spark, lines):
    extra = sold(spark, BASE + [(1, 99, "2010-06-01 00:00:00", "55555", 9, 9, "DE"), (3, 98, "2010-06-02 00:00:00", "55555", 9, 9, "DE")])
    first = panel.order_features(panel.invoices_as_of(history.history_grain(lines), CUTOFFS[:1]))
    second = panel.order_features(panel.invoices_as_of(history.history_grain(extra.repartition(5)), CUTOFFS[:1]))
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def test_median_of_a_customer_with_many_invoices(spark, lines):
    invoices = spark.range(9000).select(
        F.when(F.col("id") < 8000, 1).otherwise(2 + F.col("id") % 50).cast("bigint").alias("customer_id"),
        F.lit(CUTOFFS[0]).alias("cutoff"), F.pmod(F.xxhash64("id"), F.lit(100000)).alias("revenue_units"))
    want = {r["customer_id"]: r["m"] for r in invoices.groupBy("customer_id").agg(
        (F.median("revenue_units") / 10000).alias("m")).collect()}
    got = {r["customer_id"]: r["median_order_value_gbp"] for r in panel.median_order_values(invoices).collect()}
    assert got == pytest.approx(want)


def test_country_changes_are_followed(spark):
    df = sold(spark, [(1, 1, "2010-01-01 00:00:00", "11111", 1, 1, "UK"), (1, 2, "2010-07-01 00:00:00", "11111", 1, 1, "FR"),
                      (1, 2, "2010-07-01 00:00:00", "11111", 1, 1, "DE"), (2, 3, "2010-01-01 00:00:00", "11111", 1, 1, "UK")])
    got = {(r["customer_id"], r["cutoff"]): r["country"] for r in history.last_country(df, CUTOFFS).collect()}
    assert got == {(1, CUTOFFS[0]): "UK", (1, CUTOFFS[1]): "DE", (2, CUTOFFS[0]): "UK", (2, CUTOFFS[1]): "UK"}


def test_labels_are_end_exclusive_and_mature(spark, lines):
    cohort = history.cohort(lines, CUTOFFS)
    rows = {(r["customer_id"], r["cutoff"], r["horizon"]): r for r in
            targets.build_targets(lines, cohort, CUTOFFS, date(2010, 8, 30)).collect()}
    first = rows[1, CUTOFFS[0], "90d"]  # window ends on 2010-08-30, the day of the next purchase
    assert first["label_mature"] and first["future_invoice_count"] == 1 and first["future_revenue_gbp"] == 20
    assert rows[2, CUTOFFS[0], "90d"]["inactive"] == 1 and rows[2, CUTOFFS[0], "90d"]["future_revenue_gbp"] == 0
    late = rows[1, CUTOFFS[1], "6m"]
    assert not late["label_mature"] and late["inactive"] is None and late["future_revenue_gbp"] is None
    more = sold(spark, BASE + [(2, 50, "2010-08-30 00:00:00", "11111", 1, 1, "UK")])
    again = {(r["customer_id"], r["cutoff"], r["horizon"]): r for r in
             targets.build_targets(more, cohort, CUTOFFS, date(2010, 8, 30)).collect()}
    assert again[2, CUTOFFS[0], "90d"] == rows[2, CUTOFFS[0], "90d"]


def test_training_uses_finished_outcomes_only(spark):
    rows = spark.createDataFrame(
        [(i, c, add_months(c, 6), True) for i, c in enumerate(month_starts(date(2010, 6, 1), date(2011, 1, 1)))],
        "customer_id int, cutoff date, horizon_end_exclusive date, label_mature boolean")
    got = [r["cutoff"] for r in targets.available_training(rows, date(2011, 2, 1)).orderBy("cutoff").collect()]
    assert got == [date(2010, 6, 1), date(2010, 7, 1), date(2010, 8, 1)]


def test_person_periods(spark):
    rows = spark.createDataFrame([(1, date(2010, 6, 1), 1, "2010-06-16 10:00:00"), (2, date(2010, 6, 1), 0, None),
                                  (3, date(2010, 6, 1), 1, "2010-08-29 10:00:00")],
                                 "customer_id int, cutoff date, returned int, first_future_purchase string")
    rows = rows.withColumn("first_future_purchase", F.col("first_future_purchase").cast("timestamp_ntz"))
    out = targets.person_periods(rows).groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("event").alias("e")).orderBy("customer_id").collect()
    assert [(r["n"], r["e"]) for r in out] == [(3, 1), (13, 0), (13, 1)]
    assert targets.period_grid(rows).count() == 39


def test_calendar(spark):
    assert add_months(date(2010, 8, 31), 6) == date(2011, 2, 28) and SIX_MONTHS.length(date(2010, 6, 1)) == 183
    row = enrich.forecast_calendar(spark, [date(2010, 10, 1)], Horizon("q", days=92)).first()
    assert row["forecast_q4_share"] == 1 and row["horizon_days"] == 92
    row = enrich.forecast_calendar(spark, [date(2010, 9, 1)], NINETY_DAYS).first()
    assert row["forecast_q4_share"] == pytest.approx(60 / 90)


def test_unseen_source_year_is_null(spark, lines):
    grain = history.history_grain(lines)
    base = panel.order_features(panel.invoices_as_of(grain, CUTOFFS)).withColumn("horizon_days", F.lit(90))
    rows = enrich.enriched_features(base, grain, CUTOFFS, date(2010, 1, 1), NINETY_DAYS).collect()
    assert all(r["spend_same_future_window_last_year_gbp"] is None for r in rows)
    rows = enrich.enriched_features(base, grain, CUTOFFS, date(2009, 1, 1), NINETY_DAYS).collect()
    assert all(r["spend_same_future_window_last_year_gbp"] == 0 for r in rows)
    assert {r["order_value_std_gbp"] for r in rows if r["customer_id"] == 2} == {None}


def test_lines_are_moved_once_and_not_per_cutoff(spark, lines):
    """No exchange lies behind the repetition for every cutoff; it moved each invoice once per cutoff."""
    features = panel.order_features(panel.invoices_as_of(history.history_grain(lines, 3), CUTOFFS))
    for rows in (features, panel.median_order_values(panel.invoices_as_of(history.history_grain(lines, 3), CUTOFFS), 3),
                 panel.product_features(lines, CUTOFFS, 3)):
        moves = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]
        assert len(moves) == 1 and "hashpartitioning(customer_id" in moves[0] and "REPARTITION_BY_NUM" in moves[0], moves
    old = panel.order_features(panel.invoices_as_of(history.history_grain(lines), CUTOFFS))
    assert sorted(map(tuple, features.collect()), key=str) == sorted(map(tuple, old.collect()), key=str)


def test_parts_give_the_same_panel_and_hot_customers_are_built_apart(spark, lines, monkeypatch, tmp_path):
    more = sold(spark, BASE + [(3, 20 + i, f"2010-0{1 + i % 8}-1{i % 9} 10:00:00", f"1111{i % 7}", 1, 1 + i, "DE" if i % 3 else "UK") for i in range(40)])
    more.write.parquet(str(tmp_path / "sold"))
    stored = spark.read.parquet(str(tmp_path / "sold"))
    credits = stored.limit(0).withColumn("credit_amount_abs", F.col("revenue")).withColumn("credit_day", F.col("purchase_day"))
    expected = panel.build_panel(stored, credits, CUTOFFS)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    seen = []

    def build(tables, parts):
        seen.append(parts)
        return panel.build_panel(*tables, CUTOFFS, parts=parts)

    assert rows(history.by_customer([stored, credits], CUTOFFS, build)) == rows(expected)
    monkeypatch.setattr(history, "HOT_LINES", 30)
    assert rows(history.by_customer([stored, credits], CUTOFFS, build)) == rows(expected)
    assert seen[0] and seen[1] and seen[2] is None and len(seen) == 3


def test_branches_of_a_panel_are_joined_where_they_lie(spark, lines, tmp_path, monkeypatch):
    """Each join on customer and cutoff moved both sides again, into a number of partitions that does not grow with them."""
    lines.write.parquet(str(tmp_path / "sold"))
    stored = spark.read.parquet(str(tmp_path / "sold"))
    credits = stored.limit(0).withColumn("credit_amount_abs", F.col("revenue")).withColumn("credit_day", F.col("purchase_day"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = history.by_customer([stored, credits], CUTOFFS, lambda tables, parts: targets.label_panel(
            panel.build_panel(*tables, CUTOFFS, parts=parts),
            targets.build_targets(tables[0], history.cohort(tables[0], CUTOFFS, parts), CUTOFFS, date(2011, 9, 1), parts=parts), parts))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plain = targets.label_panel(panel.build_panel(stored, credits, CUTOFFS), targets.build_targets(
        stored, history.cohort(stored, CUTOFFS), CUTOFFS, date(2011, 9, 1)))
    assert rows.columns == plain.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joined_is_a_join_on_all_keys(spark, how):
    left = spark.createDataFrame([(1, CUTOFFS[0], "a"), (1, CUTOFFS[1], "b"), (1, CUTOFFS[1], "b2"), (2, CUTOFFS[0], "c"), (None, CUTOFFS[0], "d")],
                                 "customer_id bigint, cutoff date, x string")
    right = spark.createDataFrame([(1, CUTOFFS[1], "p"), (1, CUTOFFS[1], "q"), (2, CUTOFFS[1], "r"), (None, CUTOFFS[0], "s")], "customer_id bigint, cutoff date, y string")
    found, plain = history.joined(left, right, 3, how), left.join(right, KEYS, how)
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
