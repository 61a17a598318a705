"""Registered queries over the given tables that have an SQL counterpart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerloom.operators import (audit, dashboards, enrich, history, ingest, metrics, models, panel, review, segments,
                                  selection, targets)
from ledgerloom.operators.behaviour import BetaGeoNbd, GammaGamma
from ledgerloom.operators.ordering import exact_quantiles
from ledgerloom.plans import inputs as I
from ledgerloom.scratch import materialise
from ledgerloom.settings import (KEYS, NINETY_DAYS, SEGMENT_FEATURES, SIX_MONTHS, WEEK_CHANNELS)
from ledgerloom.sources import extracts, retail

QUERIES = {}


def query(f):
    """Register a query; doubles are returned at six decimals."""
    QUERIES[f.__name__] = lambda spark, folder: I.rounded(f(spark, folder))
    return f


# --- Ingestion ------------------------------------------------------------------------


@query
def batch_profile(spark, d):
    return extracts.batch_profile(ingest.standardise(retail.raw_batches(spark, d)))


@query
def reconcile_lines(spark, d):
    kept = ingest.standardise(ingest.reconcile(retail.raw_batches(spark, d)))
    return kept.select("invoice_id", "stock_code", "description", "quantity", "invoice_date", "unit_price",
                       "customer_id", "country", "source_sheet", "source_row", "source_sheet_role")


@query
def quality_counters(spark, d):
    raw = retail.raw_batches(spark, d)
    return ingest.quality_counters(raw, ingest.standardise(ingest.reconcile(raw)))


@query
def purchase_lines(spark, d):
    return I.purchases(spark, d).drop("line_position").withColumn("revenue", F.col("revenue").cast("double"))


@query
def credit_lines(spark, d):
    return I.credits(spark, d).withColumn("credit_amount_abs", F.col("credit_amount_abs").cast("double"))


@query
def purchase_invoices(spark, d):
    return ingest.purchase_invoices(I.purchases(spark, d))


# --- Panel ----------------------------------------------------------------------------


@query
def customer_rfm(spark, d):
    def build(tables, parts):
        invoices = panel.invoices_as_of(history.history_grain(*tables, parts), I.CUTOFFS)
        invoices = materialise(invoices, "invoices") if parts is None else invoices
        rows = history.joined(panel.order_features(invoices), panel.median_order_values(invoices, parts), parts, "left")
        return history.joined(rows, history.last_country(*tables, I.CUTOFFS, parts=parts), parts, "left")

    rows = history.by_customer([I.stored_purchases(spark, d)], I.CUTOFFS, build)
    return rows.select(
        *KEYS, "country", "first_purchase", "last_purchase", "recency_days", "tenure_days", "history_days", "purchase_count",
        "purchase_day_count", "repeat_purchase_day_count", "lifetime_revenue_gbp", "avg_order_value_gbp",
        "median_order_value_gbp", "max_order_value_gbp", "avg_basket_units", "avg_basket_lines",
        "mean_days_between_purchase_days", "purchase_days_per_30d", "revenue_per_history_day_gbp")


@query
def trailing_windows(spark, d):
    return I.order_rows(spark, d).select(
        *KEYS, *[f"orders_{n}d" for n in (30, 90, 180, 365)], *[f"spend_{n}d_gbp" for n in (30, 90, 180, 365)],
        "spend_recent90_over_prior90")


@query
def product_diversity(spark, d):
    return panel.product_features(I.purchases(spark, d), I.CUTOFFS)


@query
def credit_features(spark, d):
    return panel.credit_features(I.credits(spark, d), I.CUTOFFS)


@query
def weekly_bins(spark, d):
    return panel.weekly_bins(I.purchases(spark, d), I.CUTOFFS)


@query
def dense_weeks(spark, d):
    sold = I.purchases(spark, d)
    firsts = history.as_of(sold.groupBy("customer_id").agg(
        F.min("invoice_date").alias("first_purchase"), F.min("purchase_day").alias("_d")), "_d", I.CUTOFFS)
    weeks = panel.dense_weeks(panel.weekly_bins(sold, I.CUTOFFS), firsts)
    return weeks.select(*KEYS, "zero_purchase_weeks_26w", F.posexplode("weeks").alias("week_index", "w")).select(
        *KEYS, "zero_purchase_weeks_26w", "week_index", *[F.col(f"w.{c}").cast("double").alias(c) for c in WEEK_CHANNELS])


@query
def customer_panel(spark, d):
    credited = materialise(I.credits(spark, d).select("customer_id", "invoice_id", "credit_day", "credit_amount_abs"), "credited")
    return history.by_customer([I.stored_purchases(spark, d), credited], I.CUTOFFS, lambda tables, parts: panel.build_panel(
        *tables, I.CUTOFFS, parts=parts)).drop("weeks")


@query
def event_recency(spark, d):
    """Snapshots of the event stream: fractional-second timestamps and day-based windows."""
    invoices = materialise(panel.invoices_as_of(history.history_grain(I.event_purchases(spark, d)), [I.EVENT_CUTOFF]), "invoices")
    rows = panel.order_features(invoices).join(panel.median_order_values(invoices), KEYS)
    return rows.select(*KEYS, "recency_days", "tenure_days", "purchase_count", "purchase_day_count",
                       "mean_days_between_purchase_days", "lifetime_revenue_gbp", "median_order_value_gbp", "orders_30d")


def _targets(spark, d, horizon):
    return I.target_rows(spark, d, [horizon]).select(
        *KEYS, "horizon", F.col("horizon_end_exclusive"), "label_mature", F.col("future_invoice_count").cast("bigint"),
        "future_revenue_gbp", "first_future_purchase", F.col("future_purchase_days").cast("bigint"),
        F.col("returned").cast("bigint"), F.col("inactive").cast("bigint"))


@query
def targets_90d(spark, d):
    return _targets(spark, d, NINETY_DAYS)


@query
def targets_6m(spark, d):
    return _targets(spark, d, SIX_MONTHS)


def _monthly(rows):
    return rows.select(*KEYS, "horizon", "recency_days", "purchase_count", "orders_90d", "spend_90d_gbp", "avg_order_value_gbp",
                       "horizon_end_exclusive", "label_mature", "future_revenue_gbp", F.col("inactive").cast("bigint").alias("inactive"))


@query
def monthly_panel(spark, d):
    """Snapshots at 16 month starts with the labels of both horizons."""
    return _monthly(I.monthly_panel(spark, d))


@query
def quarterly_six_months(spark, d):
    """The six-month rows of the monthly panel's quarter starts."""
    return _monthly(I.quarterly(I.monthly_panel(spark, d).filter(F.col("horizon") == SIX_MONTHS.name)))


@query
def prepared_invoices(spark, d):
    """The invoice mart of the reconciled extracts, written and read back."""
    return I.prepared_tables(spark, d).invoices


@query
def cohort_summary(spark, d):
    sold = I.stored_purchases(spark, d)
    return targets.cohort_summary(I.target_rows(spark, d, [NINETY_DAYS], sold), I.order_rows(spark, d, sold=sold))


@query
def available_training_rows(spark, d):
    """Training rows per origin and horizon under label availability."""
    stored = materialise(I.target_rows(spark, d), "targets")
    parts = [targets.available_training(stored, o).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("train_rows"), F.max("horizon_end_exclusive").alias("latest_label_end"))
        .select(F.lit(o).alias("origin"), "*") for o in I.CUTOFFS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def purchase_day_summary(spark, d):
    return history.purchase_day_summary(I.purchases(spark, d), I.CUTOFFS).drop("q4_repeat_count")


@query
def history_extras(spark, d):
    return history.history_summary(I.purchases(spark, d), I.CUTOFFS, I.HOME).select(
        *KEYS, "q4_repeat_count", "country", "foreign")


@query
def purchase_gaps(spark, d):
    return history.purchase_gaps(I.purchases(spark, d))


def _enriched(spark, d, horizon):
    sold = I.stored_purchases(spark, d)
    start = targets.source_span(sold)[0]

    def build(tables, parts):
        grain = materialise(history.history_grain(*tables), "grain") if parts is None else history.history_grain(*tables, parts)
        base = panel.order_features(panel.invoices_as_of(grain, I.CUTOFFS)).withColumn("horizon_days", F.lit(0))
        return enrich.enriched_features(base, grain, I.CUTOFFS, start, horizon, parts)

    return history.by_customer([sold], I.CUTOFFS, build).select(*KEYS, "horizon_days", *enrich.ENRICHED_COLUMNS)


@query
def enriched_features(spark, d):
    return _enriched(spark, d, NINETY_DAYS)


@query
def enriched_features_6m(spark, d):
    return _enriched(spark, d, SIX_MONTHS)


@query
def person_periods(spark, d):
    rows = targets.person_periods(I.target_rows(spark, d, [NINETY_DAYS]).filter("label_mature"))
    return rows.groupBy("cutoff", F.col("period").cast("bigint").alias("period")).agg(
        F.count(F.lit(1)).alias("at_risk"), F.sum("event").alias("events"))


# --- Audit ----------------------------------------------------------------------------


@query
def null_profile(spark, d):
    return audit.null_profile(ingest.standardise(retail.raw_batches(spark, d)))


@query
def monthly_profile(spark, d):
    return audit.monthly_profile(ingest.standardise(retail.raw_batches(spark, d)))


@query
def special_codes(spark, d):
    return audit.special_codes(I.lines(spark, d))


@query
def duplicate_summary(spark, d):
    return audit.duplicate_summary(retail.raw_batches(spark, d))


@query
def duplicate_excess_by_month(spark, d):
    return audit.duplicate_excess_by_month(retail.raw_batches(spark, d))


@query
def exact_dedup_count(spark, d):
    return ingest.drop_exact_duplicates(retail.raw_batches(spark, d)).agg(F.count(F.lit(1)).alias("distinct_rows"))


@query
def first_copies(spark, d):
    """Global dedup that keeps the first copy of a raw row with its place in the source."""
    return ingest.keep_first(retail.raw_batches(spark, d))


@query
def key_consistency(spark, d):
    return audit.key_consistency(I.lines(spark, d))


@query
def distinct_counts(spark, d):
    return audit.distinct_counts(I.lines(spark, d))


@query
def anomaly_counters(spark, d):
    return audit.anomaly_counters(I.lines(spark, d))


@query
def value_quantiles(spark, d):
    return audit.value_quantiles(I.lines(spark, d), ["quantity", "unit_price"], [0.0, 0.01, 0.5, 0.99, 1.0])


@query
def order_value_quantiles(spark, d):
    orders = I.purchases(spark, d).groupBy("customer_id", "invoice_id").agg(F.sum("revenue").alias("revenue"))
    return exact_quantiles(orders, ["revenue"], [0.5, 0.9, 0.99, 1.0]).select("probability", "quantile", "n")


@query
def scenario_counts(spark, d):
    return audit.scenario_counts(I.purchases(spark, d))


@query
def revenue_concentration(spark, d):
    return audit.revenue_concentration(I.purchases(spark, d))


def _feasibility(spark, d):
    sold = I.purchases(spark, d)
    return audit.snapshot_feasibility(sold, I.CUTOFFS, [90, 180], targets.source_span(sold)[1])


@query
def snapshot_feasibility(spark, d):
    return _feasibility(spark, d).withColumn("horizon_days", F.col("horizon_days").cast("bigint"))


@query
def absent_dates_by_weekday(spark, d):
    """Days without any returned line of postage."""
    return audit.absent_dates_by_weekday(I.lines(spark, d).filter(ingest.is_credit() & ~ingest.is_product()))


@query
def partition_checks(spark, d):
    raw = retail.raw_batches(spark, d)
    total = raw.agg(F.count(F.lit(1)).alias("raw_lines"))
    return audit.partition_checks(extracts.batch_profile(raw), total, audit.scenario_counts(I.purchases(spark, d)),
                                  _feasibility(spark, d))


# --- Metrics --------------------------------------------------------------------------


@query
def classification_metrics(spark, d):
    return metrics.classification_metrics(I.rule_scores(spark, d))


@query
def capacity_metrics(spark, d):
    return metrics.capacity_metrics(I.rule_scores(spark, d), 0.07)


@query
def ranking_metrics(spark, d):
    return metrics.ranking_metrics(I.rule_scores(spark, d))


@query
def revenue_metrics(spark, d):
    return metrics.revenue_metrics(I.rule_forecasts(spark, d))


@query
def interval_diagnostics(spark, d):
    rows = I.rule_forecasts(spark, d).withColumns({"lower": F.col("predicted") * 0.5, "upper": F.col("predicted") * 2 + 1000})
    return metrics.interval_metrics(rows)


@query
def error_diagnostics(spark, d):
    return metrics.error_diagnostics(I.rule_forecasts(spark, d))


@query
def blend(spark, d):
    rows = materialise(I.rule_forecasts(spark, d), "forecasts")
    return metrics.blend(rows.filter("model = 'recent_spend'"), rows.filter("model = 'run_rate'"))


@query
def paired_improvement(spark, d):
    rows = materialise(I.rule_forecasts(spark, d), "forecasts")
    left, right = rows.filter("model = 'recent_spend'"), rows.filter("model = 'run_rate'")
    parts = [metrics.positive_origins(metrics.improvement(left, right, m)).select(F.lit(m).alias("metric"), "*")
             for m in ("mae", "deviance")]
    return parts[0].unionByName(parts[1])


@query
def pairing_report(spark, d):
    rows = materialise(I.rule_forecasts(spark, d), "forecasts")
    return metrics.pairing_report(rows.filter("model = 'recent_spend'"),
                                  rows.filter("model = 'run_rate' AND cutoff < '2001-01-01'"))


@query
def prediction_guards(spark, d):
    rows = materialise(I.rule_forecasts(spark, d), "forecasts")
    shifted = metrics.guarded(rows.withColumn("predicted", F.col("predicted") - 1000.0))
    floored = shifted.agg(F.count_if(F.col("predicted") == 0).alias("floored"), F.min("predicted").alias("lowest"))
    bad = metrics.prediction_violations(shifted.filter("model = 'recent_spend'"), rows.filter("model = 'run_rate'"))
    return floored.withColumn("_one", F.lit(1)).join(F.broadcast(bad.withColumn("_one", F.lit(1))), "_one").drop("_one")


# --- Selection ------------------------------------------------------------------------


def _metric_rows(spark, d):
    return metrics.revenue_metrics(I.rule_forecasts(spark, d)).withColumn("status", F.lit("completed"))


def _ends(spark, horizon):
    return spark.createDataFrame([(c, horizon.end(c)) for c in I.CUTOFFS], "cutoff date, horizon_end_exclusive date")


@query
def leaderboard(spark, d):
    return selection.leaderboard(_metric_rows(spark, d))


@query
def eligible_models(spark, d):
    """Only origins whose 90-day outcomes ended by the final cutoff take part."""
    rows = _metric_rows(spark, d).filter("NOT (model = 'run_rate' AND cutoff = '2000-06-01')")
    return selection.eligible_models(rows, _ends(spark, NINETY_DAYS), I.FINAL)


@query
def selected_revenue_model(spark, d):
    return selection.select_revenue_model(selection.eligible_models(
        _metric_rows(spark, d), _ends(spark, NINETY_DAYS), I.FINAL)).select("model", "mean_tweedie_deviance", "n_origins")


@query
def selected_by_error(spark, d):
    return selection.registry_row(selection.select_by_error(selection.leaderboard(_metric_rows(spark, d))),
                                  "future_revenue_90d")


@query
def selected_inactivity_model(spark, d):
    rows = I.rule_scores(spark, d).filter(F.col("split") == "development")
    return selection.registry_row(selection.select_inactivity_model(metrics.classification_metrics(rows)),
                                  "inactivity_90d", "order_count")


@query
def split_tags(spark, d):
    rows = _metric_rows(spark, d).select("model", "cutoff", "mae_gbp")
    return selection.tag_splits(rows, _ends(spark, SIX_MONTHS), I.FINAL)


@query
def summary_rows(spark, d):
    rows = materialise(_metric_rows(spark, d), "metrics")
    out = selection.append_summary(rows, selection.leaderboard(rows), "future_revenue_90d", I.CUTOFFS)
    return out.select("task", "model", "split", "cutoff", "mae_gbp", "rmse_gbp", "aggregate_bias_pct",
                      "revenue_capture_at_capacity", "mean_absolute_origin_bias_pct", "n_origins")


@query
def latest_metrics(spark, d):
    """A second run replaces the rows of the first one by key."""
    rows = materialise(_metric_rows(spark, d).select("model", "cutoff", "mae_gbp"), "metrics")
    first = rows.withColumn("run_order", F.lit(1))
    second = rows.filter("cutoff >= '2000-12-01'").withColumns({"mae_gbp": F.col("mae_gbp") + 1, "run_order": F.lit(2)})
    return selection.upsert(first, second, ["model", "cutoff"]).withColumn("run_order", F.col("run_order").cast("bigint"))


@query
def score_table(spark, d):
    return selection.score_table(I.rule_scores(spark, d), ["recency_curve", "order_count"], "p", "_risk")


@query
def revenue_baselines(spark, d):
    rows = materialise(I.order_rows(spark, d).join(I.target_rows(spark, d, [NINETY_DAYS]), KEYS), "labelled")
    train, cohort = targets.available_training(rows, I.FINAL), targets.scoring_cohort(rows, I.FINAL)
    return models.revenue_baselines(train, cohort, 90, 90).select(
        *KEYS, "training_mean_baseline", "training_median_baseline", "historical_spend_rate_baseline",
        "recent_90d_spend_baseline")


@query
def prevalence_baseline(spark, d):
    rows = materialise(I.target_rows(spark, d, [NINETY_DAYS]), "targets")
    model = models.Prevalence().fit(rows.filter(F.col("cutoff").isin(I.TRAINING)))
    return model.predict(rows.filter(F.col("cutoff") == F.lit(I.DEVELOPMENT))).select(*KEYS, "p")


# --- Behaviour with fixed parameters -----------------------------------------------------


@query
def alive_probability(spark, d):
    fixed = BetaGeoNbd(r=0.8, alpha=8.0, a=1.4, b=3.0)
    return history.purchase_day_summary(I.purchases(spark, d), I.CUTOFFS).select(*KEYS, fixed.alive().alias("alive"))


@query
def conditional_spend(spark, d):
    fixed = GammaGamma(p=2.0, q=3.0, v=40000.0, training_mean=50000.0)
    return history.purchase_day_summary(I.purchases(spark, d), I.CUTOFFS).select(
        *KEYS, fixed.expected_spend().alias("expected_spend"))


# --- Segments with rule labels --------------------------------------------------------------


@query
def adjusted_rand(spark, d):
    return segments.adjusted_rand(I.rule_segments(spark, d), "segment", "other_segment")


@query
def segment_profile(spark, d):
    return segments.segment_profiles(I.rule_segments(spark, d)).withColumn("segment", F.col("segment").cast("bigint"))


@query
def profile_index(spark, d):
    return segments.profile_index(I.rule_segments(spark, d)).withColumn("segment", F.col("segment").cast("bigint"))


@query
def profile_index_by_feature(spark, d):
    index = segments.profile_index(I.rule_segments(spark, d))
    return dashboards.profile_index_by_feature(index, [0, 1, 2, 3])


@query
def davies_bouldin(spark, d):
    rows = I.rule_segments(spark, d).select(
        "segment", F.log1p("lifetime_revenue_gbp").alias("x"), F.log1p("recency_days").alias("y"))
    return segments.davies_bouldin(rows, ["x", "y"], "segment")


@query
def holdout_outcomes(spark, d):
    sold = I.stored_purchases(spark, d)
    rows, _, _, labels = I.review_sources(spark, d, sold)
    assigned = labels.filter(F.col("cutoff") == F.lit(I.FINAL)).drop("gmm_max_membership")
    return segments.holdout_outcomes(assigned, I.target_rows(spark, d, [NINETY_DAYS], sold)).withColumn(
        "segment", F.col("segment").cast("bigint"))


# --- Review -------------------------------------------------------------------------------


def _review(spark, d, capacity=0.10):
    rows, risk, revenue, labels = I.review_sources(spark, d)
    profiles = segments.segment_profiles(
        rows.filter(F.col("cutoff") == F.lit(I.CALIBRATION)).join(labels, KEYS)
        .withColumnRenamed("kmeans_segment", "segment"), ["purchase_day_count"])
    return review.build_review(rows, risk, revenue, labels, profiles, I.FINAL, I.CALIBRATION, "rule", "recent_spend", capacity)


@query
def retention_review(spark, d):
    return _review(spark, d).select(
        *KEYS, "country", "inactive_probability_90d", "predicted_revenue_90d_gbp", "avg_order_value_gbp",
        "review_priority_score", "forecast_end_exclusive", "segment_label", "review_group", "risk_threshold",
        "historical_order_value_threshold_gbp", "review_rank", "in_review_queue", "ranking_policy",
        "review_capacity_fraction", "filtered_population_customers")


@query
def review_summary(spark, d):
    return review.review_summary(_review(spark, d))


def _grouped(spark, d):
    rows, risk, revenue, labels = I.review_sources(spark, d)
    combined = review.combine_review(rows, risk, revenue, labels, I.FINAL, "rule", "recent_spend")
    return review.assign_groups(combined, 0.6, 100000.0)


@query
def filtered_ranking(spark, d):
    kept = review.filter_review(_grouped(spark, d), [1], "NATION_3", 0.3, "1", None)
    return review.rank_review(kept, "historical_value", 0.25).select(
        *KEYS, "review_group", "spend_365d_gbp", "review_rank", "in_review_queue", "filtered_population_customers")


@query
def policy_comparison(spark, d):
    return review.compare_policies(_grouped(spark, d), 0.07)


@query
def queue_by_group(spark, d):
    return review.queue_by_group(review.rank_review(_grouped(spark, d), "risk", 0.2))


@query
def review_headline(spark, d):
    return review.headline(review.rank_review(_grouped(spark, d), "forecast_value", 0.1))


@query
def review_points(spark, d):
    return dashboards.review_points(review.rank_review(_grouped(spark, d), "risk_value", 0.1))


@query
def queue_display(spark, d):
    return dashboards.queue_display(review.rank_review(_grouped(spark, d), "risk_value", 0.1)).select(
        "review_rank", "customer_id", "review_group", "country", "inactive_probability_90d", "recency_days")


@query
def coverage_report(spark, d):
    """Keys of a risk table that lacks small customers and of a revenue table at two cutoffs."""
    rows, risk, revenue, _ = I.review_sources(spark, d)
    expected = rows.filter(F.col("cutoff") == F.lit(I.FINAL))
    partial = risk.filter((F.col("cutoff") == F.lit(I.FINAL)) & (F.col("rule_risk") < 0.9))
    return review.coverage_report(expected, {"risk": partial, "revenue": revenue.filter(
        F.col("cutoff").isin([I.FINAL, I.CALIBRATION]))})


@query
def top_risk(spark, d):
    wide = selection.score_table(I.rule_scores(spark, d).filter(F.col("split") == "final_test"),
                                 ["recency_curve"], "p", "_risk")
    return dashboards.top_risk(wide, "recency_curve_risk")


@query
def top_forecasts(spark, d):
    rows = I.rule_forecasts(spark, d).filter("model = 'run_rate' AND split = 'final_test'").select(
        *KEYS, F.lit("run_rate").alias("selected_model"), F.col("predicted").alias("predicted_revenue_gbp"))
    return dashboards.top_forecasts(rows)


@query
def model_comparison(spark, d):
    return dashboards.model_comparison(metrics.classification_metrics(I.rule_scores(spark, d)),
                                       ["development", "final_test"]).select(
        "model", "split", "n_customers", "precision_at_capacity", "average_precision", "roc_auc", "brier_score")


@query
def precision_by_split(spark, d):
    table = metrics.ranking_metrics(I.rule_scores(spark, d).filter(F.col("split") != "training"))
    return dashboards.metric_by_split(table, "average_precision", ["development", "calibration", "final_test"])
