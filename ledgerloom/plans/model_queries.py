"""Registered queries with fitted models; they have no SQL counterpart.

All of them learn from the labelled panel of the given tables, over all its rows. Boosted trees run all
their rounds, forests all their trees and segmentations the whole grid; networks and the rolling
comparison run less than the models' defaults (README).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import boosting, history, metrics, models, review, segments, selection, targets
from ledgerloom.operators.behaviour import (BetaGeoNbd, GammaGamma, ParetoNbd, bg_value, for_cohort, pareto_value,
                                            penalty_sweep, quadrature_check)
from ledgerloom.operators.design import additive_design, logged_design, plain_design, spline_design
from ledgerloom.plans import inputs as I
from ledgerloom.scratch import materialise, shared_root
from ledgerloom.settings import (CALENDAR_FEATURES, EXTRA_FEATURES, KEYS, LOGISTIC_SPLINE_FEATURES, NINETY_DAYS,
                                 NUMERIC_FEATURES, REVENUE_SPLINE_FEATURES, SEED, SIX_MONTHS)
from ledgerloom.sources import store
from ledgerloom.sources.runs import RunStore

MODEL_QUERIES = {}
VALUE_FEATURES = NUMERIC_FEATURES + CALENDAR_FEATURES + EXTRA_FEATURES


def query(f):
    MODEL_QUERIES[f.__name__] = lambda spark, folder: I.rounded(f(spark, folder))
    return f


def _classified(scored):
    return scored.select(*KEYS, F.col("inactive").cast("int").alias("y"), "p")


def _splits(spark, d):
    parts = models.split_by_cutoff(I.labelled_panel(spark, d), {
        "training": I.TRAINING, "development": [I.DEVELOPMENT], "calibration": [I.CALIBRATION], "final_test": [I.FINAL]})
    return parts


def _inactivity(make):
    def run(spark, d):
        parts = _splits(spark, d)
        return _classified(make().fit(parts["training"]).predict(parts["development"]))
    return run


def _revenue(make):
    def run(spark, d):
        rows = I.labelled_panel(spark, d)
        cohort = targets.scoring_cohort(rows, I.FINAL)
        scored = make().fit(targets.available_training(rows, I.FINAL)).predict(cohort)
        bounds = [c for c in ("lower", "upper") if c in scored.columns]
        return scored.select(*KEYS, F.col("future_revenue_gbp").alias("actual"), "predicted", *bounds)
    return run


def _named(name, f):
    f.__name__ = name
    return query(f)


_named("recency_logistic", _inactivity(lambda: models.LogisticModel(plain_design(["recency_days"], country=False), 0.2)))
_named("full_logistic", _inactivity(lambda: models.LogisticModel(plain_design(NUMERIC_FEATURES), 0.25)))
_named("logistic_splines", _inactivity(lambda: models.LogisticModel(spline_design(LOGISTIC_SPLINE_FEATURES), 0.2)))
_named("forest_classifier", _inactivity(lambda: models.TreeClassifier(plain_design(NUMERIC_FEATURES, scale=False))))
_named("boosted_classifier", _inactivity(lambda: models.TreeClassifier(
    plain_design(NUMERIC_FEATURES, scale=False), kind="boosted", trees=220, depth=3, min_rows=1, min_weight=18.0,
    columns_per_split="0.82", row_share=0.82)))
_named("purchase_hazard", _inactivity(lambda: models.PurchaseHazard(plain_design(NUMERIC_FEATURES))))
_named("weekly_network", _inactivity(lambda: models.WeeklyNetwork(plain_design(NUMERIC_FEATURES), iterations=30)))


@query
def network_ensemble(spark, d):
    parts = _splits(spark, d)
    return _classified(models.seed_ensemble(
        lambda seed: models.WeeklyNetwork(plain_design(NUMERIC_FEATURES), hidden=16, iterations=15, seed=seed),
        [SEED, SEED + 1, SEED + 2], parts["training"], parts["development"]))


@query
def calibrated_logistic(spark, d):
    """Refit on training and development, calibrate on the next cutoff, score the last one."""
    rows = I.labelled_panel(spark, d)
    parts = _splits(spark, d)
    model = models.LogisticModel(plain_design(NUMERIC_FEATURES), 0.25).fit(
        rows.filter(F.col("label_mature") & F.col("cutoff").isin(I.TRAINING + [I.DEVELOPMENT])))
    platt = models.Platt().fit(model.predict(parts["calibration"]))
    return _classified(platt.predict(model.predict(parts["final_test"])))


_named("tweedie_glm", _revenue(lambda: models.RevenueGlm(plain_design(NUMERIC_FEATURES), "tweedie", alpha=4.0)))
_named("hurdle_glm", _revenue(lambda: models.RevenueGlm(plain_design(NUMERIC_FEATURES), "hurdle", alpha=2.0)))
_named("frequency_severity_glm", _revenue(lambda: models.RevenueGlm(
    logged_design(VALUE_FEATURES, CALENDAR_FEATURES), "frequency_severity", alpha=1.0)))
_named("tweedie_splines", _revenue(lambda: models.RevenueGlm(
    additive_design(REVENUE_SPLINE_FEATURES, CALENDAR_FEATURES), "tweedie", alpha=0.3)))
_named("hurdle_splines", _revenue(lambda: models.RevenueGlm(
    additive_design(REVENUE_SPLINE_FEATURES, CALENDAR_FEATURES), "hurdle", alpha=0.3)))
_named("forest_regressor", _revenue(lambda: models.TreeRegressor(plain_design(NUMERIC_FEATURES, scale=False))))
_named("boosted_median", _revenue(lambda: models.TreeRegressor(
    logged_design(VALUE_FEATURES, CALENDAR_FEATURES), "absolute", trees=180, depth=4, min_rows=40)))
_named("boosted_tweedie", _revenue(lambda: boosting.LogLinkBoosting(
    plain_design(VALUE_FEATURES, scale=False), "tweedie", rounds=240, column_share=0.82)))
_named("boosted_poisson", _revenue(lambda: boosting.LogLinkBoosting(
    logged_design(VALUE_FEATURES, CALENDAR_FEATURES), "poisson", rounds=180, depth=4, step=0.045, min_rows=40, row_share=1.0)))
_named("boosted_hurdle", _revenue(lambda: boosting.BoostedHurdle(
    logged_design(VALUE_FEATURES, CALENDAR_FEATURES))))
_named("lognormal_hurdle", _revenue(lambda: models.LogNormalHurdle(
    logged_design(VALUE_FEATURES, CALENDAR_FEATURES))))


# --- Behaviour --------------------------------------------------------------------------


def _summary(spark, d, cutoff):
    return materialise(history.history_summary(I.purchases(spark, d), [cutoff], I.HOME), "summary")


def _with_actual(spark, d, predictions):
    labels = targets.scoring_cohort(I.labelled_panel(spark, d), I.FINAL)
    return for_cohort(predictions, labels).join(labels.select(*KEYS, F.col("future_revenue_gbp").alias("actual")), KEYS)


@query
def bg_nbd_value(spark, d):
    summary = _summary(spark, d, I.FINAL)
    return _with_actual(spark, d, bg_value(summary, 90, BetaGeoNbd.fit(summary), GammaGamma.fit(summary)))


@query
def pareto_value_90d(spark, d):
    summary = _summary(spark, d, I.FINAL)
    return _with_actual(spark, d, pareto_value(summary, 90, ParetoNbd().fit(summary), GammaGamma.fit(summary)))


@query
def seasonal_pareto_value(spark, d):
    summary = _summary(spark, d, I.FINAL)
    return _with_actual(spark, d, pareto_value(summary, 90, ParetoNbd(seasonal=True).fit(summary), GammaGamma.fit(summary)))


@query
def penalty_sensitivity(spark, d):
    """Forecast errors of every purchase penalty at three origins, each fitted on the history before it."""
    origins = [I.DEVELOPMENT, I.CALIBRATION, I.FINAL]
    panel = I.labelled_panel(spark, d)
    summaries = materialise(history.history_summary(I.stored_purchases(spark, d), origins, I.HOME), "summary")

    def swept(origin):
        labels = targets.scoring_cohort(panel, origin).select(*KEYS, F.col("future_revenue_gbp").alias("actual"))
        summary = summaries.filter(F.col("cutoff") == F.lit(origin))
        return materialise(penalty_sweep(summary, labels, 90, [0.0, 1e-5, 1e-4, 1e-3, 1e-2]), "sweep")

    # Fits are many short jobs, between which cores would wait for the driver: the origins run side by side.
    with ThreadPoolExecutor(len(origins)) as pool:
        out = reduce(DataFrame.unionByName, pool.map(swept, origins))
    return metrics.revenue_metrics(out, groups=["cutoff", "model", "bg_a", "bg_b", "gamma_q"])


@query
def quadrature_audit(spark, d):
    import numpy as np
    summary = _summary(spark, d, I.FINAL)
    out = None
    for seasonal in (False, True):
        theta = np.concatenate([np.log([0.6, 2.0, 0.4, 9.0]), [0.3, 0.1, -0.1] if seasonal else []])
        part = quadrature_check(ParetoNbd(seasonal, theta=theta), summary, 90).select(F.lit(seasonal).alias("seasonal"), "*")
        out = part if out is None else out.unionByName(part)
    return out


# --- Segments ---------------------------------------------------------------------------


def _chosen_segments(rows):
    """The space and model chosen from the whole grid, and the mixture of the lowest BIC, of the calibration cohort."""
    train = rows.filter(F.col("cutoff") == F.lit(I.CALIBRATION))
    table, fitted = segments.kmeans_candidates(train)
    chosen = segments.choose_segments(table).first()  # one row
    if chosen is None:
        raise ValueError("no eligible segmentation")
    soft_space = segments.SegmentSpace(True).fit(train)
    points = soft_space.transform(train).select(*KEYS, "z")
    n = points.count()
    return *fitted[(chosen["model"], chosen["k"])], soft_space, min(segments.fit_mixtures(points), key=lambda m: m.bic(n))


@query
def segment_candidates(spark, d):
    train = I.labelled_panel(spark, d).filter(F.col("cutoff") == F.lit(I.CALIBRATION))
    return segments.kmeans_candidates(train)[0]


@query
def segment_choice(spark, d):
    train = I.labelled_panel(spark, d).filter(F.col("cutoff") == F.lit(I.CALIBRATION))
    return segments.choose_segments(segments.kmeans_candidates(train)[0])


def _assigned(rows, space, hard, soft_space, soft):
    """Segments and soft membership of ``rows``."""
    first = hard.transform(space.transform(rows), output="kmeans_segment").select(*KEYS, "kmeans_segment")
    return first.join(soft.assign(soft_space.transform(rows)).select(*KEYS, "gmm_segment", "gmm_max_membership"), KEYS)


@query
def segment_assignments(spark, d):
    """Segments and soft membership of the later cohort in the spaces fitted on the earlier one."""
    rows = I.labelled_panel(spark, d)
    return _assigned(rows.filter(F.col("cutoff") == F.lit(I.FINAL)), *_chosen_segments(rows))


@query
def mixture_candidates(spark, d):
    train = I.labelled_panel(spark, d).filter(F.col("cutoff") == F.lit(I.CALIBRATION))
    points = segments.SegmentSpace(True).fit(train).transform(train).select(*KEYS, "z")
    return segments.mixture_table(spark, segments.fit_mixtures(points), points.count())


@query
def segment_projection(spark, d):
    rows = I.labelled_panel(spark, d)
    train, later = (rows.filter(F.col("cutoff") == F.lit(c)) for c in (I.CALIBRATION, I.FINAL))
    return segments.projection(*_chosen_segments(rows), {"fit": train, "assignment": later})


@query
def fitted_review(spark, d):
    """The whole chain: extracts reconciled into marts, snapshots, fitted risk, revenue and segments, the ranked review.

    Risk and revenue learn only from outcomes that had ended by the review's day; the risk is
    calibrated on the latest of them, which its model has not seen.
    """
    marts = I.prepared_tables(spark, d)
    rows = I.labelled_snapshots(marts.purchases, marts.credits, NINETY_DAYS)
    available = targets.available_training(rows, I.FINAL)
    latest = F.col("cutoff") == F.lit(I.CALIBRATION)
    today = rows.filter(F.col("cutoff") == F.lit(I.FINAL))
    model = models.LogisticModel(plain_design(NUMERIC_FEATURES), 0.25).fit(available.filter(~latest))
    platt = models.Platt().fit(model.predict(available.filter(latest)))
    risk = platt.predict(model.predict(today)).select(*KEYS, F.col("p").alias("calibrated_logistic_risk"))
    revenue = models.RevenueGlm(plain_design(NUMERIC_FEATURES), "hurdle", alpha=2.0).fit(available).predict(
        today, "predicted_revenue_gbp").select(*KEYS, "predicted_revenue_gbp")
    space, hard, soft_space, soft = _chosen_segments(rows)
    profiles = segments.segment_profiles(hard.transform(space.transform(rows.filter(latest))), ["purchase_day_count"])
    stored = [materialise(x, "scored") for x in (risk, revenue, _assigned(today, space, hard, soft_space, soft))]
    return review.build_review(rows, *stored, profiles, I.FINAL, I.CALIBRATION, "calibrated_logistic", "hurdle_glm").drop("gmm_max_membership")


# --- Comparison -------------------------------------------------------------------------


@query
def rolling_evaluation(spark, d):
    """Leaderboard over origins; models learn only from outcomes that had ended."""
    rows = I.labelled_panel(spark, d)
    sold = I.purchases(spark, d)

    def recent(train, cohort):
        return cohort.withColumn("predicted", models.recent_spend(90, 90))

    def hurdle(train, cohort):
        return models.RevenueGlm(plain_design(NUMERIC_FEATURES), "hurdle", alpha=2.0).fit(train).predict(cohort)

    def behaviour(train, cohort):
        summary = materialise(history.purchase_day_summary(sold, [cohort.first()["cutoff"]]), "summary")
        return for_cohort(bg_value(summary, 90, BetaGeoNbd.fit(summary), GammaGamma.fit(summary)), cohort)

    predictions, statuses = models.rolling_origins(
        rows, [I.CALIBRATION, I.FINAL], {"recent_spend": recent, "hurdle_glm": hurdle, "bg_nbd": behaviour}, "90d")
    scored = metrics.revenue_metrics(predictions, groups=["model", "cutoff"]).join(statuses, ["model", "cutoff"])
    return selection.leaderboard(scored)


@query
def feature_set_comparison(spark, d):
    """Basic, calendar and enriched inputs of one model at both horizons, against recent spend.

    Predictions and receipts are stored run by run; a horizon's candidates and their states are
    reported also where no origin was fit to learn from.
    """
    inputs = {"basic": NUMERIC_FEATURES, "calendar": NUMERIC_FEATURES + CALENDAR_FEATURES, "enriched": VALUE_FEATURES}

    def candidate(features):
        design = logged_design(features, CALENDAR_FEATURES)
        return lambda train, cohort: models.RevenueGlm(design, "frequency_severity", alpha=1.0).fit(train).predict(cohort)

    out, store_of = None, RunStore(f"{shared_root(spark)}/runs-{uuid.uuid4().hex}", d)
    horizons = [NINETY_DAYS, SIX_MONTHS]
    for horizon, window, rows in zip(horizons, (90, 180), I.labelled_panels(spark, d, horizons)):
        candidates = {"recent_spend": lambda train, cohort: cohort.withColumn("predicted", models.recent_spend(window, F.col("horizon_days"))),  # noqa: B023
                      **{name: candidate(features) for name, features in inputs.items()}}
        predictions, statuses = models.rolling_origins(rows, [I.DEVELOPMENT, I.CALIBRATION, I.FINAL], candidates, horizon.name, store_of)
        scored = metrics.revenue_metrics(predictions, groups=["model", "cutoff"]).join(statuses, ["model", "cutoff"])
        found = selection.status_summary(statuses).join(selection.leaderboard(scored), "model", "left").select(F.lit(horizon.name).alias("horizon"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query
def bootstrap_improvement(spark, d):
    rows = materialise(I.rule_forecasts(spark, d), "forecasts")
    differences = metrics.improvement(rows.filter("model = 'recent_spend'"), rows.filter("model = 'run_rate'"))
    return metrics.bootstrap_difference(differences)


@query
def replay_audit(spark, d):
    """Stored predictions against those of the stored model, loaded again, and two builds of the labels from the lines."""
    parts = _splits(spark, d)
    fitted = {"replay_logistic": models.LogisticModel(plain_design(NUMERIC_FEATURES), 0.25).fit(parts["training"]),
              "replay_boosted": models.TreeClassifier(plain_design(NUMERIC_FEATURES, scale=False), kind="boosted", trees=5, depth=3).fit(parts["training"])}
    out = None
    for name, model in fitted.items():
        stored = materialise(model.predict(parts["development"], "predicted").select(*KEYS, "predicted"), "scores")
        path = f"{shared_root(spark)}/audit-{uuid.uuid4().hex}"
        store.save_model(spark, model, path)
        again = store.load_model(spark, path).predict(parts["development"], "predicted")
        found = metrics.replay_difference(stored, again).select(
            F.lit(name).alias("check_name"), F.col("unmatched_keys").alias("rows"), "max_absolute_difference")
        out = found if out is None else out.unionByName(found)
    builds = [materialise(I.target_rows(spark, d, [NINETY_DAYS, SIX_MONTHS]), "build") for _ in range(2)]
    same = metrics.digest_difference(*builds)
    return out.unionByName(same.select(F.lit("rebuild").alias("check_name"), F.abs(F.col("rows_first") - F.col("rows_second")).alias("rows"),
                                       F.when(F.col("identical"), 0.0).otherwise(1.0).alias("max_absolute_difference")))
