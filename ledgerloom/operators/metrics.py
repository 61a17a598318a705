"""Evaluation of stored predictions, any number of models, splits and cutoffs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import clip, is_finite, tweedie_deviance
from ledgerloom.operators.ordering import exact_quantiles, ranked, running_totals
from ledgerloom.scratch import materialise
from ledgerloom.settings import CAPACITY, KEYS, SEED

GROUP = ["model", "split", "cutoff"]


def top_capacity(predictions: DataFrame, score: str, groups: list[str] = GROUP,
                 capacity: float = CAPACITY) -> DataFrame:
    """Rows with ``chosen``: the max(1, ceil(n * capacity)) highest scores; ties by customer."""
    placed = ranked(predictions, [F.col(score).desc(), F.col("customer_id").asc()], groups, rank="place", size="n")
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(capacity))))
    return placed.withColumn("capacity_rows", k).withColumn("chosen", F.col("place") <= k)


def capacity_metrics(predictions: DataFrame, capacity: float = CAPACITY, groups: list[str] = GROUP) -> DataFrame:
    """Precision and recall among the top scores. Input columns: ``y`` (0/1), ``p``, customer_id."""
    rows = top_capacity(predictions.withColumn("p", _bounded("p")), "p", groups, capacity)
    hits = F.sum(F.when(F.col("chosen"), F.col("y")).otherwise(0))
    return rows.groupBy(*groups).agg(
        (hits / F.first("capacity_rows")).alias("precision_at_capacity"),
        (hits / F.greatest(F.lit(1), F.sum("y"))).alias("recall_at_capacity"),
        (F.first("capacity_rows") / F.first("n")).alias("contact_capacity_fraction"))


def _bounded(p: str) -> Column:
    return clip(F.col(p), 1e-8, 1 - 1e-8)


def threshold_metrics(predictions: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Counts, prevalence, 0.5-threshold scores, Brier score and log loss."""
    y, p = F.col("y"), F.col("p")
    called = p >= 0.5
    both = F.count_if(called & (y == 1))
    hits, calls, positives = F.col("_hits"), F.col("_calls"), F.col("_positives")

    def safe(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    return (predictions.withColumn("p", _bounded("p")).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_customers"), F.avg(y.cast("double")).alias("positive_rate"),
        both.alias("_hits"), F.count_if(called).alias("_calls"), F.count_if(y == 1).alias("_positives"),
        F.avg(F.pow(p - y, 2)).alias("brier_score"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
        .select(*groups, "n_customers", "positive_rate",
                safe(hits, calls).alias("precision_threshold_0_5"),
                safe(hits, positives).alias("recall_threshold_0_5"),
                safe(2 * hits, calls + positives).alias("f1_threshold_0_5"), "brier_score", "log_loss"))


def ranking_metrics(predictions: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Average precision and ROC AUC with equal scores treated as one threshold."""
    by_score = predictions.withColumn("p", _bounded("p")).groupBy(*groups, "p").agg(
        F.sum("y").cast("bigint").alias("pos"), F.count(F.lit(1)).alias("all_rows"))
    run = running_totals(by_score, [F.col("p").desc()], {"cum_pos": "pos", "cum_all": "all_rows"}, groups)
    total_pos, total = F.col("cum_pos_total"), F.col("cum_all_total")
    negatives = F.col("all_rows") - F.col("pos")
    below = (total - total_pos) - (F.col("cum_all") - F.col("cum_pos"))
    wins = F.col("pos") * (below + negatives / 2)
    return run.groupBy(*groups).agg(
        F.sum(F.try_divide(F.col("pos"), total_pos) * (F.col("cum_pos") / F.col("cum_all"))).alias("average_precision"),
        F.try_divide(F.sum(wins), F.first(total_pos * (total - total_pos)).cast("double")).alias("roc_auc"))


def classification_metrics(predictions: DataFrame, capacity: float = CAPACITY,
                           groups: list[str] = GROUP) -> DataFrame:
    """The twelve classification values per group."""
    stored = materialise(predictions.select(*groups, "customer_id", "y", "p"), "scores")
    return (threshold_metrics(stored, groups).join(capacity_metrics(stored, capacity, groups), groups)
            .join(ranking_metrics(stored, groups), groups))


def revenue_metrics(predictions: DataFrame, capacity: float = CAPACITY, groups: list[str] = GROUP) -> DataFrame:
    """Totals, bias, errors and capture at capacity. Input: ``actual``, ``predicted``, customer_id."""
    floored = predictions.withColumns({"actual": clip(F.col("actual"), 0.0), "predicted": clip(F.col("predicted"), 0.0)})
    rows = top_capacity(floored, "predicted", groups, capacity)
    y, p = F.col("actual"), F.col("predicted")
    a, b = F.col("actual_revenue_gbp"), F.col("predicted_revenue_gbp")
    return (rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_customers"), F.sum(y).alias("actual_revenue_gbp"),
        F.sum(p).alias("predicted_revenue_gbp"), F.avg(F.abs(y - p)).alias("mae_gbp"),
        F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse_gbp"),
        F.sum(F.when(F.col("chosen"), y).otherwise(0.0)).alias("actual_at_capacity_gbp"),
        F.avg(tweedie_deviance(y, p)).alias("tweedie_deviance_p1_5"))
        .withColumns({"aggregate_bias_gbp": b - a, "aggregate_bias_pct": F.try_divide(b - a, a),
                      "revenue_capture_at_capacity": F.try_divide(F.col("actual_at_capacity_gbp"), a)}))


def tagged(records: DataFrame, task: str) -> DataFrame:
    """Metric rows tagged with their task."""
    return records.select(F.lit(task).alias("task"), "*")


def interval_metrics(predictions: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Coverage and width of 90 % intervals for all, positive and zero outcomes."""
    y = F.col("actual")
    parts = F.array_compact(F.array(F.lit("all"), F.when(y > 0, F.lit("positive")), F.when(y == 0, F.lit("zero"))))
    inside = (y >= F.col("lower")) & (y <= F.col("upper"))
    return (predictions.withColumn("outcome_group", F.explode(parts)).groupBy(*groups, "outcome_group").agg(
        F.count(F.lit(1)).alias("customers"), F.avg(inside.cast("double")).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_width_gbp")))


def interval_violations(predictions: DataFrame) -> DataFrame:
    """Intervals that are missing, infinite or out of order; must be zero."""
    low, high = F.col("lower"), F.col("upper")
    return predictions.agg(F.count_if(~(is_finite(low) & is_finite(high)) | F.coalesce(low > high, F.lit(True)))
                           .alias("invalid_intervals"))


def error_diagnostics(predictions: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Where the error sits: zero customers, the top one percent of actuals, positive customers."""
    placed = ranked(predictions, [F.col("actual").desc(), F.col("customer_id").asc()], groups, rank="place", size="n")
    y, p = F.col("actual"), F.col("predicted")
    top = F.col("place") <= F.ceil(F.col("n") * F.lit(0.01))
    return placed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == 0).cast("double")).alias("zero_fraction"),
        F.try_divide(F.sum(F.when(top, y).otherwise(0.0)), F.sum(y)).alias("top1pct_revenue_fraction"),
        F.sum(F.when(top, p - y).otherwise(0.0)).alias("top1pct_signed_error_gbp"),
        F.sum(p - y).alias("all_signed_error_gbp"),
        F.avg(F.when(y == 0, p)).alias("zero_customer_mean_prediction_gbp"),
        F.avg(F.when(y > 0, F.abs(p - y))).alias("positive_customer_mae_gbp"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two prediction sets of the same cohort side by side; the actuals must agree."""
    a = left.select(*KEYS, "actual", F.col("predicted").alias("predicted_left"))
    b = right.select(*KEYS, F.col("actual").alias("actual_right"), F.col("predicted").alias("predicted_right"))
    return a.join(b, KEYS)


def pairing_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys on one side only and the largest difference of the actuals; all must be zero."""
    a = left.select(*KEYS, F.col("actual").alias("_a"), F.lit(1).alias("_l"))
    b = right.select(*KEYS, F.col("actual").alias("_b"), F.lit(1).alias("_r"))
    return a.join(b, KEYS, "full").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("max_actual_difference"))


def blend(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal-weight blend of two prediction sets."""
    return paired(left, right).select(
        *KEYS, "actual", ((F.col("predicted_left") + F.col("predicted_right")) / 2).alias("predicted"))


def improvement(reference: DataFrame, candidate: DataFrame, metric: str = "mae") -> DataFrame:
    """Per-row loss of the reference minus loss of the candidate."""
    y = F.col("actual")
    loss = (lambda p: F.abs(y - p)) if metric == "mae" else (lambda p: tweedie_deviance(y, p))
    return paired(reference, candidate).select(
        *KEYS, (loss(F.col("predicted_left")) - loss(F.col("predicted_right"))).alias("difference"))


def positive_origins(differences: DataFrame) -> DataFrame:
    """Origins at which the candidate improved on the reference."""
    return differences.groupBy("cutoff").agg(F.avg("difference").alias("_d")).agg(
        F.count_if(F.col("_d") > 0).alias("positive_origin_improvements"),
        F.count(F.lit(1)).alias("origins"), F.avg("_d").alias("mean_improvement"))


def bootstrap_difference(differences: DataFrame, draws: int = 2000, seed: int = SEED) -> DataFrame:
    """95 % interval of the mean improvement, resampling a customer at all origins together.

    Multinomial resampling needs the whole cohort in one place; independent Poisson(1) weights
    do not. The weight of (customer, draw) is a function of a hash, so a rerun or another
    partitioning gives the same draws. Each task reduces its rows to one sum per draw and origin.
    """
    import numpy as np
    import pandas as pd

    # Cumulative Poisson(1) probabilities.
    steps = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])

    def partial_sums(batches):
        totals = {}
        salt = (np.arange(draws, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.iloc[start:start + 2000]
                mixed = part["_hash"].to_numpy().astype(np.int64).view(np.uint64)[:, None] + salt[None, :]
                # splitmix64 finaliser
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                uniform = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0 ** 53
                weight = np.searchsorted(steps, uniform).astype(float)
                for cutoff, rows in part.reset_index(drop=True).groupby("cutoff").indices.items():
                    w = weight[rows]
                    sums = np.vstack([w.T @ part["difference"].to_numpy()[rows], w.sum(axis=0)])
                    totals[cutoff] = totals.get(cutoff, 0) + sums
        for cutoff, sums in totals.items():
            yield pd.DataFrame(dict(cutoff=cutoff, draw=np.arange(draws), weighted=sums[0], weight=sums[1]))

    hashed = differences.withColumn("_hash", F.xxhash64(F.lit(seed), F.col("customer_id"))).select(
        "cutoff", "difference", "_hash")
    drawn = (hashed.mapInPandas(partial_sums, "cutoff date, draw int, weighted double, weight double")
             .groupBy("draw", "cutoff").agg((F.sum("weighted") / F.greatest(F.sum("weight"), F.lit(1.0))).alias("m"))
             .groupBy("draw").agg(F.avg("m").alias("value")))
    bounds = exact_quantiles(drawn, ["value"], [0.025, 0.975])
    return bounds.agg(F.max(F.when(F.col("probability") < 0.5, F.col("quantile"))).alias("lower_95"),
                      F.max(F.when(F.col("probability") > 0.5, F.col("quantile"))).alias("upper_95"),
                      F.max("n").alias("draws"))


def guarded(predictions: DataFrame, column: str = "predicted") -> DataFrame:
    """Predictions floored at zero."""
    return predictions.withColumn(column, clip(F.col(column), 0.0))


def prediction_violations(predictions: DataFrame, cohort: DataFrame, column: str = "predicted") -> DataFrame:
    """Missing, extra and non-finite predictions of a cohort; all must be zero."""
    p = predictions.select(*KEYS, F.col(column).alias("_p"), F.lit(1).alias("_has"))
    c = cohort.select(*KEYS, F.lit(1).alias("_due"))
    return c.join(p, KEYS, "full").agg(
        F.count_if(F.col("_has").isNull()).alias("missing"), F.count_if(F.col("_due").isNull()).alias("extra"),
        F.count_if(F.col("_has").isNotNull() & ~is_finite(F.col("_p"))).alias("not_finite"))


def replay_difference(stored: DataFrame, replayed: DataFrame, column: str = "predicted") -> DataFrame:
    """Largest absolute difference between stored and recomputed predictions, and key mismatches."""
    a = stored.select(*KEYS, F.col(column).alias("_a"), F.lit(1).alias("_l"))
    b = replayed.select(*KEYS, F.col(column).alias("_b"), F.lit(1).alias("_r"))
    return a.join(b, KEYS, "full").agg(
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched_keys"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_absolute_difference"))


def table_digest(table: DataFrame) -> DataFrame:
    """Rows and order-independent sums of two 64-bit hashes of every row, in one pass.

    Two builds with the same digest hold the same rows as often; a changed cell, a lost or a repeated row
    changes it. Columns are taken by name, so their order does not matter.
    """
    row = [F.col(f"`{c}`") for c in sorted(table.columns)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).alias(f"hash_{seed}") for seed in (1, 2)]
    return table.agg(F.count(F.lit(1)).alias("rows"), *sums)


def digest_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: the two builds' numbers of rows and whether their digests agree."""
    a, b = table_digest(first), table_digest(second)
    both = a.select("*", F.lit(1).alias("build")).unionByName(b.select("*", F.lit(2).alias("build")))
    return both.agg(F.max(F.when(F.col("build") == 1, F.col("rows"))).alias("rows_first"), F.max(F.when(F.col("build") == 2, F.col("rows"))).alias("rows_second"),
                    (F.min("rows").eqNullSafe(F.max("rows")) & F.min("hash_1").eqNullSafe(F.max("hash_1"))
                     & F.min("hash_2").eqNullSafe(F.max("hash_2"))).alias("identical"))


def identical_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows present on one side only; two builds of the same panel give zero."""
    a = left.select(*sorted(left.columns))
    b = right.select(*sorted(left.columns))
    return (a.exceptAll(b).agg(F.lit("only_left").alias("side"), F.count(F.lit(1)).alias("rows"))
            .unionByName(b.exceptAll(a).agg(F.lit("only_right").alias("side"), F.count(F.lit(1)).alias("rows"))))
