from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metrics, selection
from ledgerloom.settings import Horizon, add_months

DAY = date(2011, 6, 1)


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    n = 400
    p = np.round(rng.random(n), 2)  # many ties
    return pd.DataFrame(dict(model="m", split="s", cutoff=DAY, customer_id=np.arange(n), y=(rng.random(n) < p).astype(int), p=p))


def test_classification_against_brute_force(spark, scores):
    got = metrics.classification_metrics(spark.createDataFrame(scores), 0.07).first()
    order = scores.sort_values(["p", "customer_id"], ascending=[False, True])
    k = int(np.ceil(len(scores) * 0.07))
    assert got["precision_at_capacity"] == pytest.approx(order.y.head(k).mean())
    precision, last = 0.0, 0.0
    for t in sorted(scores.p.unique(), reverse=True):
        called = scores[scores.p >= t]
        recall = called.y.sum() / scores.y.sum()
        precision += (recall - last) * called.y.mean()
        last = recall
    assert got["average_precision"] == pytest.approx(precision)
    a, b = scores.p[scores.y == 1].to_numpy(), scores.p[scores.y == 0].to_numpy()
    wins = (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()
    assert got["roc_auc"] == pytest.approx(wins)
    assert got["brier_score"] == pytest.approx(((np.clip(scores.p, 1e-8, 1 - 1e-8) - scores.y) ** 2).mean())


def test_capacity_rounds_up_and_one_class_has_no_auc(spark):
    df = spark.range(100).select(F.lit("m").alias("model"), F.lit("s").alias("split"), F.lit(DAY).alias("cutoff"),
                                 F.col("id").alias("customer_id"), F.lit(0).alias("y"), F.lit(0.5).alias("p"))
    chosen = metrics.top_capacity(df, "p", capacity=0.07).filter("chosen")
    assert sorted(r["customer_id"] for r in chosen.collect()) == list(range(8))  # 7.000000000000001 rounds up
    row = metrics.classification_metrics(df).first()
    assert row["roc_auc"] is None and row["average_precision"] is None and row["f1_threshold_0_5"] == 0


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(dict(customer_id=np.repeat(np.arange(500), 2), cutoff=[DAY, add_months(DAY, 3)] * 500,
                            difference=rng.normal(1, 2, 1000)))
    df = spark.createDataFrame(pdf).withColumn("cutoff", F.col("cutoff").cast("date"))
    first = metrics.bootstrap_difference(df, draws=400).first()
    again = metrics.bootstrap_difference(df.repartition(5), draws=400).first()
    assert first["lower_95"] == pytest.approx(again["lower_95"]) and first["draws"] == 400
    half = 1.96 * pdf.groupby("customer_id")["difference"].mean().std() / np.sqrt(500)
    assert first["lower_95"] == pytest.approx(pdf.difference.mean() - half, abs=0.06)
    assert first["upper_95"] == pytest.approx(pdf.difference.mean() + half, abs=0.06)
    assert metrics.positive_origins(df).first()["positive_origin_improvements"] == 2


def test_guards_and_audits(spark):
    rows = spark.createDataFrame([(1, DAY, -1.0), (2, DAY, float("nan"))], "customer_id bigint, cutoff date, predicted double")
    cohort = spark.createDataFrame([(1, DAY), (3, DAY)], "customer_id bigint, cutoff date")
    assert metrics.guarded(rows).filter("customer_id = 1").first()["predicted"] == 0
    assert metrics.prediction_violations(rows, cohort).first().asDict() == dict(missing=1, extra=1, not_finite=1)
    assert [r["rows"] for r in metrics.identical_tables(rows, rows).collect()] == [0, 0]
    bad = spark.createDataFrame([(1.0, 0.5), (0.0, None), (0.0, 1.0)], "lower double, upper double")
    assert metrics.interval_violations(bad).first()[0] == 2


def _metric(model, cutoff, deviance):
    return (model, cutoff, "completed", 1.0, 1.0, 0.1, float(deviance), 0.5)


COLUMNS = ("model string, cutoff date, status string, mae_gbp double, rmse_gbp double, aggregate_bias_pct double, "
           "tweedie_deviance_p1_5 double, revenue_capture_at_capacity double")


def test_selection_ignores_outcomes_that_end_too_late(spark):
    origins = [date(2010, 12, 1)] + [date(2011, m, 1) for m in range(1, 6)]
    rows = [_metric("early_winner", o, 50 if i == 0 else 100) for i, o in enumerate(origins)]
    rows += [_metric("late_winner", o, 60 if i == 0 else 1) for i, o in enumerate(origins)]
    frame = spark.createDataFrame(rows, COLUMNS)
    ends = spark.createDataFrame([(o, add_months(o, 6)) for o in origins], "cutoff date, horizon_end_exclusive date")
    table = selection.eligible_models(frame, ends, date(2011, 6, 1))
    assert selection.select_revenue_model(table).first()["model"] == "early_winner"
    tags = selection.tag_splits(frame, ends, date(2011, 6, 1)).filter("model = 'late_winner'").orderBy("cutoff").collect()
    assert [r["split"] for r in tags] == ["development"] + ["retrospective_robustness"] * 5


def test_failed_origins_make_a_model_ineligible(spark):
    origins = [date(2010, 9, 1), date(2010, 12, 1)]
    rows = [_metric("a", origins[0], 1), _metric("b", origins[0], 5), _metric("b", origins[1], 5),
            ("a", origins[1], "failed", None, None, None, None, None)]
    ends = spark.createDataFrame([(o, Horizon("90d", days=90).end(o)) for o in origins], "cutoff date, horizon_end_exclusive date")
    table = selection.eligible_models(spark.createDataFrame(rows, COLUMNS), ends, date(2011, 6, 1))
    assert selection.select_revenue_model(table).first()["model"] == "b"
    runs = spark.createDataFrame([("a", "90d", origins[0], "x"), ("a", "90d", origins[1], "x")], "model string, horizon string, origin date, signature string")
    stored = runs.limit(1).withColumn("status", F.lit("completed"))
    assert selection.missing_runs(runs, stored).count() == 1


def test_digest_sees_one_changed_cell(spark):
    rows = [(i, DAY, float(i % 7) if i % 5 else None, f"c{i % 3}") for i in range(400)]
    schema = "customer_id bigint, cutoff date, v double, country string"
    table = spark.createDataFrame(rows, schema)
    again = spark.createDataFrame(rows[::-1], schema).repartition(7).select("country", "v", "cutoff", "customer_id")
    same = metrics.digest_difference(table, again).first()
    assert same["identical"] and same["rows_first"] == same["rows_second"] == 400
    for changed in ([(*rows[0][:2], 1e-12, "c0"), *rows[1:]], rows[1:], [*rows, rows[3]], [*rows[1:], rows[1]], []):
        assert not metrics.digest_difference(table, spark.createDataFrame(changed, schema)).first()["identical"]
