from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import review
from ledgerloom.settings import REVIEW_GROUPS, REVIEW_HISTORY

CUTOFF = date(2011, 9, 1)


@pytest.fixture(scope="module")
def sources(spark):
    ids = [10, 20, 30]
    history = [dict({c: float(i + 1) for c in REVIEW_HISTORY if c != "country"}, customer_id=k, cutoff=CUTOFF,
                    country=["UK", "UK", "France"][i], avg_order_value_gbp=100.0 * (i + 1)) for i, k in enumerate(ids)]
    risk = [(k, CUTOFF, p, a) for k, p, a in zip(ids, [0.9, 0.6, 0.2], [1, 0, 0])]
    revenue = [(k, CUTOFF, p, a) for k, p, a in zip(ids, [50.0, 200.0, 1000.0], [0.0, 100.0, 500.0])]
    segments = [(k, CUTOFF, s, g, m) for k, s, g, m in zip(ids, [1, 0, 0], [1, 0, 2], [0.8, 0.7, 0.9])]
    return dict(
        features=spark.createDataFrame(history), risk=spark.createDataFrame(risk, "customer_id bigint, cutoff date, net_risk double, inactive int"),
        revenue=spark.createDataFrame(revenue, "customer_id bigint, cutoff date, predicted_revenue_gbp double, actual_revenue_gbp double"),
        segments=spark.createDataFrame(segments, "customer_id bigint, cutoff date, kmeans_segment int, gmm_segment int, gmm_max_membership double"))


def combine(sources, **changed):
    s = {**sources, **changed}
    return review.combine_review(s["features"], s["risk"], s["revenue"], s["segments"], CUTOFF, "net", "trees")


def test_join_by_key_without_outcomes(sources):
    altered = sources["risk"].orderBy(F.col("customer_id").desc()).withColumn("inactive", F.lit(999))
    rows, again = combine(sources), combine(sources, risk=altered)
    assert [(r["inactive_probability_90d"], r["predicted_revenue_90d_gbp"]) for r in rows.orderBy("customer_id").collect()] == [
        (0.9, 50.0), (0.6, 200.0), (0.2, 1000.0)]
    assert not {"actual_revenue_gbp", "inactive", "future_revenue_gbp"} & set(rows.columns)
    assert rows.exceptAll(again).isEmpty()


def test_rejects_wrong_dates_missing_and_repeated_customers(sources):
    risk = sources["risk"]
    with pytest.raises(review.ReviewError, match="nothing for the cutoff"):
        combine(sources, risk=risk.withColumn("cutoff", F.lit(date(2011, 6, 1))))
    with pytest.raises(review.ReviewError, match="differ in customers: 1 missing, 0 extra"):
        combine(sources, risk=risk.filter("customer_id < 30"))
    with pytest.raises(review.ReviewError, match="repeated keys"):
        combine(sources, risk=risk.unionByName(risk.filter("customer_id = 10")))
    with pytest.raises(review.ReviewError, match="lacks columns"):
        combine(sources, risk=risk.drop("net_risk"))


@pytest.mark.parametrize("value", [-0.1, 1.1, float("nan"), None])
def test_rejects_invalid_probabilities(sources, value):
    with pytest.raises(review.ReviewError, match="invalid values"):
        combine(sources, risk=sources["risk"].withColumn("net_risk", F.lit(value).cast("double")))


def test_filters_define_capacity(sources):
    rows = review.assign_groups(combine(sources), 0.5, 200.0)
    kept = review.filter_review(rows, [0], "UK", 0.5)
    ranked = review.rank_review(kept, capacity=0.10).collect()
    assert [(r["customer_id"], r["in_review_queue"], r["filtered_population_customers"]) for r in ranked] == [(20, True, 1)]
    table = review.compare_policies(kept, 0.10).collect()
    assert {(r["customers"], r["predicted_revenue_90d_gbp"]) for r in table} == {(1, 200.0)} and len(table) == 4


def test_rounding_and_ties(sources):
    rows = combine(sources)
    ranked = review.rank_review(rows, capacity=0.34).filter("in_review_queue").orderBy("review_rank")
    assert [r["customer_id"] for r in ranked.collect()] == [20, 10]
    tied = rows.withColumns({"review_priority_score": F.lit(1.0), "inactive_probability_90d": F.lit(0.5), "predicted_revenue_90d_gbp": F.lit(10.0)})
    assert [r["customer_id"] for r in review.rank_review(tied).orderBy("review_rank").collect()] == [10, 20, 30]


def test_group_boundaries(sources):
    rows = review.assign_groups(combine(sources), 0.6, 200.0).orderBy("customer_id").collect()
    assert [r["review_group"] for r in rows] == [REVIEW_GROUPS[2], REVIEW_GROUPS[0], REVIEW_GROUPS[1]]
    assert {(r["risk_threshold"], r["historical_order_value_threshold_gbp"]) for r in rows} == {(0.6, 200.0)}
    with pytest.raises(review.ReviewError):
        review.assign_groups(combine(sources), 1.5, 1.0)


def test_empty_filter_and_zero_capacity(sources):
    rows = review.assign_groups(combine(sources), 0.5, 200.0)
    empty = review.rank_review(review.filter_review(rows, []))
    assert empty.count() == 0
    zero = review.rank_review(rows, capacity=0)
    assert zero.count() == 3 and zero.filter("in_review_queue").count() == 0
    table = review.compare_policies(rows, 0).collect()
    assert {(r["customers"], r["mean_inactivity_probability"], r["predicted_revenue_90d_gbp"]) for r in table} == {(0, None, 0.0)}
    head = review.headline(zero).first()
    assert head["queue_mean_inactivity_probability"] is None and head["queue_expected_revenue_gbp"] == 0
    assert review.queue_by_group(zero).count() == 8


def test_threshold_needs_an_earlier_cohort(sources):
    with pytest.raises(review.ReviewError):
        review.value_threshold(sources["features"], CUTOFF, CUTOFF)
    assert review.value_threshold(sources["features"], CUTOFF, date(2011, 12, 1)) == 250.0


def test_saved_scores_must_carry_the_selected_model(sources):
    expanded = sources["revenue"].withColumn("selected_model", F.lit("other"))
    with pytest.raises(review.ReviewError, match="disagree"):
        review.choose_revenue_scores(expanded, "trees", sources["revenue"], "x")
    assert review.choose_revenue_scores(None, None, sources["revenue"].withColumnRenamed("predicted_revenue_gbp", "x"), "x")[2] == "original_revenue_portfolio"
