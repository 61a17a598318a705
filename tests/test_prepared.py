"""Prepared tables, the monthly panel's partitions, and the review on fitted scores."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ingest
from ledgerloom.plans import inputs as I
from ledgerloom.plans.model_queries import MODEL_QUERIES
from ledgerloom.settings import REVIEW_GROUPS
from ledgerloom.sources import extracts, prepared, retail

FOLDER = "/root/testdata/sf0.001"


def test_marts_are_those_of_single_lines(spark, tmp_path):
    root = str(tmp_path / "marts")
    prepared.write_prepared(spark, retail.raw_batches(spark, FOLDER), root, "s1")
    marts, keys = prepared.load_prepared(spark, root), ["invoice_id", "stock_code", "source_row", "quantity"]
    for found, want in ((marts.purchases, I.purchases(spark, FOLDER)), (marts.credits, I.credits(spark, FOLDER))):
        assert found.columns == want.columns
        assert sorted(found.select(*keys).collect()) == sorted(want.select(*keys).collect())
    assert marts.invoices.count() == marts.purchases.select("customer_id", "invoice_id").distinct().count()
    manifest = spark.read.json(f"{root}/manifest").first()
    assert manifest["source_signature"] == "s1" and manifest["purchase_lines"] == marts.purchases.count()
    other = spark.read.parquet(f"{root}/invoices").withColumn("source_signature", F.lit("s2"))
    extracts.write_table(spark.createDataFrame(other.collect(), other.schema), f"{root}/invoices")
    with pytest.raises(ValueError, match="different sources"):
        prepared.load_prepared(spark, root)


def test_a_source_without_credits(spark, tmp_path):
    raw = retail.raw_batches(spark, FOLDER).filter(~F.col("invoice_id").startswith("C"))
    prepared.write_prepared(spark, raw, str(tmp_path / "m"), "s")
    marts = prepared.load_prepared(spark, str(tmp_path / "m"))
    assert marts.credits.count() == 0 and marts.purchases.count() == ingest.purchase_lines(ingest.standardise(ingest.reconcile(raw))).count()


def test_quarters_read_their_partitions_only(spark):
    rows = I.quarterly(I.monthly_panel(spark, FOLDER).filter("horizon = '6m'"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "month(cutoff" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    files = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("horizon=6m" in r["f"] for r in files)
    assert {r["cutoff"].month for r in rows.select("cutoff").distinct().collect()} == set(I.QUARTER_MONTHS)


def test_review_on_fitted_scores(spark):
    rows = MODEL_QUERIES["fitted_review"](spark, FOLDER).collect()
    want = {r["customer_id"] for r in I.purchases(spark, FOLDER).filter(F.col("purchase_day") < F.lit(I.FINAL)).select("customer_id").distinct().collect()}
    assert {r["customer_id"] for r in rows} == want and len(rows) == len(want)
    placed = sorted(rows, key=lambda r: r["review_rank"])
    assert [r["review_rank"] for r in placed] == list(range(1, len(rows) + 1))
    scores = [r["review_priority_score"] for r in placed]
    assert scores == sorted(scores, reverse=True) and all(0 < r["inactive_probability_90d"] < 1 for r in rows)
    assert sum(r["in_review_queue"] for r in rows) == -(-len(rows) // 10) and {r["review_group"] for r in rows} <= set(REVIEW_GROUPS)
