"""Inputs shared by the registered queries, all derived from the given tables."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.operators import enrich, history, ingest, panel, targets
from ledgerloom.scratch import bucketed, materialise, shared_root
from ledgerloom.settings import KEYS, NINETY_DAYS, SIX_MONTHS, Horizon, month_starts
from ledgerloom.sources import extracts, prepared, retail

CUTOFFS = [date(2000, 3, 1), date(2000, 6, 1), date(2000, 9, 1), date(2000, 12, 1), date(2001, 3, 1), date(2001, 6, 1)]
FINAL = CUTOFFS[-1]
DEVELOPMENT = CUTOFFS[-3]
CALIBRATION = CUTOFFS[-2]
TRAINING = CUTOFFS[:3]
MONTHLY = month_starts(CUTOFFS[0], FINAL)
QUARTER_MONTHS = [3, 6, 9, 12]
HOME = "NATION_1"
EVENT_CUTOFF = date(2024, 1, 20)

_panels: dict[tuple, DataFrame] = {}


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.standardise(retail.single_copy(spark, folder))


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.purchase_lines(lines(spark, folder))


def credits(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.credit_lines(lines(spark, folder))


def stored_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase lines, written once for queries that read them several times."""
    return materialise(purchases(spark, folder).drop("unit_price", "source_sheet", "source_row"), "sold")


def event_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as purchase lines; they have no product code to filter on."""
    return retail.event_purchases(spark, folder).select(
        "customer_id", "invoice_id", "stock_code", "invoice_date", "quantity", "unit_price", "country",
        F.col("unit_price").cast("decimal(18,4)").alias("revenue"), F.to_date("invoice_date").alias("purchase_day"),
        F.col("source_row").alias("line_position"))


def order_rows(spark: SparkSession, folder: str, cutoffs: list[date] = CUTOFFS, sold: DataFrame | None = None) -> DataFrame:
    """Order features of every snapshot, without median, country and weekly sequence. ``sold`` are stored purchases."""
    return history.by_customer([stored_purchases(spark, folder) if sold is None else sold], cutoffs, lambda tables, parts: panel.order_features(
        panel.invoices_as_of(history.history_grain(*tables, parts), cutoffs)))


def target_rows(spark: SparkSession, folder: str, horizons=(NINETY_DAYS, SIX_MONTHS), sold: DataFrame | None = None) -> DataFrame:
    """Labels of every snapshot. ``sold`` are stored purchases."""
    sold = stored_purchases(spark, folder) if sold is None else sold
    return labels_of(sold, CUTOFFS, list(horizons))


def labels_of(sold: DataFrame, cutoffs: list[date], horizons: list[Horizon]) -> DataFrame:
    end = targets.source_span(sold)[1]
    return history.by_customer([sold], cutoffs, lambda tables, parts: targets.build_targets(
        *tables, history.cohort(*tables, cutoffs, parts), cutoffs, end, horizons, parts))


def labelled_panel(spark: SparkSession, folder: str, horizon: Horizon = NINETY_DAYS) -> DataFrame:
    """Enriched panel with the labels of a horizon, built once per session and folder and then read back."""
    return labelled_panels(spark, folder, [horizon])[0]


def labelled_panels(spark: SparkSession, folder: str, horizons: list[Horizon]) -> list[DataFrame]:
    """:func:`labelled_panel` of several horizons; what does not depend on the horizon is built once."""
    key = lambda horizon: (spark.sparkContext.applicationId, folder, horizon.name)
    missing = [h for h in horizons if key(h) not in _panels]
    if missing:
        credited = materialise(credits(spark, folder).select("customer_id", "invoice_id", "credit_day", "credit_amount_abs"), "credited")
        built = labelled_snapshots(stored_purchases(spark, folder), credited, *missing)
        for h in missing:
            _panels[key(h)] = built if len(missing) == 1 else built.filter(F.col("horizon") == h.name)
    return [_panels[key(h)] for h in horizons]


def labelled_snapshots(sold: DataFrame, credited: DataFrame, *horizons: Horizon) -> DataFrame:
    """Enriched panel of stored purchase and credit lines with the labels of the horizons (column ``horizon``), stored."""
    start, end = targets.source_span(sold)

    def build(tables, parts):
        def kept(rows, label):
            return rows if len(horizons) == 1 else materialise(rows, label) if parts is None else bucketed(rows, parts, "customer_id", label)

        grain = materialise(history.history_grain(tables[0]), "grain") if parts is None else history.history_grain(tables[0], parts)
        base = panel.build_panel(*tables, CUTOFFS, grain=grain, parts=parts)
        base = kept(base, "base") if parts is None else bucketed(base, parts, "customer_id", "base")
        extras = kept(enrich.order_value_extras(panel.invoices_as_of(grain, CUTOFFS)), "extras")
        labels = kept(targets.build_targets(tables[0], history.cohort(tables[0], CUTOFFS, parts), CUTOFFS, end, list(horizons), parts), "labels")
        return reduce(DataFrame.unionByName, [targets.label_panel(
            enrich.enriched_features(base, grain, CUTOFFS, start, h, parts, extras), labels if len(horizons) == 1 else labels.filter(F.col("horizon") == h.name), parts)
            for h in horizons])

    return materialise(history.by_customer([sold, credited], CUTOFFS, build), "panel")


def prepared_tables(spark: SparkSession, folder: str) -> prepared.Prepared:
    """Both raw extracts reconciled, written as marts and read back."""
    root = f"{shared_root(spark)}/prepared-{uuid.uuid4().hex}"
    prepared.write_prepared(spark, retail.raw_batches(spark, folder), root, folder)
    return prepared.load_prepared(spark, root)


def monthly_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Order features and the labels of both horizons at 16 month starts, stored by horizon and cutoff."""
    sold = stored_purchases(spark, folder)
    end = targets.source_span(sold)[1]

    def build(tables, parts):
        features = panel.order_features(panel.invoices_as_of(history.history_grain(*tables, parts), MONTHLY))
        rows = targets.label_panel(features, targets.build_targets(
            *tables, history.cohort(*tables, MONTHLY, parts), MONTHLY, end, [NINETY_DAYS, SIX_MONTHS], parts), parts)
        # A task of the final write takes many parts; it should only copy them.
        return rows if parts is None else bucketed(rows, parts, "customer_id", "months")

    path = f"{shared_root(spark)}/monthly-{uuid.uuid4().hex}"
    rows = history.by_customer([sold], MONTHLY, build).coalesce(4 * spark.sparkContext.defaultParallelism)  # bounds the number of files
    extracts.write_table(rows, path, ["horizon", "cutoff"], shuffled=False)
    return spark.read.parquet(path).withColumn("cutoff", F.col("cutoff").cast("date"))


def quarterly(rows: DataFrame) -> DataFrame:
    """Snapshots of the quarter starts; of a table stored by cutoff only their partitions are read."""
    return rows.filter(F.month("cutoff").isin(QUARTER_MONTHS))


def split_name() -> Column:
    """Role of a cutoff: training, development, calibration or final test."""
    return (F.when(F.col("cutoff") == F.lit(FINAL), "final_test").when(F.col("cutoff") == F.lit(CALIBRATION), "calibration")
            .when(F.col("cutoff") == F.lit(DEVELOPMENT), "development").otherwise("training"))


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two closed-form inactivity scores per snapshot with the 90-day outcome (long form)."""
    sold = stored_purchases(spark, folder)
    labels = target_rows(spark, folder, [NINETY_DAYS], sold).select(*KEYS, F.col("inactive").alias("y"))
    options = F.array(
        F.struct(F.lit("recency_curve").alias("model"), (F.col("recency_days") / (F.col("recency_days") + 90)).alias("p")),
        F.struct(F.lit("order_count").alias("model"), (F.lit(1.0) / (F.col("orders_365d") + 1)).alias("p")))
    rows = order_rows(spark, folder, sold=sold).select(*KEYS, F.explode(options).alias("_m"))
    return rows.join(labels, KEYS).select("_m.model", split_name().alias("split"), *KEYS, "y", "_m.p")


def rule_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Two closed-form 90-day revenue forecasts per snapshot with the outcome (long form)."""
    sold = stored_purchases(spark, folder)
    labels = target_rows(spark, folder, [NINETY_DAYS], sold).select(*KEYS, F.col("future_revenue_gbp").alias("actual"),
                                                                    "horizon_end_exclusive")
    options = F.array(
        F.struct(F.lit("recent_spend").alias("model"), F.col("spend_90d_gbp").alias("predicted")),
        F.struct(F.lit("run_rate").alias("model"),
                 (F.col("lifetime_revenue_gbp") / F.col("history_days") * 90).alias("predicted")))
    rows = order_rows(spark, folder, sold=sold).select(*KEYS, F.explode(options).alias("_m"))
    return rows.join(labels, KEYS).select("_m.model", split_name().alias("split"), *KEYS, "actual", "_m.predicted",
                                          "horizon_end_exclusive")


def review_sources(spark: SparkSession, folder: str, sold: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """History, risk, revenue and segments of every snapshot from closed-form rules, stored once."""
    sold = stored_purchases(spark, folder) if sold is None else sold

    def build(tables, parts):
        orders = panel.order_features(panel.invoices_as_of(history.history_grain(*tables, parts), CUTOFFS))
        return history.joined(orders, history.last_country(*tables, CUTOFFS, parts=parts), parts, "left")

    rows = materialise(history.by_customer([sold], CUTOFFS, build).select(
        *KEYS, "country", "recency_days", "tenure_days", F.col("purchase_count").cast("double").alias("purchase_count"),
        "purchase_day_count", "avg_order_value_gbp", "lifetime_revenue_gbp", "spend_90d_gbp", "spend_365d_gbp"), "review")
    risk = rows.select(*KEYS, (F.col("recency_days") / (F.col("recency_days") + 90)).alias("rule_risk"))
    revenue = rows.select(*KEYS, F.col("spend_90d_gbp").alias("predicted_revenue_gbp"))
    segments = rows.select(*KEYS, (F.col("purchase_count") >= 8).cast("int").alias("kmeans_segment"),
                           F.least(F.lit(2), F.floor(F.col("recency_days") / 200)).cast("int").alias("gmm_segment"),
                           F.lit(0.75).alias("gmm_max_membership"))
    return rows, risk, revenue, segments


def rule_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Two deterministic labelings of the calibration cohort with the segment inputs."""
    sold = stored_purchases(spark, folder)
    rows = order_rows(spark, folder, [CALIBRATION], sold).join(panel.product_features(sold, [CALIBRATION]), KEYS)
    return rows.withColumns({
        "segment": F.least(F.lit(3), F.floor(F.col("purchase_count") / 5)).cast("int"),
        "other_segment": F.least(F.lit(3), F.floor(F.col("recency_days") / 150)).cast("int")})


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at a fixed precision, negative zero removed."""
    return df.selectExpr(*[
        f"round(`{f.name}`, {places}) + 0D AS `{f.name}`" if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else f"`{f.name}`" for f in df.schema.fields])
