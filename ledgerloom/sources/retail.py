"""The star-schema test tables seen as retail transaction lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

# Ship dates from BATCH_B_START to BATCH_A_END appear in both extracts.
BATCH_A_END = date(1998, 7, 1)
BATCH_B_START = date(1998, 1, 1)
ANONYMOUS_EVERY = 13


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """One raw line per lineitem row: returns are credits, line seven is postage."""
    items = _table(spark, folder, "lineitem")
    orders, customers = _table(spark, folder, "orders"), _table(spark, folder, "customer")
    nations = _table(spark, folder, "nation")
    # The nation table is the fixed list of 25 nations; the other joins are left to the optimizer.
    buyers = (orders.join(customers, orders.o_custkey == customers.c_custkey)
              .join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey))
    return items.join(buyers, items.l_orderkey == orders.o_orderkey).selectExpr(
        "concat(CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END, CAST(l_orderkey AS STRING)) AS invoice_id",
        "CASE WHEN l_linenumber = 7 THEN 'POST' ELSE lpad(CAST(l_partkey AS STRING), 5, '0') END AS stock_code",
        "concat('Part ', CAST(l_partkey AS STRING)) AS description",
        "CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity",
        "l_shipdate AS invoice_date", "l_extendedprice / l_quantity AS unit_price",
        f"CASE WHEN o_custkey % {ANONYMOUS_EVERY} <> 0 THEN o_custkey END AS customer_id",
        "n_name AS country", "l_orderkey * 8 + l_linenumber AS source_row")


def raw_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping extracts of the same lines, with lineage columns."""
    lines = _lines(spark, folder)
    day = F.col("invoice_date")
    first = lines.filter(day < F.lit(BATCH_A_END).cast("timestamp_ntz")).withColumns({
        "source_sheet": F.lit("A"), "source_sheet_role": F.lit("legacy"), "batch_order": F.lit(0)})
    second = lines.filter(day >= F.lit(BATCH_B_START).cast("timestamp_ntz")).withColumns({
        "source_sheet": F.lit("B"), "source_sheet_role": F.lit("current"), "batch_order": F.lit(1)})
    return first.unionByName(second)


def single_copy(spark: SparkSession, folder: str) -> DataFrame:
    """The lines once, as reconciliation leaves them (batch A wins the overlap)."""
    in_first = f"invoice_date < TIMESTAMP_NTZ '{BATCH_A_END} 00:00:00'"
    return _lines(spark, folder).selectExpr(
        "*", f"CASE WHEN {in_first} THEN 'A' ELSE 'B' END AS source_sheet",
        f"CASE WHEN {in_first} THEN 'legacy' ELSE 'current' END AS source_sheet_role",
        f"CASE WHEN {in_first} THEN 0 ELSE 1 END AS batch_order")


def event_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as lines of a short history with fractional-second timestamps."""
    return (_table(spark, folder, "events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").cast("string").alias("invoice_id"), F.lit("00000").alias("stock_code"),
        F.lit(None).cast("string").alias("description"), F.lit(1.0).alias("quantity"),
        F.col("ts").alias("invoice_date"), F.col("value").alias("unit_price"),
        F.col("user_id").alias("customer_id"), F.lit("Unknown").alias("country"),
        F.col("event_id").alias("source_row"), F.lit("events").alias("source_sheet"),
        F.lit("current").alias("source_sheet_role"), F.lit(0).alias("batch_order")))
