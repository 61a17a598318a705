"""Reconciling overlapping extracts and splitting purchases from credits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.operators.ordering import HEAVY_ROWS, join_marks, ranked
from ledgerloom.scratch import materialise
from ledgerloom.settings import LINE_COLUMNS, MONEY, PRODUCT_CODE, RAW_COLUMNS


def _shared_spans(spans: list[tuple]) -> list[tuple]:
    """Disjoint closed intervals covered by the spans of at least two batches."""
    edges = sorted([(low, 0) for low, _ in spans] + [(high, 1) for _, high in spans])
    shared, open_spans, start = [], 0, None
    for value, closing in edges:
        if not closing:
            open_spans += 1
            if open_spans == 2:
                start = value
        else:
            if open_spans == 2:
                shared.append((start, value))
            open_spans -= 1
    return shared


def _literal(value, like: DataFrame, column: str) -> Column:
    return F.lit(str(value) if like.schema[column].dataType.typeName().startswith("timestamp") else value).cast(
        like.schema[column].dataType)


def reconcile(lines: DataFrame, raw_columns: list[str] = RAW_COLUMNS, batch: str = "source_sheet",
              batch_order: str = "batch_order", row: str = "source_row",
              date_column: str = "invoice_date") -> DataFrame:
    """Keep, for every exact raw row, the largest number of copies seen in one batch.

    Copies inside one batch are legitimate and stay; copies that another batch already supplied
    go. Earlier batches and earlier rows survive. Only rows dated where two batches overlap can
    be affected, so all others pass without a shuffle.
    """
    spans = (lines.groupBy(batch).agg(F.min(date_column).alias("low"), F.max(date_column).alias("high"))
             .filter(F.col("low").isNotNull()).collect())  # one row per extract
    shared = _shared_spans([(r["low"], r["high"]) for r in spans])
    in_overlap = reduce(lambda a, b: a | b, [
        F.col(date_column).between(_literal(low, lines, date_column), _literal(high, lines, date_column))
        for low, high in shared], F.lit(False))
    contested = F.coalesce(in_overlap, F.lit(True))  # undated rows are always compared
    untouched, compared = lines.filter(~contested), lines.filter(contested)

    per_batch = W.partitionBy(*raw_columns)  # one row per batch that has the raw row
    copies = compared.groupBy(*raw_columns, batch, batch_order).agg(F.count(F.lit(1)).alias("_copies"))
    earlier = F.coalesce(F.sum("_copies").over(
        per_batch.orderBy(batch_order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    allowed = F.max("_copies").over(per_batch)
    # Keys that lose copies, and those of many rows, which the join spreads.
    marked = materialise(
        copies.withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_copies"), allowed - earlier)))
        .filter((F.col("_quota") < F.col("_copies")) | (F.col("_copies") > HEAVY_ROWS)), "lossy")

    keys = raw_columns + [batch, batch_order]
    judged = join_marks(compared, marked, keys, row, "_copies")
    whole = F.col("_quota").isNull() | (F.col("_quota") == F.col("_copies"))
    kept = untouched.unionByName(judged.filter(whole).drop("_quota", "_copies"))
    some = (F.col("_quota") > 0) & (F.col("_quota") < F.col("_copies"))
    if not marked.filter(some).isEmpty():
        # A batch supplies some of its copies: take its first rows.
        partly = ranked(judged.filter(some), [F.col(row).asc()], keys, rank="_copy")
        kept = kept.unionByName(partly.filter(F.col("_copy") <= F.col("_quota")).drop("_copy", "_quota", "_copies"))
    return kept


def standardise(lines: DataFrame) -> DataFrame:
    """Trim identifiers and parse values leniently: what cannot be parsed becomes NULL."""
    parsed = {
        "invoice_id": "trim(CAST(invoice_id AS STRING))", "stock_code": "trim(CAST(stock_code AS STRING))",
        "description": "CAST(description AS STRING)", "country": "CAST(country AS STRING)",
        "invoice_date": "try_cast(invoice_date AS TIMESTAMP_NTZ)", "quantity": "try_cast(quantity AS DOUBLE)",
        "unit_price": "try_cast(unit_price AS DOUBLE)",
        # Identifiers read as text may carry a decimal point ("17850.0").
        "customer_id": "try_cast(try_cast(customer_id AS DOUBLE) AS BIGINT)"
        if lines.schema["customer_id"].dataType.typeName() == "string" else "try_cast(customer_id AS BIGINT)"}
    return lines.selectExpr(*[f"{parsed[c]} AS {c}" if c in parsed else f"`{c}`" for c in lines.columns])


def is_credit() -> Column:
    return F.coalesce(F.upper("invoice_id").startswith("C"), F.lit(False))


def is_product() -> Column:
    return F.coalesce(F.col("stock_code").rlike(PRODUCT_CODE), F.lit(False))


def _positive_sale() -> Column:
    return F.coalesce((F.col("quantity") > 0) & (F.col("unit_price") > 0), F.lit(False)) & ~is_credit()


# Source order of a line as one number: batch first, then row.
LINE_POSITION = "shiftleft(CAST(batch_order AS BIGINT), 48) + source_row AS line_position"


def purchase_lines(lines: DataFrame) -> DataFrame:
    """Sales of products to known customers."""
    return lines.filter(_positive_sale() & is_product()).filter(
        "customer_id IS NOT NULL AND invoice_date IS NOT NULL").selectExpr(
        *LINE_COLUMNS, LINE_POSITION, f"CAST(quantity * unit_price AS {MONEY}) AS revenue", "to_date(invoice_date) AS purchase_day")


def credit_lines(lines: DataFrame) -> DataFrame:
    """Credits of known customers, of any stock code."""
    return lines.filter(is_credit()).filter(
        "quantity < 0 AND customer_id IS NOT NULL AND invoice_date IS NOT NULL").selectExpr(
        *LINE_COLUMNS, f"abs(CAST(quantity * unit_price AS {MONEY})) AS credit_amount_abs", "to_date(invoice_date) AS credit_day")


def purchase_invoices(purchases: DataFrame) -> DataFrame:
    """One row per customer and invoice."""
    per_product = purchases.groupBy("customer_id", "invoice_id", "stock_code").agg(
        F.min("invoice_date").alias("invoice_date"), F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("line_count"),
        last_country())
    return per_product.groupBy("customer_id", "invoice_id").agg(
        F.min("invoice_date").alias("invoice_date"),
        F.sum("revenue").cast("double").alias("revenue"), F.sum("units").alias("units"),
        F.sum("line_count").alias("line_count"), F.count(F.lit(1)).alias("product_count"),
        F.max("last_line")["country"].alias("country"))


def last_country() -> Column:
    """Country of the last line in source order that has one."""
    return F.max(F.when(F.col("country").isNotNull(),
                        F.struct("line_position", "country"))).alias("last_line")


def quality_counters(raw: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Eleven counters in one row; ``reconciled`` must be standardised."""
    known, credit = F.col("customer_id").isNotNull(), is_credit()
    sale = _positive_sale()
    dated = F.col("invoice_date").isNotNull()
    counters = {
        "reconciled_lines": F.lit(True),
        "identified_purchase_lines": sale & known & is_product() & dated,
        "identified_credit_lines": credit & (F.col("quantity") < 0) & known & dated,
        "anonymous_candidate_purchase_lines": sale & ~known & is_product(),
        "known_customer_nonproduct_sale_lines_excluded": sale & known & ~is_product(),
        "missing_customer_ids": ~known,
        "cancel_prefix_lines": credit,
        "negative_quantity_lines_without_cancel_prefix": (F.col("quantity") < 0) & ~credit,
        "nonpositive_price_lines": F.col("unit_price") <= 0,
    }
    after = reconciled.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])
    before = raw.agg(F.count(F.lit(1)).alias("raw_lines"))
    both = before.unionByName(after, allowMissingColumns=True)
    return both.agg(
        F.sum("raw_lines").alias("raw_lines"),
        (F.sum("raw_lines") - F.sum("reconciled_lines")).alias("overlap_excess_lines_removed"),
        *[F.sum(n).alias(n) for n in counters])


def keep_first(lines: DataFrame, raw_columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """The first copy of every raw row in source order, with its lineage and the number of copies.

    The order of a copy (batch, then row) is one number, so the survivor is a plain minimum: nothing is
    sorted and no group is gathered. Batch names come back by the batch's order, one row per extract.
    """
    position = F.expr(LINE_POSITION.removesuffix(" AS line_position"))
    first = lines.groupBy(*raw_columns).agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("copies"))
    batches = lines.select(F.col("batch_order").alias("_batch"), "source_sheet", "source_sheet_role").distinct()
    kept = first.withColumns({"batch_order": F.shiftright("_first", 48).cast("int"),
                              "source_row": F.col("_first").bitwiseAND(F.lit((1 << 48) - 1))})
    return kept.join(F.broadcast(batches), F.col("batch_order") == F.col("_batch")).select(
        *raw_columns, "source_sheet", "source_row", "source_sheet_role", "batch_order", "copies")


def drop_exact_duplicates(lines: DataFrame, raw_columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Global exact dedup: one row per distinct raw row."""
    return lines.select(*raw_columns).distinct()
