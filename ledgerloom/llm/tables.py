"""Input tables of the training-data queries and the columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a document without an id never trains a model."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unit_hash(column: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the value only."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, stratum: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows in all, spread evenly over the strata (all of a stratum that has fewer).

    A row is kept by the hash of its key, so reruns agree and no stratum is sorted or gathered:
    the only exchange carries one count per stratum and task. The number of kept rows varies
    around its expectation by the square root of ``most``.
    """
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.withColumn("_share", F.lit(float(most)) / F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) / F.col("_n"))
    share = F.broadcast(share.select(F.col(stratum).alias("_stratum"), "_share"))  # one row per class or language
    kept = rows.join(share, F.col(stratum) == F.col("_stratum"))
    return kept.where(unit_hash(key, 17) < F.col("_share")).drop("_stratum", "_share")


def one_text_each(rows: DataFrame, key: str, *further: str) -> DataFrame:
    """One row per key with its text: the one with the smallest hash, so that repeated ids cannot swell a bounded sample."""
    least = F.min(F.struct(F.xxhash64("text", *further).alias("_h"), "text", *further)).alias("_r")
    return rows.groupBy(key).agg(least).select(key, "_r.text", *[f"_r.{c}" for c in further])
