"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source is a stream of words: its documents in an order given by a hash, laid end to end and
cut into blocks of ``block_words`` words. Golden-ratio points are mapped through the cumulative
target shares to a source per slot; the k-th slot of a source takes the k-th block of its stream,
starting over after the last block. A source ends exactly at its target: slots beyond it are left
out, slots that it lacks after the last point are appended, and its last slot takes part of a block.

Nulls and odd rows: a null text has no words and is never taken; null sources form one source that
sorts last; documents that share a doc_id (or all columns) are separate documents; an empty table
gives an empty result; further columns are ignored by :func:`mix` and kept by :func:`mixed_rows`.

No group is gathered: positions and ranks are sums over buckets of about sqrt(n) rows, and the
join of blocks and slots is keyed by (source, block), so a source with a third of all rows is
spread over as many keys as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.llm.tables import WORD
from ledgerloom.scratch import materialise

GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0
NO_ID = -(1 << 63)


def targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """One row per source: source_key, source_size, target.

    ``sized`` has (source, size). Sources by code point, nulls last, weigh ``weights`` in turn and
    share the sum of all sizes; a target stops at ``most_epochs`` times its source's size and the
    excess is shared again by weight, until none is above. Equivalent and without iteration: in
    ascending order of ceiling per weight, sources are capped as long as the level that the rest
    would get reaches their ceiling. Works on one row per source.
    """
    everything = W.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    per = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("_place", place).withColumn("_w", weight.cast("decimal(38,0)"))
           .withColumn("_cap", (F.lit(most_epochs) * F.col("source_size")).cast("decimal(38,0)")))
    order = everything.orderBy(F.col("_cap").cast("double") / F.col("_w").cast("double"), "_place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0).cast("decimal(38,0)")

    def whole(c):
        return F.sum(c).over(everything).cast("decimal(38,0)")

    rest_w = whole("_w") - F.coalesce(F.sum("_w").over(before), zero)
    rest = whole("source_size") - F.coalesce(F.sum("_cap").over(before), zero)
    per = per.withColumn("_fits", (F.col("_cap").cast("double") * rest_w.cast("double")
                                   <= F.col("_w").cast("double") * rest.cast("double")).cast("int"))
    per = per.withColumn("_capped", F.min("_fits").over(so_far) == 1)
    spent = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), zero)
    used = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_w"))).over(everything), zero)
    level = F.try_divide((whole("source_size") - spent).cast("double"), (whole("_w") - used).cast("double"))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w").cast("double") * level)
    return per.select(source_key("source").alias("source_key"), "source_size", target.alias("target"))


def source_key(source: str):
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size): the words of each whole text, counted where the text is read."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def laid_out(sized: DataFrame, seed: int = 9) -> DataFrame:
    """Every document with its first word's position in its source's shuffled stream, written once.

    The order is that of md5(seed:doc_id); equal ids are ordered by size and text, which leaves
    only interchangeable rows.
    """
    sized = sized.withColumn("source_key", source_key("source")).withColumn(
        "_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    sized = materialise(sized, "mix-sizes")
    buckets = 1 << max(0, math.ceil(math.log2(max(1, sized.count())) / 2))
    head = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double")
    sized = sized.withColumn("_bucket", F.floor(head / float(1 << 32) * buckets).cast("int"))
    base = sized.groupBy("source_key", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("source_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = base.select("source_key", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = (W.partitionBy("source_key", "_bucket").orderBy("_order", "size", "text_hash")
              .rowsBetween(W.unboundedPreceding, -1))
    laid = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["source_key", "_bucket"])
    laid = laid.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source_key", "text_hash", "size",
                       (F.col("_base") + F.col("_in")).alias("first_word"))
    return materialise(laid, "mix-positions")


def schedule(per_source: DataFrame, block_words: int = 512, chunk: int = 4096, cells: int = 4096) -> DataFrame:
    """The mix, one row per slot: slot, source_key, epoch, block, words taken from the block's start."""
    spark = per_source.sparkSession
    quota = F.floor(F.col("target") + 0.5).cast("long")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    per = per_source.where("source_size > 0").withColumn("_quota", quota).withColumn("_blocks", blocks)
    per = per.withColumn("_epochs", F.floor(F.col("_quota") / F.col("source_size")).cast("long"))
    rest = F.col("_quota") - F.col("_epochs") * F.col("source_size")
    per = per.withColumn("_slots", F.col("_epochs") * F.col("_blocks") + F.ceil(rest / block_words).cast("long"))
    order = W.partitionBy(F.lit(0)).orderBy("source_key")
    per = (per.withColumn("_upto", F.sum("_slots").over(order.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("_all", F.sum("_slots").over(W.partitionBy(F.lit(0)))))
    per = materialise(per.drop("target"), "mix-sources")
    slots = per.agg(F.coalesce(F.sum("_slots"), F.lit(0))).first()[0]

    # A point finds its source among those that reach into its cell of the unit interval.
    low, high = (F.col("_upto") - F.col("_slots")) / F.col("_all"), F.col("_upto") / F.col("_all")
    reach = per.where("_slots > 0").select(
        "source_key", low.alias("_low"), high.alias("_high"),
        F.explode(F.sequence(F.floor(low * cells), F.least(F.floor(high * cells), F.lit(cells - 1).cast("long")))).alias("_cell"))
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells))
    chosen = (points.join(reach, "_cell").where("_u >= _low and _u < _high")
              .select("slot", "source_key", F.floor(F.col("slot") / chunk).alias("_chunk")))

    # Rank inside a source: slots of earlier chunks plus the place inside the chunk.
    per_chunk = chosen.groupBy("source_key", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("source_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    per_chunk = per_chunk.select("source_key", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source_key", "_chunk").orderBy("slot")
    ranked = (chosen.withColumn("_in", F.row_number().over(inside) - 1).join(per_chunk, ["source_key", "_chunk"])
              .select("source_key", "slot", (F.col("_base") + F.col("_in")).alias("_rank")))
    reached = ranked.groupBy("source_key").agg(F.count(F.lit(1)).alias("_reached"))
    lacking = (per.join(reached, "source_key", "left")
               .where(F.col("_slots") > F.coalesce("_reached", F.lit(0)))
               .select("source_key", F.explode(F.sequence(F.coalesce("_reached", F.lit(0)), F.col("_slots") - 1)).alias("_rank")))
    ranked = ranked.unionByName(lacking.select("source_key", (F.lit(slots) + F.col("_rank")).alias("slot"), "_rank"))

    start = F.col("epoch") * F.col("source_size") + F.col("block") * block_words
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words, F.col("_quota") - start)
    return (ranked.join(per, "source_key").where("_rank < _slots")
            .withColumn("epoch", F.floor(F.col("_rank") / F.col("_blocks"))).withColumn("block", F.col("_rank") % F.col("_blocks"))
            .select("slot", "source_key", "epoch", "block", length.alias("words")))


def segments(laid: DataFrame, slots: DataFrame, block_words: int = 512) -> DataFrame:
    """What each slot takes: slot, epoch, row_id, doc_id, from_word, n_words, in words of the document."""
    last = F.floor((F.col("first_word") + F.col("size") - 1) / block_words)
    pieces = laid.where("size > 0").select(
        "row_id", "doc_id", "source_key", "first_word", "size",
        F.explode(F.sequence(F.floor(F.col("first_word") / block_words), last)).alias("block"))
    begin = F.greatest(F.col("first_word"), F.col("block") * block_words)
    end = F.least(F.col("first_word") + F.col("size"), F.col("block") * block_words + F.col("words"))
    return (pieces.join(slots, ["source_key", "block"]).where(end > begin)
            .select("slot", "epoch", "row_id", "doc_id", (begin - F.col("first_word")).alias("from_word"), (end - begin).alias("n_words")))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, block_words: int = 512,
        seed: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents in their streams, sources with targets, segments of the mix) of a table of documents."""
    laid = laid_out(sized_documents(docs), seed)
    per_source = materialise(targets(laid.select(F.when(F.col("source_key") != "null", F.expr("substring(source_key, 2)")).alias("source"), "size"),
                                     weights, most_epochs), "mix-targets")
    return laid, per_source, segments(laid, schedule(per_source, block_words), block_words)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    laid, per_source, parts = mix(docs, **options)
    taken = parts.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    return (laid.join(taken, "row_id", "left").join(per_source, "source_key")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, once per epoch in which their first word is taken.

    Documents stay whole: the one in which a source reaches its target is not cut, and documents
    without words, which cost nothing, stay once. Rows equal in doc_id, source and text are one
    row taken as often as all of them together.
    """
    laid, _, parts = mix(docs, **options)
    begun = parts.where("from_word = 0").groupBy("row_id").agg(F.countDistinct("epoch").alias("_begun"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.coalesce("_begun", F.lit(0)))
    counts = (laid.join(begun, "row_id", "left")
              .groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_mix_id"), F.col("source_key").alias("_mix_key"), F.col("text_hash").alias("_mix_hash"))
              .agg(F.sum(copies).cast("int").alias("_mix_copies")).where("_mix_copies > 0"))
    rows = docs.withColumns({"_mix_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_mix_key": source_key("source"), "_mix_hash": F.xxhash64("text")})
    return (rows.dropDuplicates(["_mix_id", "_mix_key", "_mix_hash"]).join(counts, ["_mix_id", "_mix_key", "_mix_hash"])
            .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
            .select(*docs.columns))
