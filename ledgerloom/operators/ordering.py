"""Ranks, running totals and exact quantiles that never gather a group in one task.

A window ordered inside a large group, or ``percentile`` on it, puts the whole group into one
task. Here rows are range-partitioned by (group, order), so a group that holds a third of the
table is spread over many partitions; only one small row per (group, partition) is combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.scratch import materialise

# Largest table that is broadcast, in rows of keys and a few numbers.
BROADCAST_ROWS = 100000
# Rows of one key from which on they are spread over SALTS partitions.
HEAVY_ROWS = 100000
SALTS = 16
# Share of the values on either side of a median that are placed exactly.
NEAR = 0.005
# Values around a variable's median that one task may add up; of more they are laid out over many.
FEW_VALUES = 1_000_000
# Values that a summary of a column keeps, and rows that are sorted at a time for one.
CUT_POINTS, SUMMARY_ROWS = 20_000, 16_384


def join_marks(rows: DataFrame, marks: DataFrame, keys: list[str], spread_by: str, size: str) -> DataFrame:
    """Null-safe left join of a fact table with a table that has one row per key.

    ``marks`` has to be stored: it is counted. ``size`` is its column with the rows that a key has; keys of
    more than ``HEAVY_ROWS`` rows have to be among the marks. Few marks are broadcast, so the rows are not
    moved at all. Of many marks only the heavy ones are, of which there are few; their rows are dealt out,
    and the others are joined by sort and merge. Spark's estimate of the marks' size is not asked: it
    reads the compressed size of the files.
    """
    values = [c for c in marks.columns if c not in keys]

    def beside(part: DataFrame, prefix: str) -> DataFrame:
        return part.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[F.col(v).alias(f"{prefix}v_{v}") for v in values])

    def joined(left: DataFrame, right: DataFrame, prefix: str, *more: Column) -> DataFrame:
        condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys] + list(more))
        return left.join(right, condition, "left").drop(*[f"{prefix}{k}" for k in keys])

    if marks.count() <= BROADCAST_ROWS:
        out = joined(rows, F.broadcast(beside(marks, "_r_")), "_r_")
        return out.withColumnsRenamed({f"_r_v_{v}": v for v in values})
    heavy, light = marks.filter(F.col(size) > HEAVY_ROWS), beside(marks.filter(F.col(size) <= HEAVY_ROWS), "_r_")
    first = joined(rows, F.broadcast(beside(heavy, "_h_")), "_h_")
    # A heavy key has no light mark, so its rows may go anywhere.
    first = first.withColumn("_salt", F.when(F.col(f"_h_v_{size}").isNotNull(), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(0).cast("int"))
    light = light.withColumn("_r_salt", F.lit(0)).hint("merge")
    out = joined(first, light, "_r_", first["_salt"] == light["_r_salt"])
    return out.withColumns({v: F.coalesce(f"_h_v_{v}", f"_r_v_{v}") for v in values}).drop(
        "_salt", "_r_salt", *[f"{p}v_{v}" for p in ("_h_", "_r_") for v in values])


def _lay_out(df: DataFrame, order: list[Column], groups: list[str]) -> DataFrame:
    """Rows in total order with their slice and position inside it, written once.

    The positions come from the physical layout, so the laid-out rows are stored before
    anything reads them: a rerun task cannot see different slices.
    """
    keys = [F.col(g).asc() for g in groups] + order
    laid = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id()), "ordered")
    return (laid.withColumn("_slice", F.shiftright("_pos", 33))
            .withColumn("_row", F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))).drop("_pos"))


def _attach(laid: DataFrame, per_slice: DataFrame, groups: list[str]) -> DataFrame:
    """Join the (group, slice) table back; it has at most #groups + #slices rows."""
    keys = groups + ["_slice"]
    right = per_slice.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                             *[c for c in per_slice.columns if c not in keys])
    condition = reduce(lambda a, b: a & b, [laid[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return laid.join(right, condition, "inner").drop(*[f"_r_{k}" for k in keys])


def ranked(df: DataFrame, order: list[Column], groups: list[str] | None = None,
           rank: str = "rank", size: str | None = None) -> DataFrame:
    """Add the 1-based position in ``order`` inside each group, and optionally the group size.

    ``order`` must end in a unique key so that the rank is deterministic.
    """
    groups = list(groups or [])
    laid = _lay_out(df, order, groups)
    per_slice = laid.groupBy(*groups, "_slice").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    earlier = within.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    per_slice = (per_slice.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                 .withColumn("_size", F.sum("_n").over(within)).drop("_n"))
    out = _attach(laid, per_slice, groups)
    out = out.withColumn(rank, F.col("_before") + F.col("_row") - F.col("_first") + 1)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_slice", "_row", "_first", "_before", "_size")


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str],
                   groups: list[str] | None = None) -> DataFrame:
    """Inclusive running sums in ``order``; ``totals`` maps output name to input column.

    Each output ``x`` also gets ``x_total``, the sum over the whole group.
    """
    groups = list(groups or [])
    laid = _lay_out(df, order, groups)
    per_slice = laid.groupBy(*groups, "_slice").agg(
        *[F.sum(c).alias(f"_s_{name}") for name, c in totals.items()])
    within = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    earlier = within.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    for name in totals:
        part = F.col(f"_s_{name}")
        per_slice = (per_slice.withColumn(f"_b_{name}", F.coalesce(F.sum(part).over(earlier), F.lit(0)))
                     .withColumn(f"{name}_total", F.sum(part).over(within)))
    per_slice = per_slice.drop(*[f"_s_{name}" for name in totals])
    out = _attach(laid, per_slice, groups)
    local = W.partitionBy(*groups, "_slice").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    for name, c in totals.items():
        out = out.withColumn(name, F.col(f"_b_{name}") + F.sum(c).over(local))
    return out.drop("_slice", "_row", *[f"_b_{name}" for name in totals])


def exact_quantiles(df: DataFrame, values: list[str], probabilities: list[float],
                    groups: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: (groups…, variable, probability, quantile, n).

    Equal values are counted first, so a value that most rows share is one row. The distinct values
    are laid out on range partitions, their counts added up in order, and the two order statistics
    around each probability are the values whose ranks hold them: no group is gathered, sampled or
    treated apart, and no value's ties meet in one task.
    """
    groups = list(groups or [])
    keys = groups + ["variable"]
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values])
    long = df.select(*groups, F.explode(pairs).alias("_p")).select(*groups, "_p.*").filter(F.col("value").isNotNull())
    return _counted_quantiles(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c")), keys, probabilities)


def _counted_quantiles(counted: DataFrame, keys: list[str], probabilities: list[float], few: bool = False) -> DataFrame:
    """Quantiles of values with their counts ``_c``. With ``few`` a group is known to be small: it is added up as one, without being laid out first."""
    if few:
        group = W.partitionBy(*keys)
        placed = counted.withColumns({"_upto": F.sum("_c").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, 0)),
                                      "_upto_total": F.sum("_c").over(group)})
    else:
        placed = running_totals(counted, [F.col("value").asc()], {"_upto": "_c"}, keys)
    # A value has the ranks (from 0) from _upto - _c to _upto - 1; it matters to the probabilities whose spot lies on or beside one of them.
    asked = F.array(*[F.struct(F.lit(float(p)).alias("probability"), (F.lit(float(p)) * (F.col("_upto_total") - 1)).alias("spot")) for p in probabilities])
    holds = lambda rank: (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
    near = F.filter(asked, lambda q: holds(F.floor(q["spot"])) | holds(F.ceil(q["spot"])))
    hits = placed.select(*keys, F.col("_upto_total").alias("n"), "_upto", "_c", "value", F.explode(near).alias("_q")).select(
        *keys, "n", "_upto", "_c", "value", "_q.*")
    low = F.max(F.when(holds(F.floor("spot")), F.col("value")))
    high = F.max(F.when(holds(F.ceil("spot")), F.col("value")))
    return (hits.groupBy(*keys, "n", "probability", "spot").agg(low.alias("_a"), high.alias("_b"))
            .select(*keys, "probability", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("spot") - F.floor("spot"))).alias("quantile"), "n"))


def wide_quantiles(quantiles: DataFrame, groups: list[str], values: list[str],
                   probability: float, suffix: str = "") -> DataFrame:
    """One column per variable at one probability."""
    picked = quantiles.filter(F.col("probability") == F.lit(probability))
    aggregates = [F.max(F.when(F.col("variable") == v, F.col("quantile"))).alias(f"{v}{suffix}") for v in values]
    return picked.groupBy(*groups).agg(*aggregates) if groups else picked.agg(*aggregates)


def regrouped(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together and cut to ``most`` rows, the last one shorter."""
    held, count = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - count)
            batch = batch.slice(part.num_rows)
            held, count = held + [part], count + part.num_rows
            if count == most:
                yield pa.concat_batches(held)
                held, count = [], 0
    if held:
        yield pa.concat_batches(held)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values in order, each once, with the sum of their counts."""
    values, counts = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def condensed(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` + 1 of the values, the smallest and those at equal distances in rank; each stands for those from the kept one before it on."""
    if len(values) <= most + 1:
        return values, counts
    upto = np.cumsum(counts)
    at = np.unique(np.append(0, np.searchsorted(upto, -(-np.arange(1, most + 1) * int(upto[-1]) // most))))
    return values[at], np.diff(upto[at], prepend=0)


def column_summaries(batches, width: int, dropped: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values and counts of every column of ``x``, exact up to ``CUT_POINTS`` values; with ``dropped`` NaN is none.

    Summaries of as many rows are merged two by two, so that a value's rank is off by a share of 1 / ``CUT_POINTS``
    of the rows per doubling at most.
    """
    levels: list[list] = []  # per level nothing or one summary of every column
    for batch in regrouped(batches, SUMMARY_ROWS):
        x = np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T)
        if dropped:
            x = [column[~np.isnan(column)] for column in x]
        own = [merged([(column, np.ones(len(column), np.int64))]) for column in x]
        level = 0
        while level < len(levels) and levels[level]:
            own = [condensed(*merged([a, b]), CUT_POINTS) for a, b in zip(levels[level], own)]
            levels[level] = []
            level += 1
        levels += [[]] * (level + 1 - len(levels))
        levels[level] = own
    nothing = (np.zeros(0), np.zeros(0, np.int64))
    return [condensed(*merged([nothing, *[own[f] for own in levels if own]]), CUT_POINTS) for f in range(width)]


def array_quantiles(rows: DataFrame, column: str, width: int, probabilities: list[float], dropped: bool = False) -> list[np.ndarray]:
    """Approximate quantiles of every place of an array of ``width`` doubles, in one pass; none of a place without values.

    Each task sums its values up in sorted summaries, and one small table per place is merged from those. A quantile
    is the value whose rank is the probability's share of the rows, rounded up: exact while values are few.
    """
    asked = np.array(probabilities)

    def summaries(batches):
        for i, (values, counts) in enumerate(column_summaries(batches, width, dropped)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([values], pa.list_(pa.float64())), pa.array([counts], pa.list_(pa.int64()))], names=["i", "v", "c"])

    def at_ranks(key, parts):
        values, counts = merged([(np.asarray(v.values, float), np.asarray(c.values)) for v, c in zip(parts.column("v").combine_chunks(), parts.column("c").combine_chunks())])
        upto = np.cumsum(counts)
        found = values[np.searchsorted(upto, np.maximum(1, np.ceil(asked * upto[-1])))] if len(upto) else values
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "q": pa.array([found], pa.list_(pa.float64()))})

    made = rows.select(F.col(column).alias("x")).mapInArrow(summaries, "i int, v array<double>, c array<long>")
    found = {r["i"]: np.array(r["q"], float) for r in made.groupBy("i").applyInArrow(at_ranks, "i int, q array<double>").collect()}  # a few numbers per place
    return [found.get(i, np.zeros(0)) for i in range(width)]


def values_near_medians(df: DataFrame, values: list[str]) -> DataFrame:
    """(variable, value, _c): the values around each median with their counts, and one row for all smaller and all larger ones.

    An approximate quantile on either side bounds the median's place, a second pass counts what lies
    outside; a bound that proves wrong is given up. So only about a hundredth of the values is shuffled.
    """
    return _near_medians(df, values)[0]


def _near_medians(df: DataFrame, values: list[str]) -> tuple[DataFrame, int]:
    """The values near the medians, and of how many rows a variable's come at most."""
    columns = [F.col(v).cast("double") for v in values]
    found = array_quantiles(df.select(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns]).alias("x")), "x", len(columns), [0.5 - NEAR, 0.5 + NEAR], True)
    bounds = [[float(v) for v in q] if len(q) else [float("-inf"), float("nan")] for q in found]
    outside = df.agg(*[e.alias(f"{n}{i}") for i, (c, (low, high)) in enumerate(zip(columns, bounds))
                       for n, e in (("n", F.count(c)), ("l", F.count_if(c < F.lit(low))), ("h", F.count_if(c > F.lit(high))))]).first()
    between, rest, most = [], [], 0
    for i, (v, (low, high)) in enumerate(zip(values, bounds)):
        n, smaller, larger = (outside[f"{x}{i}"] for x in "nlh")
        if not (smaller <= (n - 1) // 2 and n // 2 < n - larger):
            low, high, smaller, larger = float("-inf"), float("nan"), 0, 0
        between.append((low, high))
        most = max(most, n - smaller - larger)
        rest += [(v, value, count) for value, count in ((float("-inf"), smaller), (float("nan"), larger)) if count]

    def near(batches):
        for batch in batches:
            for i, (low, high) in enumerate(between):
                column = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                inside = (column >= low) & (column <= high) if high == high else np.ones(len(column), bool)
                found, counts = merged([(column[inside], np.ones(np.count_nonzero(inside), np.int64))])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(found), pa.array(counts)], names=["i", "value", "c"])

    # One by one in numpy: a row per value would be made of all of them before those near the median are kept.
    long = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(near, "i int, value double, c bigint")
    counted = long.groupBy("i", "value").agg(F.sum("c").alias("_c")).select(F.array(*map(F.lit, values))[F.col("i")].alias("variable"), "value", "_c")
    return counted.unionByName(df.sparkSession.createDataFrame(rest, "variable string, value double, _c bigint")), most


def exact_medians(df: DataFrame, values: list[str], groups: list[str] | None = None,
                  suffix: str = "") -> DataFrame:
    """Wide table of exact medians per group. Without groups ``df`` is read three times and should be stored."""
    groups = list(groups or [])
    if not groups:
        near, most = _near_medians(df, values)
        return wide_quantiles(_counted_quantiles(near, ["variable"], [0.5], most <= FEW_VALUES), [], values, 0.5, suffix)
    return wide_quantiles(exact_quantiles(df, values, [0.5], groups), groups, values, 0.5, suffix)
