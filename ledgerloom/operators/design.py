"""Design matrices fitted on training rows only and applied to any later cohort.

Fitting is a few aggregates (medians, moments, ranges, category counts); a fitted design is a
list of SQL expressions, so applying it stays inside the scan that feeds the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import log1p_nonnegative
from ledgerloom.operators.ordering import exact_medians

MAX_CATEGORIES = 5000


def spline_basis(position: str, offset: str, interval: str, knots: int, extrapolation: str) -> list[str]:
    """SQL of a cubic B-spline basis on equally spaced knots, the last function left out.

    ``position`` is (x - low) / knot width, ``interval`` its knot interval and ``offset`` the
    place inside it. Only four functions are alive in an interval, each a cubic in the offset.
    Beyond the range the basis is frozen (``constant``) or continued with its boundary slope
    (``linear``).
    """
    t = offset
    pieces = [f"(1 - {t}) * (1 - {t}) * (1 - {t}) / 6", f"((3 * {t} - 6) * {t} * {t} + 4) / 6",
              f"(((-3 * {t} + 3) * {t} + 3) * {t} + 1) / 6", f"{t} * {t} * {t} / 6"]
    # Slopes per knot width of the three functions alive at a boundary knot.
    slopes = (-0.5, 0.0, 0.5)
    out = []
    for i in range(knots + 1):
        cases = " ".join(f"WHEN {i - k} THEN {piece}" for k, piece in enumerate(pieces) if 0 <= i - k < knots - 1)
        value = f"CASE {interval} {cases} ELSE 0D END"
        if extrapolation == "linear" and i < 3 and slopes[i]:
            value += f" + {slopes[i]}D * least({position}, 0D)"
        if extrapolation == "linear" and 0 <= i - (knots - 1) < 3 and slopes[i - (knots - 1)]:
            value += f" + {slopes[i - (knots - 1)]}D * greatest({position} - {knots - 1}, 0D)"
        out.append(f"({value})")
    return out


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Design:
    """What goes into the matrix; ``fit`` turns it into a ``FittedDesign``."""

    numeric: tuple[str, ...] = ()
    splines: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    country: bool = True
    log: bool = False                  # log1p after imputation
    scale: str = "numeric"             # "numeric", "all" or "none"
    indicators: str = "fitted"         # "fitted" (columns with NULLs at fit), "all" or "none"
    log_indicators: bool = False
    extrapolation: str = "constant"
    knots: int = 5
    pool_below: int = 0                # country categories rarer than this share one column

    def fit(self, train: DataFrame) -> "FittedDesign":
        inputs = list(dict.fromkeys(self.numeric + self.splines))
        medians, with_nulls, ranges = {}, [], {}
        if inputs:
            row = exact_medians(train, inputs).first()
            medians = {c: (0.0 if row is None or row[c] is None else float(row[c])) for c in inputs}
            probe = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in inputs]).first()
            with_nulls = [c for c in inputs if probe[c]]
        frequent, rare = [], []
        if self.country:
            counts = train.groupBy(F.coalesce("country", F.lit("Unknown")).alias("c")).count().limit(MAX_CATEGORIES + 1).collect()
            if len(counts) > MAX_CATEGORIES:
                raise ValueError("too many categories for one column each")
            frequent = sorted(r["c"] for r in counts if r["count"] >= self.pool_below)
            rare = sorted(r["c"] for r in counts if r["count"] < self.pool_below)
        fitted = FittedDesign(self, medians, tuple(with_nulls), tuple(frequent), tuple(rare))
        if self.splines:
            filled = train.selectExpr(*[f"{fitted.filled(c)} AS s{i}" for i, c in enumerate(self.splines)])
            moments = filled.agg(*[f(f"s{i}").alias(f"{n}{i}") for i in range(len(self.splines))
                                   for n, f in (("low", F.min), ("high", F.max), ("sd", F.stddev_pop))]).first()
            ranges = {c: (float(moments[f"low{i}"]), float(moments[f"high{i}"])) for i, c in enumerate(self.splines)
                      if moments[f"sd{i}"] > 1e-10}  # constant columns have no basis
            fitted = replace(fitted, ranges=ranges)
        if self.scale != "none":
            vectors = fitted.transform(train.select(*fitted.inputs), "_v")
            moments = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("m")).first()["m"]
            n = moments["count"]
            scaling = {}
            for name, block, mean, variance in zip(fitted.names, fitted.blocks, moments["mean"], moments["variance"]):
                if block or self.scale == "all":
                    deviation = math.sqrt(max(float(variance), 0.0) * (n - 1) / n)  # population deviation
                    scaling[name] = (float(mean), deviation if deviation > 1e-12 else 1.0)
            fitted = replace(fitted, scaling=scaling)
        return fitted


@dataclass(frozen=True)
class FittedDesign:
    design: Design
    medians: dict
    with_nulls: tuple[str, ...]
    frequent: tuple[str, ...]
    rare: tuple[str, ...]
    ranges: dict = field(default_factory=dict)
    scaling: dict = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        d = self.design
        return list(dict.fromkeys(d.numeric + d.splines + d.passthrough + (("country",) if d.country else ())))

    def filled(self, column: str) -> str:
        value = f"coalesce(CAST(`{column}` AS DOUBLE), {self.medians[column]!r}D)"
        return f"ln(1 + greatest({value}, 0D))" if self.design.log else value

    def _plan(self) -> tuple[list[tuple[str, str]], list[tuple[str, str]], list[tuple[str, str, bool]]]:
        """Two helper stages and the matrix columns (name, SQL, in the numeric block).

        Values used several times are computed once, in a stage of their own.
        """
        d = self.design
        first, second, out = [], [], [(c, self.filled(c), True) for c in d.numeric]
        knots = d.knots
        for k, c in enumerate(c for c in d.splines if c in self.ranges):
            low, high = self.ranges[c]
            first.append((f"_u{k}", f"({self.filled(c)} - {low!r}D) / {(high - low) / (knots - 1)!r}D"))
            inside = f"greatest(0D, least({knots - 1}D, _u{k}))"
            second += [(f"_j{k}", f"CAST(least({knots - 2}, floor({inside})) AS INT)"),
                       (f"_t{k}", f"{inside} - least({knots - 2}, floor({inside}))")]
            out += [(f"{c}__spline{i}", b, True) for i, b in enumerate(
                spline_basis(f"_u{k}", f"_t{k}", f"_j{k}", knots, d.extrapolation))]
        if d.indicators != "none":
            inputs = list(dict.fromkeys(d.numeric + d.splines))
            for c in inputs if d.indicators == "all" else self.with_nulls:
                flag = f"CAST(`{c}` IS NULL AS DOUBLE)"
                out.append((f"{c}__missing", f"ln(1 + {flag})" if d.log_indicators else flag, True))
        out += [(c, f"CAST(`{c}` AS DOUBLE)", False) for c in d.passthrough]
        if d.country:
            # Unseen countries match no column: all zeros.
            out += [(f"country__{c}", f"CAST(coalesce(country, 'Unknown') = {_text(c)} AS DOUBLE)", False) for c in self.frequent]
            if self.rare:
                listed = ", ".join(_text(c) for c in self.rare)
                out.append(("country__rare", f"CAST(coalesce(country, 'Unknown') IN ({listed}) AS DOUBLE)", False))
        return first, second, out

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self._plan()[2]]

    @property
    def blocks(self) -> list[bool]:
        return [b for _, _, b in self._plan()[2]]

    def transform(self, rows: DataFrame, output: str = "features") -> DataFrame:
        """Rows with one vector column."""
        first, second, columns = self._plan()
        kept = [f"`{c}`" for c in rows.columns]
        staged, so_far = rows, list(kept)
        for stage in (first, second):
            if stage:
                staged = staged.selectExpr(*so_far, *[f"{sql} AS {name}" for name, sql in stage])
                so_far = so_far + [name for name, _ in stage]

        def scaled(name: str, sql: str) -> str:
            if name not in self.scaling:
                return sql
            mean, deviation = self.scaling[name]
            return f"({sql} - ({mean!r}D)) / {deviation!r}D"

        wide = staged.selectExpr(*kept, *[f"{scaled(n, sql)} AS _x{i}" for i, (n, sql, _) in enumerate(columns)])
        assembler = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(columns))], outputCol=output)
        return assembler.transform(wide).selectExpr(*kept, output)


def plain_design(numeric: list[str], scale: bool = True, country: bool = True) -> Design:
    """Median imputation, missing flags, optional scaling, one-hot country."""
    return Design(numeric=tuple(numeric), scale="numeric" if scale else "none", country=country)


def logged_design(numeric: list[str], calendar: list[str]) -> Design:
    """log1p of the imputed inputs and their missing flags, scaled; calendar as it is."""
    return Design(numeric=tuple(c for c in numeric if c not in calendar), log=True, log_indicators=True,
                  passthrough=tuple(c for c in calendar if c in numeric))


def additive_design(features: list[str], calendar: list[str], pool_below: int = 20) -> Design:
    """Splines of logged features, calendar, all missing flags and pooled country, all scaled."""
    return Design(splines=tuple(features), log=True, passthrough=tuple(calendar), indicators="all",
                  scale="all", pool_below=pool_below)


def spline_design(features: list[str]) -> Design:
    """Unlogged splines with linear continuation, scaled."""
    return Design(splines=tuple(features), extrapolation="linear")


def segment_design(features: list[str]) -> Design:
    return Design(numeric=tuple(features), log=True, log_indicators=True, country=False)


def sequence_scaling(rows: DataFrame, channels: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of log1p values per channel over customers and weeks."""
    flat = rows.select(F.explode("weeks").alias("w"))
    values = {c: log1p_nonnegative(F.col(f"w.{c}").cast("double")) for c in channels}
    row = flat.agg(*[f(v).alias(f"{n}_{c}") for c, v in values.items()
                     for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (float(row[f"m_{c}"]), max(float(row[f"s_{c}"]), 1e-4)) for c in channels}


def scaled_sequence(channels: list[str], scaling: dict[str, tuple[float, float]]) -> Column:
    """Flat array of scaled log1p channel values, week by week."""
    def one(w: Column) -> Column:
        return F.array(*[(log1p_nonnegative(w[c].cast("double")) - scaling[c][0]) / scaling[c][1] for c in channels])
    return F.flatten(F.transform("weeks", one))
