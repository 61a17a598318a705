"""Column expressions; everything here stays inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def finite_or_null(c: str) -> str:
    """SQL: NaN and infinities become NULL (NaN compares greater than every number)."""
    return f"CASE WHEN abs({c}) < double('Infinity') THEN {c} END"


def to_units(money: str) -> str:
    """SQL: money as whole ten-thousandths. Sums stay exact and much cheaper than wide decimals.

    An overflow (beyond 900 trillion) raises instead of wrapping.
    """
    return f"CAST({money} * 10000 AS BIGINT)"


def from_units(units: str) -> str:
    return f"({units}) / 10000D"


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def days_between(later: str, earlier: str) -> str:
    """SQL: elapsed days between two zone-less timestamps, with the fraction of a day.

    The fields of a zone-less timestamp are read without any time zone; extract(SECOND) keeps
    the fraction.
    """
    def seconds(ts: str) -> str:
        return f"(hour({ts}) * 3600 + minute({ts}) * 60 + CAST(extract(SECOND FROM {ts}) AS DOUBLE))"
    return f"(datediff(to_date({later}), to_date({earlier})) + ({seconds(later)} - {seconds(earlier)}) / 86400D)"


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a column; NULL stays NULL."""
    out = c
    if low is not None:
        out = F.when(c.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(c.isNotNull(), F.least(out, F.lit(high)))
    return out


def log1p_nonnegative(c: Column) -> Column:
    return F.log1p(clip(c, 0.0))


def logit(p: Column, floor: float = 1e-7) -> Column:
    bounded = clip(p, floor, 1 - floor)
    return F.log(bounded / (1 - bounded))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def month_angle(day: Column) -> Column:
    return 2 * math.pi * (F.month(day) - 1) / 12


def autumn_days_before(day: Column) -> Column:
    """Days in October-December before ``day``, counted from the year 1970.

    Differences of two values give the Oct-Dec exposure between two dates in closed form:
    92 days for every finished year plus the started season of the current one.
    """
    season = F.datediff(day, F.make_date(F.year(day), F.lit(10), F.lit(1)))
    return (F.year(day) - 1970) * 92 + F.greatest(season, F.lit(0))


def autumn_exposure(start: Column, end: Column) -> Column:
    return autumn_days_before(end) - autumn_days_before(start)


# Coefficients of Wichura's algorithm AS 241 (PPND16) for the normal quantile.
_CENTRAL_NUM = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
                1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
                3.3430575583588128105e4, 2.5090809287301226727e3]
_CENTRAL_DEN = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2,
                5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4,
                2.8729085735721942674e4, 5.2264952788528545610e3]
_MIDDLE_NUM = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
               3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
               2.27238449892691845833e-2, 7.74545014278341407640e-4]
_MIDDLE_DEN = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0,
               6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2,
               5.47593808499534494600e-4, 1.05075007164441684324e-9]
_TAIL_NUM = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
             2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
             2.71155556874348757815e-5, 2.01033439929228813265e-7]
_TAIL_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1,
             1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5,
             1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _ratio(numerator: list[float], denominator: list[float], x: Column) -> Column:
    def horner(coefficients):
        total = F.lit(coefficients[-1])
        for value in reversed(coefficients[:-1]):
            total = total * x + value
        return total
    return horner(numerator) / horner(denominator)


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal distribution function for 0 < p < 1."""
    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(tail <= 5, _ratio(_MIDDLE_NUM, _MIDDLE_DEN, tail - 1.6)).otherwise(
        _ratio(_TAIL_NUM, _TAIL_DEN, tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRAL_NUM, _CENTRAL_DEN, 0.180625 - q * q)).otherwise(
        F.when(q < 0, -outer).otherwise(outer))


def mixture_quantile(purchase_probability: Column, positive_quantile, q: float) -> Column:
    """Quantile of an atom at zero mixed with a positive distribution.

    ``positive_quantile`` maps a probability column to the positive part's quantile.
    """
    p = purchase_probability
    inner = clip((F.lit(q) - (1 - p)) / F.greatest(p, F.lit(1e-12)), 1e-8, 1 - 1e-8)
    return F.when(F.lit(q) <= 1 - p, F.lit(0.0)).otherwise(positive_quantile(inner))


def tweedie_deviance(actual: Column, predicted: Column) -> Column:
    """Unit Tweedie deviance at power 1.5, prediction floored at 1e-6."""
    p = F.greatest(predicted, F.lit(1e-6))
    return 4 * (actual / F.sqrt(p) + F.sqrt(p) - 2 * F.sqrt(actual))
