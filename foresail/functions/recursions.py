"""Smoothing recursions as folds over an array column; every parameter may be a column or a number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once for each row, though lambdas in the body use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))


def ses_level(ys: Column, alpha: Column | float) -> Column:
    """The last level of simple exponential smoothing that starts at the first value."""
    a = _number(alpha)
    return F.aggregate(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), F.get(ys, F.lit(0)), lambda level, y: a * y + (1 - a) * level)


def ses_error(ys: Column, alpha: Column | float) -> Column:
    """The sum of squared one-step errors of simple exponential smoothing."""
    a = _number(alpha)
    start = F.struct(F.get(ys, F.lit(0)).alias("level"), F.lit(0.0).alias("sse"))
    done = F.aggregate(
        F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))),
        start,
        lambda s, y: F.struct((a * y + (1 - a) * s["level"]).alias("level"), (s["sse"] + (y - s["level"]) * (y - s["level"])).alias("sse")),
    )
    return done["sse"]


def holt_state(ys: Column, alpha: Column | float, beta: Column | float, phi: Column | float = 1.0) -> Column:
    """struct(level, trend) after damped trend smoothing that starts at y1 and y2 - y1."""
    a, b, p = _number(alpha), _number(beta), _number(phi)

    def step(s: Column, y: Column) -> Column:
        level = a * y + (1 - a) * (s["level"] + p * s["trend"])
        return F.struct(level.alias("level"), (b * (level - s["level"]) + (1 - b) * p * s["trend"]).alias("trend"))

    start = F.struct(F.get(ys, F.lit(0)).alias("level"), (F.get(ys, F.lit(1)) - F.get(ys, F.lit(0))).alias("trend"))
    return F.aggregate(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), start, step)


def damped_sum(phi: Column | float, steps: Column) -> Column:
    """phi + phi**2 + ... + phi**steps."""
    p = _number(phi)
    return F.when(p == 1, steps.cast("double")).otherwise(p * (1 - F.pow(p, steps)) / F.when(p != 1, 1 - p))


def deviations(ys: Column) -> Column:
    """The values less their mean."""
    return let(mean_of(ys), lambda mean: F.transform(ys, lambda y: y - mean))


def acf(dev: Column, lag: Column) -> Column:
    """The autocorrelation at a lag, with the divisor n, of deviations from the mean; null if all are zero."""
    n = F.size(dev)
    product = F.zip_with(F.slice(dev, 1, n - lag), F.slice(dev, (lag + 1).cast("int"), n - lag), lambda a, b: a * b)
    total = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
    return F.try_divide(F.aggregate(product, F.lit(0.0), lambda a, x: a + x), total)
