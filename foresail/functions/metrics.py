"""Forecast errors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smape(actual: Column, forecast: Column, factor: float = 200.0) -> Column:
    """factor * |y - f| / (|y| + |f|); null where both are zero."""
    return F.try_divide(F.lit(factor) * F.abs(actual - forecast), F.abs(actual) + F.abs(forecast))


def absolute_percentage(actual: Column, forecast: Column) -> Column:
    return F.try_divide(F.lit(100.0) * F.abs(actual - forecast), F.abs(actual))


def seasonal_scale(train: Column, m: int) -> Column:
    """The mean absolute difference of values m apart: what mase divides by.  Null if there is none."""
    n = F.size(train)
    gaps = F.zip_with(F.slice(train, m + 1, F.greatest(n - m, F.lit(0))), F.slice(train, 1, F.greatest(n - m, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(gaps), F.lit(0)))


def owa(smape_value: Column, mase_value: Column, smape_reference: Column, mase_reference: Column) -> Column:
    return (F.try_divide(smape_value, smape_reference) + F.try_divide(mase_value, mase_reference)) / 2


def r6(column: Column) -> Column:
    """Rounded to six decimals, as reports are."""
    return F.round(column, 6)
