"""Forecasts of collections of several frequencies in one plan: the season m and the horizon h are columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import smape
from ..sources.files import written
from .models import line_of

#: Seasons beyond a day in hourly series, and the members that a selection averages.
WEEK, MEMBERS = 168, 3
LEVEL, TREND, DAMPING = 0.3, 0.1, 0.9
SEVEN = ("snaive", "naive2", "ses", "holt", "damped", "theta", "four theta")


def _upto(first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)))).otherwise(F.array().cast("array<int>"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def seasonal_by_test(ys: Column, m: Column) -> Column:
    """Whether the autocorrelation at lag m, a column, is over its bound; needs 3 m values, and m within the default lags."""
    n = F.size(ys)

    def over(r: Column) -> Column:
        before = F.aggregate(F.slice(r, 1, m - 1), F.lit(0.0), lambda a, x: a + x * x)
        return F.abs(F.element_at(r, -1)) > 1.645 * F.sqrt((1 + 2 * before) / n)

    found = R.let(R.let(R.deviations(ys), lambda dev: F.transform(F.sequence(F.lit(1), m), lambda k: R.acf(dev, k))), over)
    return F.coalesce(F.when((m > 1) & (n >= 3 * m) & (F.floor(10 * F.log10(n)) >= m), found), F.lit(False))


def seasonal_index(ys: Column, m: Column) -> Column:
    """The m indices of multiplicative decomposition; m is a column."""
    half = F.floor(m / 2).cast("int")

    def average(y: Column) -> Column:
        odd = lambda i: _sum(F.slice(y, i - half + 1, m)) / m
        even = lambda i: (_sum(F.slice(y, i - half + 1, m)) + _sum(F.slice(y, i - half + 2, m))) / (2 * m)
        ratio = lambda i: F.try_divide(F.get(y, i), F.when(m % 2 == 1, odd(i)).otherwise(even(i)))
        return F.transform(F.sequence(half, F.size(y) - 1 - half), ratio)

    known = lambda xs: R.let(F.filter(xs, lambda x: x.isNotNull()), R.mean_of)
    phase = lambda r: F.transform(F.sequence(F.lit(0), m - 1), lambda p: known(F.filter(r, lambda _, j: (j + half) % m == p)))
    return R.let(R.let(R.let(ys, average), phase), lambda x: R.let(known(x), lambda level: F.transform(x, lambda v: F.try_divide(v, level))))


def adjusted(rows: DataFrame, ys: str, season: str, h: Column) -> DataFrame:
    """Adds des, ys without its season where the test finds one, and out, the index of each step ahead."""
    m, values = F.col(season), F.col(ys)
    made = rows.withColumn("__si", F.when(seasonal_by_test(values, m), seasonal_index(values, m)))
    n, si = F.size(values), F.col("__si")
    des = F.when(si.isNotNull(), F.transform(values, lambda y, i: F.try_divide(y, F.get(si, i % m)))).otherwise(values)
    out = F.transform(F.sequence(F.lit(1), h), lambda s: F.when(si.isNotNull(), F.get(si, (n + s - 1) % m)).otherwise(F.lit(1.0)))
    return made.withColumn("des", des).withColumn("out", out).drop("__si")


def six_models(rows: DataFrame, ys: str, season: str, h: Column) -> Column:
    """array of struct(model, f) of seasonal naive and five models on the adjusted values of rows that `adjusted` made."""
    des, values, m, steps = F.col("des"), F.col(ys), F.col(season), F.sequence(F.lit(1), h)
    n = F.size(values)
    snaive = F.transform(steps, lambda s: F.get(values, n - m + (s - 1) % m))
    level = R.ses_level(des, LEVEL)
    trend = lambda phi: R.let(R.holt_state(des, LEVEL, TREND, phi), lambda x: F.transform(steps, lambda s: x["level"] + x["trend"] * R.damped_sum(phi, s)))

    def theta(line: Column) -> Column:
        bent = R.ses_level(F.transform(des, lambda y, i: 2 * y - (line["intercept"] + line["slope"] * (i + 1))), LEVEL)
        return R.let(bent, lambda v: F.transform(steps, lambda s: F.greatest((v + line["intercept"] + line["slope"] * (n + s)) / 2, F.lit(0.0))))

    back = lambda f: F.zip_with(f, "out", lambda a, b: a * b)
    named = {"snaive": snaive, "naive2": back(F.transform(steps, lambda _: F.element_at(des, -1))), "ses": back(R.let(level, lambda v: F.transform(steps, lambda _: v))), "holt": back(trend(1.0)), "damped": back(trend(DAMPING)), "theta": back(R.let(line_of(des), theta))}
    return F.array(*[F.struct(F.lit(k).alias("model"), v.alias("f")) for k, v in named.items()])


def hourly_season(rows: DataFrame) -> Column:
    """A week where its differences vary less than those of a day over the same stretch, else a day."""
    gap = lambda k: F.zip_with(F.slice("ys", k + 1, F.size("ys") - k), F.slice("ys", 1, F.size("ys") - k), lambda a, b: a - b)
    variance = lambda xs: R.let(R.deviations(xs), lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / (F.size(d) - 1))
    days = F.slice(gap(24), WEEK - 24 + 1, F.size("ys") - WEEK)
    return F.when((F.size("ys") > WEEK + 1) & (variance(gap(WEEK)) < variance(days)), F.lit(WEEK)).otherwise(F.lit(24))


def by_selection(rows: DataFrame, seventh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(period, series_id, step, mean): the mean of the three models that do best on the last h values, fitted to all.

    Rows have period, series_id, ys, m and h.  `seventh` gives (id, f) for rows (id, ys, m, h): the forecasts of the
    seventh model, which is tried on the same two parts of each series as the six others.
    """
    h, n = F.col("h"), F.size("ys")
    part = lambda k, ys, test: F.struct(F.lit(k).alias("part"), ys.alias("ys"), test.alias("test"))
    parts = F.array(part("held", F.slice("ys", 1, n - h), F.slice("ys", n - h + 1, h)), part("all", F.col("ys"), F.array().cast("array<double>")))
    both = rows.select("period", "series_id", "m", "h", F.explode(parts).alias("x")).select("period", "series_id", "m", "h", "x.*")
    both = both.withColumn("id", F.concat_ws("|", "period", "part", "series_id"))
    both = written(adjusted(both, "ys", "m", h), "adjusted")
    six = both.select("id", F.explode(six_models(both, "ys", "m", h)).alias("x")).select("id", "x.model", "x.f")
    fc = six.unionByName(seventh(both.select("id", "ys", "m", "h")).select("id", F.lit("four theta").alias("model"), "f"))
    fc = written(fc.join(both.select("id", "period", "series_id", "part", "test"), "id"), "seven-models")
    error = R.mean_of(F.zip_with("test", "f", lambda y, f: F.coalesce(smape(y, f), F.lit(0.0))))
    order = F.row_number().over(W.partitionBy("period", "series_id").orderBy(F.round(error, 6), F.array_position(F.array(*map(F.lit, SEVEN)), F.col("model"))))
    best = fc.where("part = 'held'").withColumn("k", order).where(F.col("k") <= MEMBERS).select("period", "series_id", "model")
    steps = fc.where("part = 'all'").join(best, ["period", "series_id", "model"]).select("period", "series_id", F.posexplode("f").alias("i", "f"))
    return steps.groupBy("period", "series_id", "i").agg(F.avg("f").alias("mean")).select("period", "series_id", (F.col("i") + 1).alias("step"), "mean")
