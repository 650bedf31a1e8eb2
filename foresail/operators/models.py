"""Closed-form forecasting models as array columns over one row for each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..sources.series import packed, split


def steps_of(h: int) -> Column:
    return F.sequence(F.lit(1), F.lit(h))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _mean_known(xs: Column) -> Column:
    return R.let(F.filter(xs, lambda x: x.isNotNull()), lambda k: R.mean_of(k))


def centred_average(ys: Column, m: int) -> Column:
    """The centred moving average of order m, or 2 x m if m is even, where its window is full: from the value m // 2 on."""
    half = m // 2
    last = F.size(ys) - 1 - half
    if m % 2:
        at = lambda i: _sum(F.slice(ys, i - half + 1, m)) / m
    else:
        at = lambda i: (_sum(F.slice(ys, i - half + 1, m)) + _sum(F.slice(ys, i - half + 2, m))) / (2 * m)
    return F.when(last >= half, F.transform(F.sequence(F.lit(half), last), at)).otherwise(F.array().cast("array<double>"))


def seasonal_index(ys: Column, m: int, multiplicative: bool = True) -> Column:
    """The m indices of classical decomposition: phase means of what the moving average leaves, set to mean one or zero."""
    half = m // 2
    apart = (lambda y, t: F.try_divide(y, t)) if multiplicative else (lambda y, t: y - t)
    rest = lambda own: R.let(centred_average(own, m), lambda trend: F.transform(trend, lambda t, j: apart(F.get(own, j + half), t)))

    def phase(found: Column) -> Column:
        first = lambda p: F.pmod(p - half, F.lit(m))
        own = lambda p: F.when(first(p) < F.size(found), F.transform(F.sequence(first(p), F.size(found) - 1, F.lit(m)), lambda j: F.get(found, j)))
        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: _mean_known(own(p)))

    means = R.let(R.let(ys, rest), phase)
    return R.let(means, lambda found: R.let(_mean_known(found), lambda level: F.transform(found, lambda x: apart(x, level))))


def seasonal_by_test(ys: Column, m: int, critical: float = 1.645) -> Column:
    """Whether the autocorrelation at lag m is over its bound; needs 3 m values, and m within the default lags."""
    n = F.size(ys)
    lags = F.sequence(F.lit(1), F.lit(m))
    found = R.let(R.deviations(ys), lambda dev: F.transform(lags, lambda k: R.acf(dev, k)))
    inner = lambda r: F.aggregate(F.slice(r, 1, m - 1), F.lit(0.0), lambda a, x: a + x * x)
    over = R.let(found, lambda r: F.abs(F.get(r, F.lit(m - 1))) > critical * F.sqrt((1 + 2 * inner(r)) / n))
    return F.coalesce(F.when((n >= 3 * m) & (F.floor(10 * F.log10(n)) >= m), over), F.lit(False))


def prepare(obs: DataFrame, m: int, h: int, test: bool = True, critical: float = 1.645) -> DataFrame:
    """(series_id, n, train, test, des, out, is_seasonal): train and test values, the train deseasonalised where the
    test finds a season (or always), and the seasonal index of each step ahead.

    Series are packed once; all else is worked out on the row of a series.
    """
    base = split(packed(obs), h)
    if m == 1:
        return base.withColumn("des", F.col("train")).withColumn("out", F.array_repeat(F.lit(1.0), h)).withColumn("is_seasonal", F.lit(False))
    found = seasonal_by_test(F.col("train"), m, critical) if test else F.lit(True)
    known = F.when(found, seasonal_index(F.col("train"), m))

    def parts(si: Column) -> Column:
        on = F.coalesce(F.size(si) > 0, F.lit(False))
        des = F.transform("train", lambda y, i: F.try_divide(y, F.get(si, i % m)))
        out = F.transform(steps_of(h), lambda s: F.get(si, ((F.col("n") + s - 1) % m).cast("int")))
        ones = F.array_repeat(F.lit(1.0), h)
        return F.struct(F.when(on, des).otherwise(F.col("train")).alias("des"), F.when(on, out).otherwise(ones).alias("out"), on.alias("on"))

    made = base.withColumn("p", R.let(known, parts))
    return made.select("series_id", "n", "train", "test", F.col("p.des").alias("des"), F.col("p.out").alias("out"), F.col("p.on").alias("is_seasonal"), *[c for c in base.columns if c == "unit"])


def line_of(ys: Column) -> Column:
    """struct(intercept, slope) of the least-squares line of an array on 1 .. n."""
    n = F.size(ys)
    sty = F.aggregate(F.transform(ys, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    sy = F.aggregate(ys, F.lit(0.0), lambda a, x: a + x)
    tbar = (n + 1) / 2
    slope = F.coalesce(F.try_divide(sty - tbar * sy, n * (n * n - 1.0) / 12), F.lit(0.0))
    return R.let(slope, lambda b: F.struct((sy / n - b * tbar).alias("intercept"), b.alias("slope")))


def line_through(points: Column) -> Column:
    """struct(intercept, slope) of the least-squares line through an array of struct(x, y)."""
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))
    sums = F.struct(total(lambda p: p["x"]).alias("x"), total(lambda p: p["y"]).alias("y"), total(lambda p: p["x"] * p["x"]).alias("xx"), total(lambda p: p["x"] * p["y"]).alias("xy"), F.size(points).alias("n"))

    def line(s: Column) -> Column:
        slope = F.coalesce(F.try_divide(s["xy"] - s["x"] * s["y"] / s["n"], s["xx"] - s["x"] * s["x"] / s["n"]), F.lit(0.0))
        return R.let(slope, lambda b: F.struct(((s["y"] - b * s["x"]) / s["n"]).alias("intercept"), b.alias("slope")))

    return R.let(sums, line)


def flat(level: Column, h: int) -> Column:
    return F.array_repeat(level, h)


def naive(ys: Column, h: int) -> Column:
    return flat(F.element_at(ys, -1), h)


def seasonal_naive(ys: Column, m: int, h: int) -> Column:
    return F.transform(steps_of(h), lambda s: F.get(ys, F.size(ys) - m + (s - 1) % m))


def ses(ys: Column, alpha: Column | float, h: int) -> Column:
    return flat(R.ses_level(ys, alpha), h)


def holt(ys: Column, alpha: Column | float, beta: Column | float, h: int, phi: float = 1.0) -> Column:
    state = R.holt_state(ys, alpha, beta, phi)
    return R.let(state, lambda x: F.transform(steps_of(h), lambda s: x["level"] + x["trend"] * R.damped_sum(phi, s)))


def theta(ys: Column, alpha: Column | float, h: int, weight: float = 2.0) -> Column:
    """The theta method: the mean of the trend line and of smoothing the line `weight` times the data less the trend; no forecast is below zero."""
    def level(line: Column) -> Column:
        curved = F.transform(ys, lambda y, i: weight * y + (1 - weight) * (line["intercept"] + line["slope"] * (i + 1)))
        return F.struct(line["intercept"].alias("intercept"), line["slope"].alias("slope"), R.ses_level(curved, alpha).alias("level"))

    def ahead(x: Column) -> Column:
        line = lambda s: x["intercept"] + x["slope"] * (F.size(ys) + s)
        return F.transform(steps_of(h), lambda s: F.greatest(x["level"] / weight + (1 - 1 / weight) * line(s), F.lit(0.0)))

    return R.let(R.let(line_of(ys), level), ahead)


def mean_last(ys: Column, k: int, h: int) -> Column:
    return flat(R.mean_of(F.slice(ys, F.greatest(F.size(ys) - k + 1, F.lit(1)), k)), h)


def bunch_line(ys: Column, h: int, most: int | None = None) -> Column:
    """Bunch linear extrapolation: the last value and the median slope of the lines from every earlier point to it."""
    own = F.slice(ys, F.greatest(F.size(ys) - most + 1, F.lit(1)), most) if most else ys
    n, last = F.size(own), F.element_at(own, -1)
    slopes = F.array_sort(R.let(last, lambda x: F.transform(F.slice(own, 1, n - 1), lambda y, i: (x - y) / (n - i - 1))))

    def middle(found: Column) -> Column:
        k = F.size(found)
        return (F.get(found, F.floor((k - 1) / 2).cast("int")) + F.get(found, F.floor(k / 2).cast("int"))) / 2

    return R.let(R.let(slopes, middle), lambda slope: F.transform(steps_of(h), lambda s: last + s * slope))


def forecasts(prepared: DataFrame, models: dict[str, Column]) -> DataFrame:
    """(series_id, model, step, mean, actual): the given array columns, one row for each step; and scale and unit, if series have them."""
    named = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("f")) for k, v in models.items()])
    kept = [c for c in ("scale", "unit") if c in prepared.columns]
    rows = prepared.select("series_id", "test", *kept, F.explode(named).alias("m")).select("series_id", "m.model", "test", *kept, F.posexplode("m.f").alias("i", "mean"))
    return rows.select("series_id", "model", (F.col("i") + 1).cast("long").alias("step"), "mean", F.get("test", F.col("i")).alias("actual"), *kept)


def reseasoned(fc: Column) -> Column:
    return F.zip_with(fc, F.col("out"), lambda f, s: f * s)


def benchmark_models(m: int, h: int, alpha: float = 0.3, beta: float = 0.1, phi: float = 0.9) -> dict[str, Column]:
    """The eight benchmark methods, with the given smoothing parameters."""
    des = F.col("des")
    smooth, trend, damped = ses(des, alpha, h), holt(des, alpha, beta, h), holt(des, alpha, beta, h, phi)
    mean = F.zip_with(F.zip_with(smooth, trend, lambda a, b: a + b), damped, lambda a, b: (a + b) / 3)
    return {
        "naive": naive(F.col("train"), h),
        "snaive": seasonal_naive(F.col("train"), m, h) if m > 1 else naive(F.col("train"), h),
        "naive2": reseasoned(naive(des, h)),
        "ses": reseasoned(smooth),
        "holt": reseasoned(trend),
        "damped": reseasoned(damped),
        "theta": reseasoned(theta(des, alpha, h)),
        "comb": reseasoned(mean),
    }
