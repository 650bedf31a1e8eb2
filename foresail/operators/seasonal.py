"""Moving averages, seasonality tests and decompositions of observations (series_id, t, y)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.recursions import acf, deviations, let
from .preparation import by_series, ordered

#: One-sided 95 % normal quantile of the test.
CRITICAL = 1.645


def centered_average(obs: DataFrame, m: int, name: str = "trend") -> DataFrame:
    """Adds the centred moving average of order m, or 2 x m if m is even; null where the window is not full."""
    half = m // 2
    full = (F.col("t") > half) & (F.col("t") <= F.count(F.lit(1)).over(by_series()) - half)
    if m % 2:
        value = F.avg("y").over(ordered().rowsBetween(-half, half))
    else:
        value = (F.sum("y").over(ordered().rowsBetween(-half, half - 1)) + F.sum("y").over(ordered().rowsBetween(-half + 1, half))) / (2 * m)
    return obs.withColumn(name, F.when(full, value))


def ma3x3(obs: DataFrame, column: str = "y") -> DataFrame:
    """Adds ma: a three-term average of a three-term average.

    The second place from an end has the single average; the end has the mean of its two values, moved by half of what
    the next place is above the one after it.
    """
    w = ordered()
    near, n = w.rowsBetween(-1, 1), F.count(F.lit(1)).over(by_series())
    once = obs.withColumn("__n", n).withColumn("__a", F.when(F.count(column).over(near) == 3, F.avg(column).over(near)))
    inner = F.when((F.col("t") > 2) & (F.col("t") < F.col("__n") - 1), F.avg("__a").over(near)).otherwise(F.col("__a"))
    twice = once.withColumn("__b", inner)
    end = lambda k: (F.col(column) + F.lag(column, -k).over(w)) / 2 + (F.lag("__b", -k).over(w) - F.lag("__b", -2 * k).over(w)) / 2
    return twice.withColumn("ma", F.when(F.col("t") == 1, end(1)).when(F.col("t") == F.col("__n"), end(-1)).otherwise(F.col("__b"))).drop("__a", "__b", "__n")


def autocorrelations(packs: DataFrame, most: int | None = None) -> DataFrame:
    """(series_id, lag, r) for lags 1 .. min(n - 1, floor(10 log10 n)), or up to `most`."""
    top = F.least(F.col("n") - 1, F.floor(10 * F.log10(F.col("n")))) if most is None else F.least(F.col("n") - 1, F.lit(most))
    each = lambda dev: F.transform(F.sequence(F.lit(1), top.cast("int")), lambda k: F.struct(k.cast("long").alias("lag"), acf(dev, k).alias("r")))
    # folded on the row of the series: what is exploded are numbers, not copies of the series
    return packs.where(F.col("n") > 1).select("series_id", "n", F.explode(let(deviations(F.col("ys")), each)).alias("x")).select("series_id", "n", "x.lag", "x.r")


def seasonality_test(packs: DataFrame, m: int, critical: float = CRITICAL, squared_first: bool = True, default_lags: bool = True) -> DataFrame:
    """(series_id, r_m, bound, is_seasonal): whether the autocorrelation at lag m is over its bound.

    With `squared_first` the test needs 3 m values, and no lag beyond floor(10 log10 n) is seen if `default_lags`
    is set; without it the first lag enters unsquared and no length is asked for.
    """
    r = autocorrelations(packs, m)
    inner = F.when(F.col("lag") == 1, F.col("r") if not squared_first else F.col("r") * F.col("r")).otherwise(F.col("r") * F.col("r"))
    s = F.coalesce(F.sum(F.when(F.col("lag") < m, inner)), F.lit(0.0))
    found = r.groupBy("series_id").agg(F.max("n").alias("n"), F.max(F.when(F.col("lag") == m, F.col("r"))).alias("r_m"), s.alias("s"))
    bound = F.lit(critical) * F.sqrt(F.when(1 + 2 * F.col("s") >= 0, (1 + 2 * F.col("s")) / F.col("n")))
    fits = F.lit(True)
    if squared_first:
        fits = F.col("n") >= 3 * m
        if default_lags:
            fits = fits & (F.floor(10 * F.log10(F.col("n"))) >= m)
    return found.select("series_id", "r_m", bound.alias("bound"), F.coalesce(fits & (F.abs("r_m") > bound), F.lit(False)).alias("is_seasonal"))


def classical(obs: DataFrame, m: int, multiplicative: bool = True) -> DataFrame:
    """Adds trend, index and adjusted: moving average, phase means of the detrended values, and what is left of y."""
    made = centered_average(obs, m)
    detrended = F.try_divide("y", "trend") if multiplicative else F.col("y") - F.col("trend")
    made = made.withColumn("phase", ((F.col("t") - 1) % m).cast("long")).withColumn("__d", detrended)
    means = made.groupBy("series_id", "phase").agg(F.avg("__d").alias("__p"))
    level = F.avg("__p").over(W.partitionBy("series_id"))
    means = means.withColumn("index", F.try_divide("__p", level) if multiplicative else F.col("__p") - level)
    joined = made.join(means.select("series_id", "phase", "index"), ["series_id", "phase"])
    return joined.withColumn("adjusted", F.try_divide("y", "index") if multiplicative else F.col("y") - F.col("index")).drop("__d")


def trimmed_indices(obs: DataFrame, m: int) -> DataFrame:
    """(series_id, phase, n_ratio, index): phase means of ratios without those equal to the phase's largest or smallest.

    Phases that this leaves empty take the plain mean; with fewer than 3 m ratios, the median.  The mean index is 1.
    """
    made = centered_average(obs, m).withColumn("phase", ((F.col("t") - 1) % m).cast("long")).withColumn("le", F.try_divide("y", "trend")).where("le is not null")
    w = W.partitionBy("series_id", "phase")
    made = made.withColumn("__hi", F.max("le").over(w)).withColumn("__lo", F.min("le").over(w)).withColumn("__k", F.count(F.lit(1)).over(by_series()))
    inside = F.avg(F.when((F.col("le") < F.col("__hi")) & (F.col("le") > F.col("__lo")), F.col("le")))
    found = made.groupBy("series_id", "phase").agg(
        F.count(F.lit(1)).alias("n_ratio"), F.when(F.max("__k") >= 3 * m, F.coalesce(inside, F.avg("le"))).otherwise(F.median("le")).alias("__p"), F.var_pop("le").alias("__v"), F.avg("le").alias("__a")
    )
    about = F.col("__v") + (F.col("__a") - F.col("index")) * (F.col("__a") - F.col("index"))  # the mean square about the index
    return found.withColumn("index", F.try_divide("__p", F.avg("__p").over(by_series()))).withColumn(
        "spread", F.try_divide(about, (F.col("n_ratio") - 1).cast("double"))
    ).drop("__p", "__v", "__a")


def shrink(indices: DataFrame, m: int) -> DataFrame:
    """Adds james_stein and lemon_krutchkoff to indices with their `spread`, the squared error of each phase mean."""
    v = F.avg("spread").over(by_series())
    a = F.greatest(F.sum((F.col("index") - 1) * (F.col("index") - 1)).over(by_series()) / (m - 1) - v, F.lit(0.0))
    weight = F.coalesce(F.lit((m - 3) / (m - 1)) * F.try_divide(v, v + a), F.lit(0.0))
    made = indices.withColumn("v", v).withColumn("w", weight).withColumn("james_stein", F.col("w") + (1 - F.col("w")) * F.col("index"))
    pairs = made.select("series_id", F.col("phase").alias("p2"), F.col("index").alias("i2"))
    kernel = F.exp(F.try_divide(-(F.col("index") - F.col("i2")) * (F.col("index") - F.col("i2")), 2 * F.col("v")))
    smoothed = made.join(pairs, "series_id").groupBy("series_id", "phase").agg(F.try_divide(F.sum(kernel * F.col("i2")), F.sum(kernel)).alias("lemon_krutchkoff"))
    return made.join(smoothed, ["series_id", "phase"])


def chosen_shrinkage(shrunk: DataFrame) -> DataFrame:
    """Adds skew, used and shrunk to what `shrink` gives: the plain index, or one of the two that are drawn to one.

    The choice goes by the skewness of the indices and by the weight that draws them.
    """
    w = by_series()
    c = F.col("index") - F.avg("index").over(w)
    made = shrunk.withColumn("__c", c).withColumn("skew", F.avg(F.col("__c") * F.col("__c") * F.col("__c")).over(w) / F.pow(F.avg(F.col("__c") * F.col("__c")).over(w), F.lit(1.5)))
    plain, kernel = (F.col("skew") < 0.5) & (F.col("w") < 0.2), (F.col("skew") >= 0.5) & (F.col("w") < 0.5)
    used = F.when(plain, "classical").when(kernel, "lemon_krutchkoff").otherwise("james_stein")
    return made.withColumn("used", used).withColumn("shrunk", F.when(plain, F.col("index")).when(kernel, F.col("lemon_krutchkoff")).otherwise(F.col("james_stein"))).drop("__c")


def fourier(obs: DataFrame, m: int, terms: int) -> DataFrame:
    """Adds s1, c1 .. : sine and cosine pairs of the period m."""
    for k in range(1, terms + 1):
        angle = F.lit(2 * math.pi * k / m) * F.col("t")
        obs = obs.withColumn(f"s{k}", F.sin(angle)).withColumn(f"c{k}", F.cos(angle))
    return obs
