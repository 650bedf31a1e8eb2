"""Preparation of observations (series_id, t, y): filters, scaling, differences, detrending, lags and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec



def by_series() -> WindowSpec:
    return W.partitionBy("series_id")


def ordered() -> WindowSpec:
    return by_series().orderBy("t")


def holdout_part(obs: DataFrame, h: int) -> DataFrame:
    """Adds part: the last h of each series are the test."""
    return obs.withColumn("part", F.when(F.max("t").over(by_series()) - F.col("t") < h, "test").otherwise("train"))


def tail_cap(obs: DataFrame, most: int) -> DataFrame:
    return obs.withColumn("__n", F.max("t").over(by_series())).where(F.col("t") > F.col("__n") - most).drop("__n")


def head_cap(obs: DataFrame, most: int) -> DataFrame:
    return obs.where(F.col("t") <= most)


def zscore(obs: DataFrame, least: float = 0.01) -> DataFrame:
    """Adds z by the sample deviation, as it was where that is below `least`, and zp by that of the population."""
    mean, sd, sdp = F.avg("y").over(by_series()), F.stddev_samp("y").over(by_series()), F.stddev_pop("y").over(by_series())
    one = F.when(sdp == 0, F.when(mean == 0, 1.0).otherwise(mean)).otherwise(sdp)
    return obs.withColumn("z", F.when(sd < least, F.col("y")).otherwise(F.try_divide(F.col("y") - mean, sd))).withColumn("zp", F.try_divide(F.col("y") - mean, one))


def difference(obs: DataFrame, lag: int = 1, column: str = "y") -> DataFrame:
    return obs.withColumn("d", F.col(column) - F.lag(column, lag).over(ordered()))


def undifference(obs: DataFrame) -> DataFrame:
    """Adds back: the first value plus the running sum of the differences d."""
    return obs.withColumn("back", F.first("y").over(ordered()) + F.coalesce(F.sum("d").over(ordered().rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))


def log_return(obs: DataFrame) -> DataFrame:
    before = F.lag("y").over(ordered())
    both = (F.col("y") > 0) & (before > 0)
    return obs.withColumn("r", F.when(both, F.ln(F.when(F.col("y") > 0, F.col("y"))) - F.ln(F.when(before > 0, before))))


def box_cox(y: Column, power: float) -> Column:
    safe = F.when(y > 0, y)
    return F.ln(safe) if power == 0 else (F.pow(safe, F.lit(power)) - 1) / power


def inverse_box_cox(x: Column, power: float) -> Column:
    return F.exp(x) if power == 0 else F.pow(power * x + 1, F.lit(1 / power))


def trend_line(obs: DataFrame) -> DataFrame:
    """Adds the least-squares line of each series as `line`."""
    w = by_series()
    tbar, ybar = F.avg("t").over(w), F.avg("y").over(w)
    sxy = F.avg(F.col("t") * F.col("y")).over(w) - tbar * ybar
    sxx = F.avg(F.col("t") * F.col("t")).over(w) - tbar * tbar
    slope = F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0))
    return obs.withColumn("line", ybar + slope * (F.col("t") - tbar))


def detrend_geometric(obs: DataFrame) -> DataFrame:
    """Adds ratio: y over the line, which stays 0.01 away from zero."""
    line = F.when(F.abs("line") < 0.01, F.when(F.col("line") < 0, -0.01).otherwise(0.01)).otherwise(F.col("line"))
    return trend_line(obs).withColumn("ratio", F.col("y") / line)


def remove_phase_means(obs: DataFrame, m: int) -> DataFrame:
    return obs.withColumn("rest", F.col("y") - F.avg("y").over(W.partitionBy("series_id", (F.col("t") - 1) % m)))


def lags(obs: DataFrame, count: int) -> DataFrame:
    """Adds l1 .. l<count>; rows without all of them go."""
    for k in range(1, count + 1):
        obs = obs.withColumn(f"l{k}", F.lag("y", k).over(ordered()))
    return obs.where(F.col(f"l{count}").isNotNull())


def shifted_windows(packs: DataFrame, length: int, cycle: int) -> DataFrame:
    """Training windows of `length` that end 0 .. cycle-1 points before the end, as many as there are, with weight 1/k."""
    k = F.least(F.lit(cycle), F.col("n") - length + 1).cast("int")
    made = packs.where(F.col("n") >= length).withColumn("k", k).withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    first = (F.col("n") - length - F.col("shift") + 1).cast("int")
    return made.select("series_id", F.col("shift").cast("long").alias("shift"), (1.0 / F.col("k")).alias("weight"), F.slice("ys", first, length).alias("window"))


def pad_left(packs: DataFrame, length: int, m: int) -> DataFrame:
    """Short series get, for each missing point in front, the same phase of the first cycle that has it."""
    missing = F.greatest(F.lit(length) - F.col("n"), F.lit(0)).cast("int")
    cycles = F.ceil(missing / m).cast("int")
    lead = F.slice(F.flatten(F.array_repeat(F.slice("ys", 1, m), cycles)), (cycles * m - missing + 1).cast("int"), missing)
    return packs.withColumn("ys", F.when((missing > 0) & (F.col("n") >= m), F.concat(lead, "ys")).otherwise(F.col("ys")))


def longest_run(obs: DataFrame, present: Column) -> DataFrame:
    """The longest run of rows where `present` holds, the earliest of equals."""
    runs = obs.withColumn("ok", present).withColumn("grp", F.col("t") - F.row_number().over(W.partitionBy("series_id", "ok").orderBy("t"))).where("ok")
    sizes = runs.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("series_id", "grp"))).withColumn("first", F.min("t").over(W.partitionBy("series_id", "grp")))
    best = F.max(F.struct("size", -F.col("first"))).over(by_series())
    return sizes.withColumn("best", best).where((F.col("size") == F.col("best.size")) & (F.col("first") == -F.col("best.col2"))).drop("ok", "grp", "best")


def trim_right(obs: DataFrame, present: Column) -> DataFrame:
    """Drops the rows after the last one where `present` holds."""
    return obs.withColumn("__last", F.max(F.when(present, F.col("t"))).over(by_series())).where(F.col("t") <= F.col("__last")).drop("__last")
