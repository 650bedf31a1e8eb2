"""Scores, selection and combination over forecasts (series_id, model, step, mean, actual)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M


def scores(fc: DataFrame, prepared: DataFrame, m: int) -> DataFrame:
    """(series_id, model, smape, mase, mape, mse): means over the steps of each series and model.

    Forecasts that carry their series' scale are not joined to anything.
    """
    joined = fc
    if "scale" not in fc.columns:
        joined = fc.join(prepared.select("series_id", M.seasonal_scale(F.col("train"), m).alias("scale")), "series_id")
    return joined.groupBy("series_id", "model").agg(
        F.avg(M.smape(F.col("actual"), F.col("mean"))).alias("smape"),
        F.avg(F.try_divide(F.abs(F.col("actual") - F.col("mean")), F.nullif("scale", F.lit(0.0)))).alias("mase"),
        F.avg(M.absolute_percentage(F.col("actual"), F.col("mean"))).alias("mape"),
        F.avg((F.col("actual") - F.col("mean")) * (F.col("actual") - F.col("mean"))).alias("mse"),
    )


def overall(per_series: DataFrame, reference: str = "naive2") -> DataFrame:
    """(model, smape, mase, owa): means over series, and the overall weighted average against the reference model."""
    means = per_series.groupBy("model").agg(F.avg("smape").alias("smape"), F.avg("mase").alias("mase"))
    table = means.agg(F.collect_list(F.struct("model", "smape", "mase")).alias("t"))  # as long as there are models
    base = F.get(F.filter("t", lambda x: x["model"] == reference), F.lit(0))
    rows = table.select(F.explode("t").alias("x"), base.alias("b")).where("b is not null")
    score = M.owa(F.col("x.smape"), F.col("x.mase"), F.col("b.smape"), F.col("b.mase"))
    return rows.select("x.model", "x.smape", "x.mase", score.alias("owa"))


def best_models(per_series: DataFrame, k: int, by: str = "smape") -> DataFrame:
    """The k models of each series with the least score; ties by name."""
    w = W.partitionBy("series_id").orderBy(F.col(by).asc_nulls_last(), "model")
    return per_series.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def combine(fc: DataFrame, how: str = "mean", trim: float = 0.2) -> DataFrame:
    """(series_id, step, mean) over models: mean, median, or the mean without floor(trim * k) values at each end."""
    if how == "mean":
        value = F.avg("mean")
    elif how == "median":
        value = F.median("mean")
    else:
        s = F.array_sort(F.collect_list("mean"))  # as long as there are models
        cut = F.floor(F.size(s) * trim).cast("int")
        kept = F.slice(s, cut + 1, F.size(s) - 2 * cut)
        value = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)
    return fc.groupBy("series_id", "step").agg(value.alias("mean"))


def aicc_weights(criteria: DataFrame) -> DataFrame:
    """Adds weight: exp(-delta / 2) of each model's criterion, summing to one for each series."""
    w = W.partitionBy("series_id")
    raw = F.exp((F.min("aicc").over(w) - F.col("aicc")) / 2)
    return criteria.withColumn("__w", raw).withColumn("weight", F.col("__w") / F.sum("__w").over(w)).drop("__w")
