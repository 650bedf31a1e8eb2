"""Medoids of resampled copies by building and swapping, and forecasts of copies drawn from their clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..sources.files import written
from . import resampling as B
from .selection import GRIDS, _of, fit_kind

#: Swaps after which the search stops; it ends before, where no swap helps.
SWAPS = 100
FAR = 1e300


def _cost(d: Column, own: Column) -> Column:
    return F.round(F.aggregate(d, F.lit(0.0), lambda a, row: a + F.array_min(F.transform(own, lambda j: F.get(row, j)))), 9)


def pam(d: Column, k: Column) -> Column:
    """struct(cost, set): k medoids of a matrix of distances (Kaufman and Rousseeuw 1990), of equals those of least number.

    Members are added one by one where they lower the sum of distances most; then, while that helps, the best swap of a
    medoid with another member is made; a swap that changes nothing but leads to lesser numbers helps too.
    """
    all_of = F.sequence(F.lit(0), F.size(d) - 1)

    def add(s: Column, _: Column) -> Column:
        price = lambda j: F.round(F.aggregate(F.zip_with(s["near"], d, lambda n, row: F.least(n, F.get(row, j))), F.lit(0.0), lambda a, x: a + x), 9)
        best = F.array_min(F.transform(F.filter(all_of, lambda j: ~F.array_contains(s["set"], j)), lambda j: F.struct(price(j).alias("c"), j.alias("j"))))["j"]
        return R.let(best, lambda j: F.struct(F.concat(s["set"], F.array(j)).alias("set"), F.zip_with(s["near"], d, lambda n, row: F.least(n, F.get(row, j))).alias("near")))

    start = F.struct(F.array().cast("array<int>").alias("set"), F.array_repeat(F.lit(FAR), F.size(d)).alias("near"))
    built = F.aggregate(F.sequence(F.lit(1), k), start, add)["set"]

    def swap(s: Column, _: Column) -> Column:
        others = F.filter(all_of, lambda j: ~F.array_contains(s["set"], j))
        changed = lambda i, j: F.array_sort(F.transform(s["set"], lambda m, x: F.when(x == i, j).otherwise(m)))
        tried = F.flatten(F.transform(s["set"], lambda _, i: F.transform(others, lambda j: R.let(changed(i, j), lambda own: F.struct(_cost(d, own).alias("cost"), own.alias("set"))))))
        better = lambda b: F.when((b["cost"] < s["cost"]) | ((b["cost"] == s["cost"]) & (b["set"] < s["set"])), F.struct(b["cost"].alias("cost"), b["set"].alias("set"), F.lit(False).alias("done"))).otherwise(F.struct(s["cost"].alias("cost"), s["set"].alias("set"), F.lit(True).alias("done")))
        return F.when(s["done"], s).otherwise(R.let(F.array_min(tried), better))

    first = R.let(F.array_sort(built), lambda own: F.struct(_cost(d, own).alias("cost"), own.alias("set"), F.lit(False).alias("done")))
    return R.let(F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), first, swap), lambda s: F.struct(s["cost"].alias("cost"), s["set"].alias("set")))


def clustered(rows: DataFrame, most: int) -> DataFrame:
    """(series_id, k, width, own) for rows (series_id, copies): the number of clusters from 2 to `most` of largest silhouette, of
    equals the least, and the medoid of each copy."""
    held = written(rows.select("series_id", B.distances(F.col("copies")).alias("d")), "distances")
    held = held.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(most)))).where(F.col("k") < F.size("d"))
    held = written(held.withColumn("best", pam(F.col("d"), F.col("k"))), "medoids")
    held = written(held.withColumn("own", B.nearest(F.col("d"), F.col("best.set"))), "members")
    made = written(held.select("series_id", "k", "own", F.round(B.silhouette(F.col("d"), F.col("own")), 9).alias("width")), "silhouettes")
    first = F.row_number().over(W.partitionBy("series_id").orderBy(F.col("width").desc(), "k"))
    return made.withColumn("r", first).where("r = 1").drop("r")


def smoothed(rows: DataFrame, ys: str, h: Column) -> DataFrame:
    """rows with f: h forecasts of the smoothing model of least aicc, of level, trend and damped trend."""
    made = rows
    for kind in GRIDS:
        made = made.withColumn(f"__{kind}", fit_kind(F.col(ys), kind))
    made = written(made, "copies-smoothed")
    fits = [F.struct(F.round(F.coalesce(F.col(f"__{k}.aicc"), F.lit(float("inf"))), 6).alias("x"), F.lit(i).alias("i"), F.col(f"__{k}").alias("fit")) for i, k in enumerate(GRIDS)]
    f = R.let(F.array_min(F.array(*fits)), lambda b: _of(b["fit"], F.size(ys), h))["f"]
    return made.withColumn("f", f).drop(*[f"__{k}" for k in GRIDS])


def bagged_clusters(prepared: DataFrame, m: int, h: int, copies: int = 100, kept: int = 30, most: int = 6, members: int = 10) -> DataFrame:
    """(series_id, step, lower, mean, upper): least, middle and largest forecast of copies drawn from all clusters of good copies.

    Copies are resampled without season; those whose last two seasons are forecast best are kept and clustered, each
    cluster gives its share of `members`, at least one, the best first, and each of these is forecast as a whole.
    """
    base = written(prepared.select("series_id", "n", "des", "out", B.block_copies(F.col("des"), m, copies).alias("copies")), "copies")
    back = F.least(F.lit(2 * m if m > 1 else 10), F.floor((F.col("n") - 1) / 2)).cast("int")
    rows = base.select("series_id", "n", "des", F.posexplode("copies").alias("copy", "xs")).withColumn("back", back)
    tried = rows.select("series_id", "copy", "xs", "back", F.slice("des", (F.col("n") - F.col("back") + 1).cast("int"), F.col("back")).alias("real"), F.slice("xs", 1, (F.col("n") - F.col("back")).cast("int")).alias("first"))
    scored = smoothed(tried, "first", F.col("back"))
    error = R.mean_of(F.zip_with("real", "f", lambda y, f: F.abs(F.try_divide(y - f, y))))
    place = F.row_number().over(W.partitionBy("series_id").orderBy(F.round("error", 9).asc_nulls_last(), "copy"))
    good = written(scored.select("series_id", "copy", "xs", error.alias("error")).withColumn("place", place).where(F.col("place") <= kept), "good-copies")
    packs = good.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("place", "xs"))).alias("x"))  # no more than `kept`
    groups = clustered(packs.select("series_id", F.transform("x", lambda v: v["xs"]).alias("copies")), most)
    own = groups.select("series_id", F.posexplode("own").alias("i", "medoid"), F.size("own").alias("all")).withColumn("place", F.col("i") + 1)
    w = W.partitionBy("series_id", "medoid")
    share = F.greatest(F.round(F.count(F.lit(1)).over(w) / F.col("all") * members), F.lit(1))
    drawn = own.withColumn("share", share).withColumn("k", F.row_number().over(w.orderBy("place"))).where(F.col("k") <= F.col("share")).select("series_id", "place")
    fc = smoothed(good.join(drawn, ["series_id", "place"]).select("series_id", "xs"), "xs", F.lit(h))
    steps = fc.join(base.select("series_id", "out"), "series_id").select("series_id", F.posexplode(F.zip_with("f", "out", lambda a, b: a * b)).alias("i", "f"))
    return steps.groupBy("series_id", (F.col("i") + 1).alias("step")).agg(F.min("f").alias("lower"), F.median("f").alias("mean"), F.max("f").alias("upper"))
