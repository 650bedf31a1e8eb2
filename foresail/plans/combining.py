"""Queries on bounds, lookups, joins, ranks, grids, exports and recipes over forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import numeric
from ..operators.preparation import ordered
from ..registry import query
from ..sources import files
from ..sources.series import SPECS, obs_sql, packed, series, split
from .forecasting import UNITS, MAIN, benchmark, oracle

_B = "OVER (PARTITION BY series_id)"
#: Horizon and seasonal length by the letter that an id begins with.
PERIODS = {"Y": (6, 1), "Q": (8, 4), "M": (18, 12), "W": (13, 52), "D": (14, 7), "H": (48, 24)}


def bounded(fc: DataFrame, history: DataFrame) -> DataFrame:
    """Adds floored (no negative forecast), capped (more than 1000 times the largest value becomes that value) and
    guarded (floored where all history is positive) to forecasts, from (series_id, train)."""
    facts = history.select("series_id", F.array_max("train").alias("top"), F.forall("train", lambda y: y > 0).alias("positive"))
    f = F.col("mean")
    return fc.join(facts, "series_id").withColumns(
        {
            "floored": F.greatest(f, F.lit(0.0)),
            "capped": F.when(f > 1000 * F.col("top"), F.col("top")).otherwise(f),
            "guarded": F.when(F.col("positive"), F.greatest(f, F.lit(0.0))).otherwise(f),
        }
    )


@query(
    "prep_forecast_bounds",
    oracle(
        f""", hs AS (SELECT series_id, max(y) AS top, bool_and(y > 0) AS pos FROM tr GROUP BY 1), sh AS (SELECT f.*, f.f - 1 AS g FROM fc f WHERE f.model = 'ses')
SELECT s.series_id, CAST(s.step AS BIGINT) AS step, round(greatest(g, 0), 6) AS floored, round(CASE WHEN g > 1000 * top THEN top ELSE g END, 6) AS capped, round(CASE WHEN pos THEN greatest(g, 0) ELSE g END, 6) AS guarded FROM sh s JOIN hs h ON h.series_id = s.series_id"""
    ),
)
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    lower = fc.where("model = 'ses'").withColumn("mean", F.col("mean") - 1)
    return bounded(lower, prepared).select("series_id", "step", *[r6(c).alias(c) for c in ("floored", "capped", "guarded")])


def horizon_of(series_id: Column) -> Column:
    """The horizon by the first letter of an id; an unknown letter raises an error."""
    table = F.create_map(*[F.lit(x) for k, v in PERIODS.items() for x in (k, v[0])])
    found = F.try_element_at(table, F.substring(series_id, 1, 1))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no horizon for "), series_id)).cast("int")).otherwise(found)


@query("prep_horizon_lookup", "SELECT substr('YQMWDH', 1 + n_nationkey % 6, 1) || n_nationkey AS series_id, CAST([6, 8, 18, 13, 14, 48][1 + n_nationkey % 6] AS BIGINT) AS h FROM nation")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.substring(F.lit("YQMWDH"), (1 + F.col("n_nationkey") % 6).cast("int"), F.lit(1)), F.col("n_nationkey").cast("string")).alias("series_id"))
    return ids.select("series_id", horizon_of(F.col("series_id")).cast("long").alias("h"))


_RANGES = (("Y", 0, 23000), ("Q", 23000, 47000), ("M", 47000, 95000), ("W", 95000, 95359), ("D", 95359, 99586), ("H", 99586, 100000))


@query(
    "prep_id_range_dispatch",
    "WITH g AS (SELECT o_orderkey * 7 % 100000 AS i FROM orders) SELECT i AS global_index, " + "CASE " + " ".join(f"WHEN i < {b} THEN '{k}' || (i - {a} + 1)" for k, a, b in _RANGES) + " END AS series_id FROM g",
)
def _(spark, d):
    i = F.col("global_index")
    named = None
    for k, a, b in _RANGES:
        name = F.concat(F.lit(k), (i - a + 1).cast("string"))
        named = F.when(i < b, name) if named is None else named.when(i < b, name)
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey").cast("long") * 7 % 100000).alias("global_index")).withColumn("series_id", named)


@query("join_positional_zip", oracle("SELECT a.series_id, CAST(a.step AS BIGINT) AS step, round(a.f, 6) AS ses, round(b.f, 6) AS theta FROM fc a JOIN fc b ON a.series_id = b.series_id AND a.step = b.step WHERE a.model = 'ses' AND b.model = 'theta'"))
def _(spark, d):
    fc, _ = benchmark(spark, d, models=("ses", "theta"))
    wide = fc.groupBy("series_id", "step").pivot("model", ["ses", "theta"]).agg(F.max("mean"))
    return wide.select("series_id", "step", r6("ses").alias("ses"), r6("theta").alias("theta"))


@query("eval_reproduction_diff", oracle("SELECT a.series_id, CAST(a.step AS BIGINT) AS step, round(abs(a.f - b.f), 6) AS difference, round(100 * abs(a.f - b.f) / nullif(b.f, 0), 6) AS percent FROM fc a JOIN fc b ON a.series_id = b.series_id AND a.step = b.step WHERE a.model = 'naive' AND b.model = 'snaive' AND abs(a.f - b.f) > 0.000001"))
def _(spark, d):
    fc, _ = benchmark(spark, d, models=("naive", "snaive"))
    wide = fc.groupBy("series_id", "step").pivot("model", ["naive", "snaive"]).agg(F.max("mean"))
    gap = F.abs(F.col("naive") - F.col("snaive"))
    return wide.where(gap > 1e-6).select("series_id", "step", r6(gap).alias("difference"), r6(F.try_divide(100 * gap, F.col("snaive"))).alias("percent"))


@query("join_reindex_template", oracle("SELECT t.series_id, round(f.f, 6) AS first_step FROM (SELECT DISTINCT c_mktsegment AS series_id FROM customer UNION ALL SELECT 'ABSENT') t LEFT JOIN fc f ON f.series_id = t.series_id AND f.model = 'theta' AND f.step = 1"))
def _(spark, d):
    fc, _ = benchmark(spark, d)
    template = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("series_id")).distinct().unionByName(spark.createDataFrame([("ABSENT",)], "series_id string"))
    return fc.where("model = 'theta' and step = 1").join(template, "series_id", "right").select("series_id", r6("mean").alias("first_step"))


@query("agg_na_tolerance", oracle("SELECT model, CASE WHEN 2 * count(*) FILTER (WHERE mase > 1) <= count(*) THEN round(avg(CASE WHEN mase <= 1 THEN mase END), 6) END AS score FROM er GROUP BY 1"))
def _(spark, d):
    """The mean of scores, where those over 1 count as failed folds; null if more than half failed."""
    fc, prepared = benchmark(spark, d)
    failed = F.col("mase") > 1
    kept = F.avg(F.when(~failed, F.col("mase")))
    return E.scores(fc, prepared, 12).groupBy("model").agg(F.when(2 * F.count_if(failed) <= F.count(F.lit(1)), r6(kept)).alias("score"))


@query("agg_finite_mean", oracle("SELECT model, round(avg(ln(nullif(mse, 0))), 6) AS mean_log_mse FROM er GROUP BY 1"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    return E.scores(fc, prepared, 12).groupBy("model").agg(r6(F.avg(F.ln(F.nullif("mse", F.lit(0.0))))).alias("mean_log_mse"))


@query("rank_average_ties", oracle(", k AS (SELECT series_id, model, rank() OVER (PARTITION BY series_id ORDER BY round(smape, 6)) + (count(*) OVER (PARTITION BY series_id, round(smape, 6)) - 1) / 2.0 AS place FROM er) SELECT series_id, model, round(CAST(place AS DOUBLE), 6) AS place FROM k WHERE place < 6"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).withColumn("v", F.round("smape", 6))
    place = F.rank().over(W.partitionBy("series_id").orderBy("v")) + (F.count(F.lit(1)).over(W.partitionBy("series_id", "v")) - 1) / 2
    return s.withColumn("place", place).where("place < 6").select("series_id", "model", r6("place").alias("place"))


@query("stratified_topk", oracle(", s AS (SELECT *, CASE WHEN model IN ('naive', 'snaive', 'naive2') THEN 'naive' ELSE 'smooth' END AS stratum FROM er), z AS (SELECT *, row_number() OVER (PARTITION BY series_id, stratum ORDER BY smape, model) AS k, count(*) OVER (PARTITION BY series_id, stratum) AS n FROM s) SELECT series_id, stratum, model FROM z WHERE k <= greatest(1, round(n / 8.0 * 4))"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).withColumn("stratum", F.when(F.col("model").isin("naive", "snaive", "naive2"), "naive").otherwise("smooth"))
    w = W.partitionBy("series_id", "stratum")
    ranked = s.withColumn("k", F.row_number().over(w.orderBy("smape", "model"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("k") <= F.greatest(F.lit(1.0), F.round(F.col("n") / 8 * 4))).select("series_id", "stratum", "model")


@query("topk_five_configs_nd", oracle(", z AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mse, model) AS a, row_number() OVER (PARTITION BY series_id ORDER BY (smape + mase) / 2, model) AS b FROM er) SELECT series_id, 'nmse' AS rule, model FROM z WHERE a <= 5 UNION ALL SELECT series_id, 'both', model FROM z WHERE b <= 5"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).withColumn("both", (F.col("smape") + F.col("mase")) / 2)
    parts = [E.best_models(s, 5, c).select("series_id", F.lit(n).alias("rule"), "model") for c, n in (("mse", "nmse"), ("both", "both"))]
    return parts[0].unionByName(parts[1])


@query("set_grid_cross", "SELECT CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q FROM (SELECT unnest(range(1, 11)) AS p), (SELECT unnest(range(1, 11)) AS q)")
def _(spark, d):
    one = spark.range(1, 11).withColumnRenamed("id", "p")
    return one.select("p", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("q"))


@query("set_difference", f"WITH {obs_sql(MAIN)}, a AS (SELECT series_id, list(DISTINCT (t - 1) % 12) AS p FROM obs WHERE t <= 12 GROUP BY 1), g AS (SELECT series_id, p, unnest(p) AS own FROM a) SELECT series_id, CAST(own AS BIGINT) AS phase, CAST(len(p) - 1 AS BIGINT) AS others FROM g")
def _(spark, d):
    phases = series(spark, d, MAIN).where("t <= 12").groupBy("series_id").agg(F.collect_set((F.col("t") - 1) % 12).alias("p"))
    rows = phases.select("series_id", "p", F.explode("p").alias("phase"))
    return rows.select("series_id", "phase", F.size(F.array_except("p", F.array("phase"))).cast("long").alias("others"))


@query("reshape_unpivot", oracle("SELECT series_id, model, metric, round(value, 6) AS value FROM (SELECT series_id, model, smape, mase, mape FROM er) UNPIVOT (value FOR metric IN (smape, mase, mape))"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).select("series_id", "model", "smape", "mase", "mape")
    return s.unpivot(["series_id", "model"], ["smape", "mase", "mape"], "metric", "value").where("value is not null").select("series_id", "model", "metric", r6("value").alias("value"))


@query("win_row_offset_from_end", f"WITH {obs_sql(MAIN)} SELECT series_id, round(avg(y), 6) AS mean FROM (SELECT *, count(*) {_B} AS n FROM obs) WHERE t >= n - 18 GROUP BY 1")
def _(spark, d):
    return packed(series(spark, d, MAIN)).select("series_id", r6(F.get(M.mean_last(F.col("ys"), 19, 1), F.lit(0))).alias("mean"))


@query(
    "ble_seasonal",
    f"WITH {obs_sql('Q_nation')}, al AS (SELECT *, count(*) {_B} AS n FROM obs), ph AS (SELECT series_id, y, n, (n - t) % 4 AS back, CAST(floor((n - t) / 4) AS BIGINT) AS cycle FROM al), la AS (SELECT series_id, back, y AS last FROM ph WHERE cycle = 0), "
    "sl AS (SELECT p.series_id, p.back, max(l.last) AS last, median((l.last - p.y) / p.cycle) AS slope FROM ph p JOIN la l ON l.series_id = p.series_id AND l.back = p.back WHERE p.cycle > 0 GROUP BY 1, 2) "
    "SELECT series_id, CAST(4 * c - back AS BIGINT) AS step, round(last + c * slope, 6) AS mean FROM sl, (SELECT unnest([1, 2]) AS c)",
)
def _(spark, d):
    """Bunch lines of each phase, two cycles ahead."""
    obs = series(spark, d, "Q_nation").withColumn("back", (F.max("t").over(W.partitionBy("series_id")) - F.col("t")) % 4)
    phase = obs.groupBy("series_id", "back").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p"))
    made = phase.select("series_id", "back", F.posexplode(M.bunch_line(F.transform("p", lambda x: x["y"]), 2)).alias("c", "mean"))
    return made.select("series_id", (4 * (F.col("c") + 1) - F.col("back")).cast("long").alias("step"), r6("mean").alias("mean"))


@query("select_mase_gate", oracle("SELECT f.series_id, CAST(f.step AS BIGINT) AS step, round(avg(f.f), 6) AS mean FROM fc f JOIN er e ON e.series_id = f.series_id AND e.model = f.model WHERE f.model <> 'holt' OR coalesce(e.mase, 999) < 2 GROUP BY 1, 2"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).select("series_id", "model", "mase")
    kept = fc.join(s, ["series_id", "model"]).where((F.col("model") != "holt") | (F.coalesce("mase", F.lit(999.0)) < 2))
    return E.combine(kept).select("series_id", "step", r6("mean").alias("mean"))


@query("snk_three_files", oracle(UNITS + " SELECT f.series_id, CAST(f.step AS BIGINT) AS step, kind, round(CASE kind WHEN 'lower' THEN min(f.f * unit) WHEN 'point' THEN median(f.f * unit) ELSE max(f.f * unit) END, 4) AS value FROM fc f JOIN un u ON u.series_id = f.series_id, (VALUES ('lower'), ('point'), ('upper')) v(kind) GROUP BY 1, 2, 3"))
def _(spark, d):
    """Bounds and points in the unit of the facts, a folder each."""
    fc, _ = benchmark(spark, d)
    path = files.scratch(spark, "three-files")
    fc = fc.withColumn("mean", F.col("mean") * F.col("unit"))
    bounds = fc.groupBy("series_id", "step").agg(F.min("mean").alias("lower"), F.median("mean").alias("point"), F.max("mean").alias("upper"))
    long = bounds.unpivot(["series_id", "step"], ["lower", "point", "upper"], "kind", "value")
    long.select("series_id", "step", "kind", F.round("value", 4).alias("value")).write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).select("series_id", "step", "kind", "value")


@query("snk_fc_long_export", f"WITH {obs_sql(MAIN)} SELECT series_id, year(ds) AS hist_year, month(ds) AS hist_period, CAST(12 AS BIGINT) AS ppy, round(value, 4) AS hist_value, 'segment' AS category FROM obs")
def _(spark, d):
    obs = series(spark, d, MAIN)
    path = files.scratch(spark, "long-export")
    long = obs.select("series_id", F.year("ds").cast("long").alias("hist_year"), F.month("ds").cast("long").alias("hist_period"), F.lit(12).cast("long").alias("ppy"), F.round("value", 4).alias("hist_value"), F.lit("segment").alias("category"))
    long.write.option("header", True).csv(path)
    return spark.read.schema(long.schema).option("header", True).csv(path)


@query("cv_rolling_abs_error", f"WITH {obs_sql(MAIN)}, o AS (SELECT *, count(*) {_B} AS n, lag(y, 4) OVER (PARTITION BY series_id ORDER BY t) AS n4, lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS s4 FROM obs) SELECT series_id, round(avg(abs(y - n4)), 6) AS naive, round(avg(abs(y - s4)), 6) AS snaive, round(sqrt(avg((y - n4) * (y - n4))), 6) AS naive_rms FROM o WHERE t > n - 18 GROUP BY 1")
def _(spark, d):
    """Errors at lead 4 over the last 18 origins: no fold is copied, as both methods look back a fixed way."""
    obs = series(spark, d, MAIN).withColumn("n", F.max("t").over(W.partitionBy("series_id"))).withColumn("n4", F.lag("y", 4).over(ordered())).withColumn("s4", F.lag("y", 12).over(ordered()))
    gap = F.col("y") - F.col("n4")
    return obs.where("t > n - 18").groupBy("series_id").agg(r6(F.avg(F.abs(gap))).alias("naive"), r6(F.avg(F.abs(F.col("y") - F.col("s4")))).alias("snaive"), r6(F.sqrt(F.avg(gap * gap))).alias("naive_rms"))


#: Members of the recipes whose models are here, and how they are combined.
RECIPES = {
    "rec_median_of_four": (("ets_auto", "ar", "theta_optimised", "ses_optimised"), "median"),
    "rec_mean_of_hierarchy_and_theta": (("temporal_hierarchy", "theta_optimised"), "mean"),
    "rec_trimmed_ensemble": (("ets_auto", "ar", "theta_optimised", "stl_ets", "temporal_hierarchy", "ses_optimised"), "trimmed"),
    "rec_bagged": (("bagged_theta",), "median"),
}

for _key, (_members, _how) in RECIPES.items():

    @query(_key)
    def _(spark, d, members=_members, how=_how):
        s = SPECS[MAIN]
        made = numeric.fit_each(split(packed(series(spark, d, MAIN)), s.h), list(members), s.m, s.h)
        failed = made.where("status <> 'ok'").groupBy("series_id", "step").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "model", "status"))), ", ").alias("status"))
        joined = E.combine(made, how).join(failed, ["series_id", "step"], "left")
        return joined.select("series_id", "step", r6(F.greatest("mean", F.lit(0.0))).alias("mean"), F.coalesce("status", F.lit("ok")).alias("status"))
