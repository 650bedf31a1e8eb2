"""Queries on forecasts, scores, selection, combination and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6, seasonal_scale, smape
from ..operators import evaluation as E
from ..operators import models as M
from ..registry import query
from ..sources import files
from ..sources.series import SPECS, obs_sql, packed, series, split

MAIN = "M_segment"
#: Relative errors are counted at this many digits, of which there is a bounded number, before their quantiles are taken.
QUANTILE_DIGITS = 4
_B = "OVER (PARTITION BY series_id)"


def _frame(m: int, h: int, test: bool = True) -> str:
    """Common table expressions that prepare series for the models: des, idx (step, ix), te (step, y) and lens."""
    k = m // 2
    w = lambda a, b: f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
    ma = f"avg(y) {w(k, k)}" if m % 2 else f"(sum(y) {w(k, k - 1)} + sum(y) {w(k - 1, k)}) / {2 * m}"
    seasonal = f"s.n >= {3 * m} AND floor(10 * log10(s.n)) >= {m} AND abs(s.rm) > 1.645 * sqrt((1 + 2 * s.s) / s.n)" if test else "true"
    return f""",
al AS (SELECT *, count(*) {_B} AS big FROM obs), tr AS (SELECT series_id, t, y, big - {h} AS n FROM al WHERE t <= big - {h}), te AS (SELECT series_id, t - (big - {h}) AS step, y FROM al WHERE t > big - {h}),
dv AS (SELECT series_id, t, n, y - avg(y) {_B} AS e FROM tr), vv AS (SELECT series_id, sum(e * e) AS s FROM dv GROUP BY 1),
rr AS (SELECT a.series_id, b.t - a.t AS lag, max(a.n) AS n, sum(a.e * b.e) / max(vv.s) AS r FROM dv a JOIN dv b ON a.series_id = b.series_id AND b.t > a.t AND b.t <= a.t + {m} JOIN vv ON vv.series_id = a.series_id GROUP BY 1, 2),
ss AS (SELECT series_id, max(n) AS n, max(CASE WHEN lag = {m} THEN r END) AS rm, coalesce(sum(CASE WHEN lag < {m} THEN r * r END), 0) AS s FROM rr GROUP BY 1),
sf AS (SELECT s.series_id, s.n, coalesce({seasonal}, false) AS seasonal FROM ss s),
ma AS (SELECT *, CASE WHEN t > {k} AND t <= n - {k} THEN {ma} END AS trend FROM tr), ph AS (SELECT series_id, (t - 1) % {m} AS phase, avg(y / nullif(trend, 0)) AS p FROM ma GROUP BY 1, 2),
ix0 AS (SELECT series_id, phase, p / avg(p) {_B} AS ix FROM ph), ix AS (SELECT i.series_id, i.phase, CASE WHEN f.seasonal THEN i.ix ELSE 1.0 END AS ix FROM ix0 i JOIN sf f ON f.series_id = i.series_id),
des AS (SELECT a.series_id, a.t, a.n, a.y AS raw, a.y / i.ix AS y FROM tr a JOIN ix i ON i.series_id = a.series_id AND i.phase = (a.t - 1) % {m}),
steps AS (SELECT unnest(range(1, {h + 1})) AS step),
oi AS (SELECT f.series_id, s.step, f.n, i.ix FROM sf f, steps s JOIN ix i ON i.series_id = f.series_id AND i.phase = (f.n + s.step - 1) % {m}),
pk AS (SELECT series_id, max(n) AS n, list(y ORDER BY t) AS ys, list(raw ORDER BY t) AS raws, regr_slope(y, t) AS b1, regr_intercept(y, t) AS b0 FROM des GROUP BY 1),
line2 AS (SELECT d.series_id, list(2 * d.y - (p.b0 + p.b1 * d.t) ORDER BY d.t) AS ys FROM des d JOIN pk p ON p.series_id = d.series_id GROUP BY 1),
ho(series_id, t, phi, l, b) AS (SELECT d.series_id, d.t, v.phi, d.y, e.y - d.y FROM des d JOIN des e ON e.series_id = d.series_id AND e.t = 2, (VALUES (1.0::DOUBLE), (0.9::DOUBLE)) v(phi) WHERE d.t = 1
  UNION ALL SELECT o.series_id, d.t, o.phi, 0.3 * d.y + 0.7 * (o.l + o.phi * o.b), 0.1 * (0.3 * d.y + 0.7 * (o.l + o.phi * o.b) - o.l) + 0.9 * o.phi * o.b FROM ho o JOIN des d ON d.series_id = o.series_id AND d.t = o.t + 1),
hl AS (SELECT o.* FROM ho o JOIN pk p ON p.series_id = o.series_id AND p.n = o.t),
lv AS (SELECT p.series_id, p.n, p.b0, p.b1, p.raws, p.ys, list_reduce(p.ys, lambda a, x: 0.3 * x + 0.7 * a) AS l1, list_reduce(q.ys, lambda a, x: 0.3 * x + 0.7 * a) AS l2, h1.l AS hl, h1.b AS hb, h2.l AS dl, h2.b AS db
  FROM pk p JOIN line2 q ON q.series_id = p.series_id JOIN hl h1 ON h1.series_id = p.series_id AND h1.phi = 1.0 JOIN hl h2 ON h2.series_id = p.series_id AND h2.phi = 0.9),
fc AS (SELECT l.series_id, o.step, m.model, CASE m.model WHEN 'naive' THEN raws[n] WHEN 'snaive' THEN raws[n - {m} + 1 + (o.step - 1) % {m}] WHEN 'naive2' THEN ys[n] * o.ix WHEN 'ses' THEN l1 * o.ix
  WHEN 'holt' THEN (hl + hb * o.step) * o.ix WHEN 'damped' THEN (dl + db * 0.9 * (1 - pow(0.9, o.step)) / 0.1) * o.ix WHEN 'theta' THEN greatest(l2 / 2 + (b0 + b1 * (n + o.step)) / 2, 0) * o.ix
  ELSE (l1 + hl + hb * o.step + dl + db * 0.9 * (1 - pow(0.9, o.step)) / 0.1) / 3 * o.ix END AS f
  FROM (SELECT l.* FROM lv l) l JOIN (SELECT series_id, step, ix FROM oi) o ON o.series_id = l.series_id, (VALUES ('naive'), ('snaive'), ('naive2'), ('ses'), ('holt'), ('damped'), ('theta'), ('comb')) m(model)),
sc AS (SELECT series_id, avg(CASE WHEN t > {m} THEN abs(y - before) END) AS scale FROM (SELECT *, lag(y, {m}) OVER (PARTITION BY series_id ORDER BY t) AS before FROM tr) GROUP BY 1),
er AS (SELECT f.series_id, f.model, avg(200 * abs(e.y - f.f) / nullif(abs(e.y) + abs(f.f), 0)) AS smape, avg(abs(e.y - f.f) / nullif(s.scale, 0)) AS mase, avg(100 * abs(e.y - f.f) / nullif(abs(e.y), 0)) AS mape, avg((e.y - f.f) * (e.y - f.f)) AS mse
  FROM fc f JOIN te e ON e.series_id = f.series_id AND e.step = f.step JOIN sc s ON s.series_id = f.series_id GROUP BY 1, 2)"""


def oracle(text: str, name: str = MAIN) -> str:
    s = SPECS[name]
    return f"WITH RECURSIVE {obs_sql(name)}{_frame(s.m, s.h)}\n{text}"


def benchmark(spark, sf_dir: str, name: str = MAIN, models: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(forecasts, prepared) of the eight benchmark methods, or of those named, on a named collection."""
    s = SPECS[name]
    prepared = M.prepare(series(spark, sf_dir, name), s.m, s.h).withColumn("scale", seasonal_scale(F.col("train"), s.m))
    found = M.benchmark_models(s.m, s.h)
    return M.forecasts(prepared, {k: v for k, v in found.items() if models is None or k in models}), prepared


for _model in ("naive", "snaive", "naive2", "ses", "holt", "damped", "theta", "comb"):
    _id = {"damped": "holt_damped", "theta": "theta_classic"}.get(_model, _model)

    @query(_id, oracle(f"SELECT series_id, CAST(step AS BIGINT) AS step, round(f, 6) AS mean FROM fc WHERE model = '{_model}'"))
    def _(spark, d, model=_model):
        s = SPECS[MAIN]
        prepared = M.prepare(series(spark, d, MAIN), s.m, s.h)
        return M.forecasts(prepared, {model: M.benchmark_models(s.m, s.h)[model]}).select("series_id", "step", r6("mean").alias("mean"))


for _fixture in ("M_segment", "M_nation", "M_brand", "Q_nation", "D_event"):

    @query(f"benchmarks_all_{_fixture.lower()}", oracle("SELECT series_id, model, CAST(step AS BIGINT) AS step, round(f, 6) AS mean FROM fc", _fixture))
    def _(spark, d, name=_fixture):
        return benchmark(spark, d, name)[0].select("series_id", "model", "step", r6("mean").alias("mean"))


_OWA = """, mm AS (SELECT model, avg(smape) AS smape, avg(mase) AS mase FROM er GROUP BY 1)
SELECT m.model, round(m.smape, 6) AS smape, round(m.mase, 6) AS mase, round((m.smape / z.smape + m.mase / z.mase) / 2, 6) AS owa FROM mm m, mm z WHERE z.model = 'naive2'"""

for _key, _fixture in (("owa", "M_segment"), ("owa_m_nation", "M_nation"), ("owa_m_brand", "M_brand"), ("owa_q_nation", "Q_nation"), ("owa_d_event", "D_event"), ("owa_h_event", "H_event")):

    @query(_key, oracle(_OWA, _fixture))
    def _(spark, d, name=_fixture):
        fc, prepared = benchmark(spark, d, name)
        return E.overall(E.scores(fc, prepared, SPECS[name].m)).select("model", r6("smape").alias("smape"), r6("mase").alias("mase"), r6("owa").alias("owa"))


@query("smape_200", oracle("SELECT series_id, model, round(smape, 6) AS smape FROM er"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    return E.scores(fc, prepared, 12).select("series_id", "model", r6("smape").alias("smape"))


@query("smape_2", oracle("SELECT series_id, model, round(smape / 100, 6) AS smape FROM er"))
def _(spark, d):
    fc, _ = benchmark(spark, d)
    return fc.groupBy("series_id", "model").agg(r6(F.avg(smape(F.col("actual"), F.col("mean"), 2.0))).alias("smape"))


@query("mase", oracle("SELECT series_id, model, round(mase, 6) AS mase FROM er"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    return E.scores(fc, prepared, 12).select("series_id", "model", r6("mase").alias("mase"))


@query("mape_sum", oracle("SELECT series_id, model, round(mape, 6) AS mape, round(mse, 6) AS mse FROM er"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    return E.scores(fc, prepared, 12).select("series_id", "model", r6("mape").alias("mape"), r6("mse").alias("mse"))


@query("cmase", oracle("SELECT f.series_id, f.model, round(avg(abs(e.y - f.f)) / (max(s.scale) + 0.0001), 6) AS cmase FROM fc f JOIN te e ON e.series_id = f.series_id AND e.step = f.step JOIN sc s ON s.series_id = f.series_id GROUP BY 1, 2"))
def _(spark, d):
    fc, _ = benchmark(spark, d)
    return fc.groupBy("series_id", "model").agg(r6(F.avg(F.abs(F.col("actual") - F.col("mean"))) / (F.max("scale") + 1e-4)).alias("cmase"))


@query("nmse_vs_naive", oracle("SELECT a.series_id, a.model, round(a.mse / (0.0001 + b.mse), 6) AS nmse FROM er a JOIN er b ON b.series_id = a.series_id AND b.model = 'naive'"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).withColumn("base", F.max(F.when(F.col("model") == "naive", F.col("mse"))).over(W.partitionBy("series_id")))
    return s.select("series_id", "model", r6(F.col("mse") / (1e-4 + F.col("base"))).alias("nmse"))


@query("argmin_model", oracle("SELECT series_id, min_by(model, smape) AS model, round(min(smape), 6) AS smape FROM er GROUP BY 1"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    return E.best_models(E.scores(fc, prepared, 12), 1).select("series_id", "model", r6("smape").alias("smape"))


_TOP3 = ", top AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY smape, model) AS k FROM er)"


@query("topk_three_models", oracle(_TOP3 + " SELECT f.series_id, CAST(f.step AS BIGINT) AS step, round(avg(f.f), 6) AS mean FROM fc f JOIN top t ON t.series_id = f.series_id AND t.model = f.model AND t.k <= 3 GROUP BY 1, 2"))
def _(spark, d):
    fc, prepared = benchmark(spark, d)
    chosen = E.best_models(E.scores(fc, prepared, 12), 3).select("series_id", "model")
    return E.combine(fc.join(chosen, ["series_id", "model"])).select("series_id", "step", r6("mean").alias("mean"))


for _how, _sql in (("mean", "avg(f)"), ("median", "median(f)"), ("trimmed", "(sum(f) - max(f) - min(f)) / 6")):

    @query({"mean": "agg_mean_models", "median": "agg_median_models", "trimmed": "agg_trimmed_mean"}[_how], oracle(f"SELECT series_id, CAST(step AS BIGINT) AS step, round({_sql}, 6) AS mean FROM fc GROUP BY 1, 2"))
    def _(spark, d, how=_how):
        return E.combine(benchmark(spark, d)[0], how).select("series_id", "step", r6("mean").alias("mean"))


@query(
    "agg_grouping_sets",
    "SELECT period, series_id, model, round(avg(smape), 6) AS smape, count(*) AS n FROM (SELECT 'M' AS period, * FROM ("
    + oracle("SELECT series_id, model, smape FROM er")
    + ") UNION ALL SELECT 'D', * FROM ("
    + oracle("SELECT series_id, model, smape FROM er", "D_event")
    + ")) GROUP BY GROUPING SETS ((period, model), (series_id, model), (model))",
)
def _(spark, d):
    parts = []
    for name in ("M_segment", "D_event"):
        fc, prepared = benchmark(spark, d, name)
        parts.append(E.scores(fc, prepared, SPECS[name].m).select(F.lit(SPECS[name].letter).alias("period"), "series_id", "model", "smape"))
    both = parts[0].unionByName(parts[1])
    p, s, m = F.col("period"), F.col("series_id"), F.col("model")
    return both.groupingSets([[p, m], [s, m], [m]], p, s, m).agg(r6(F.avg("smape")).alias("smape"), F.count(F.lit(1)).alias("n"))


#: Common table expressions un: (series_id, unit), that forecasts are multiplied by before they leave.
UNITS = ", un AS (SELECT series_id, max(unit) AS unit FROM obs GROUP BY 1)"


@query("snk_submission_wide", oracle(UNITS + " SELECT f.series_id AS id" + "".join(f", round(max(CASE WHEN step = {k} THEN f * unit END), 4) AS F{k}" for k in range(1, 49)) + " FROM fc f JOIN un u ON u.series_id = f.series_id WHERE model = 'theta' GROUP BY 1"))
def _(spark, d):
    """A CSV of id, F1 .. F48 is written in the unit of the facts, NA beyond the horizon, and read back."""
    fc, _ = benchmark(spark, d, models=("theta",))
    path = files.scratch(spark, "submission")
    rows = fc.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("step", F.round(F.col("mean") * F.col("unit"), 4).alias("f")))).alias("at"))  # as long as the horizon
    names = [f"F{k}" for k in range(1, 49)]
    wide = rows.select(F.col("series_id").alias("id"), *[F.try_element_at("at", F.lit(k).cast("long")).alias(n) for k, n in enumerate(names, 1)])
    wide.write.option("header", True).option("nullValue", "NA").csv(path)
    return spark.read.schema("id string, " + ", ".join(f"{n} double" for n in names)).option("header", True).option("nullValue", "NA").csv(path)


_GRID = [round(0.05 * k, 2) for k in range(1, 20)]


@query(
    "ses_grid",
    oracle(
        f""", gr AS (SELECT unnest({_GRID}) AS alpha), rc(series_id, alpha, t, l, sse) AS (SELECT d.series_id, g.alpha, d.t, d.y, 0.0::DOUBLE FROM des d, gr g WHERE d.t = 1
UNION ALL SELECT r.series_id, r.alpha, d.t, r.alpha * d.y + (1 - r.alpha) * r.l, r.sse + (d.y - r.l) * (d.y - r.l) FROM rc r JOIN des d ON d.series_id = r.series_id AND d.t = r.t + 1),
fin AS (SELECT r.* FROM rc r JOIN pk p ON p.series_id = r.series_id AND p.n = r.t), bs AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(sse, 9), alpha) AS k FROM fin)
SELECT series_id, CAST(alpha AS DOUBLE) AS alpha, round(sse, 6) AS sse, round(l, 6) AS level FROM bs WHERE k = 1"""
    ),
)
def _(spark, d):
    grid = F.array(*map(F.lit, _GRID))
    fits = F.transform(grid, lambda a: F.struct(F.round(R.ses_error(F.col("des"), a), 9).alias("key"), a.alias("alpha")))
    best = M.prepare(series(spark, d, MAIN), 12, 18).withColumn("alpha", F.array_min(fits)["alpha"])
    return best.select("series_id", "alpha", r6(R.ses_error(F.col("des"), F.col("alpha"))).alias("sse"), r6(R.ses_level(F.col("des"), F.col("alpha"))).alias("level"))


@query("mean_last_window", oracle("SELECT p.series_id, CAST(s.step AS BIGINT) AS step, round(list_avg(p.raws[p.n - 17:p.n]), 6) AS mean FROM pk p, steps s"))
def _(spark, d):
    made = split(packed(series(spark, d, MAIN)), 18)
    return M.forecasts(made, {"mean_last": M.mean_last(F.col("train"), 18, 18)}).select("series_id", "step", r6("mean").alias("mean"))


@query(
    "ble",
    f"WITH {obs_sql('D_event')}, al AS (SELECT *, count(*) {_B} AS big FROM obs), tr AS (SELECT series_id, t, y, big - 7 AS n FROM al WHERE t <= big - 7), la AS (SELECT series_id, y AS last, n FROM tr WHERE t = n), "
    "sl AS (SELECT a.series_id, max(l.last) AS last, median((l.last - a.y) / (a.n - a.t)) AS slope FROM tr a JOIN la l ON l.series_id = a.series_id WHERE a.t < a.n GROUP BY 1) "
    "SELECT series_id, CAST(step AS BIGINT) AS step, round(last + step * slope, 6) AS mean FROM sl, (SELECT unnest(range(1, 8)) AS step)",
)
def _(spark, d):
    made = split(packed(series(spark, d, "D_event")), 7)
    return M.forecasts(made, {"ble": M.bunch_line(F.col("train"), 7, 70)}).select("series_id", "step", r6("mean").alias("mean"))


@query("pi_median_of_models", oracle("SELECT series_id, CAST(step AS BIGINT) AS step, round(min(f), 6) AS lower, round(median(f), 6) AS mid, round(max(f), 6) AS upper FROM fc GROUP BY 1, 2"))
def _(spark, d):
    fc, _ = benchmark(spark, d)
    return fc.groupBy("series_id", "step").agg(r6(F.min("mean")).alias("lower"), r6(F.median("mean")).alias("mid"), r6(F.max("mean")).alias("upper"))


@query(
    "pi_naive_normal",
    oracle("SELECT s.series_id, CAST(e.step AS BIGINT) AS step, round(s.last - 1.96 * s.sd * sqrt(e.step), 6) AS lower, round(s.last + 1.96 * s.sd * sqrt(e.step), 6) AS upper FROM (SELECT series_id, max_by(y, t) AS last, stddev_samp(d) AS sd FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d FROM tr) GROUP BY 1) s, steps e"),
)
def _(spark, d):
    obs = series(spark, d, MAIN).withColumn("n", F.max("t").over(W.partitionBy("series_id"))).where("t <= n - 18")
    gaps = obs.withColumn("g", F.col("y") - F.lag("y").over(W.partitionBy("series_id").orderBy("t")))
    fit = gaps.groupBy("series_id").agg(F.max_by("y", "t").alias("last"), F.stddev_samp("g").alias("sd")).withColumn("step", F.explode(M.steps_of(18)))
    wide = 1.96 * F.col("sd") * F.sqrt("step")
    return fit.select("series_id", F.col("step").cast("long").alias("step"), r6(F.col("last") - wide).alias("lower"), r6(F.col("last") + wide).alias("upper"))


@query(
    "pi_relative_error_quantile",
    oracle(
        """, qq AS (SELECT f.step, quantile_cont(round((e.y - f.f) / nullif(f.f, 0), 4), 0.025) AS lo, quantile_cont(round((e.y - f.f) / nullif(f.f, 0), 4), 0.975) AS hi FROM fc f JOIN te e ON e.series_id = f.series_id AND e.step = f.step WHERE f.model = 'theta' GROUP BY 1)
SELECT f.series_id, CAST(f.step AS BIGINT) AS step, round(f.f * (1 + q.lo), 6) AS lower, round(f.f * (1 + q.hi), 6) AS upper FROM fc f JOIN qq q ON q.step = f.step WHERE f.model = 'theta'""",
        "M_nation",
    ),
)
def _(spark, d):
    s = SPECS["M_nation"]
    prepared = M.prepare(series(spark, d, "M_nation"), s.m, s.h)
    fc = M.forecasts(prepared, {"theta": M.benchmark_models(s.m, s.h)["theta"]})
    relative = F.try_divide(F.col("actual") - F.col("mean"), F.col("mean"))
    # counts of rounded errors, so that a step's errors are pre-aggregated, and no task holds those of all series
    seen = fc.select("step", F.round(relative, QUANTILE_DIGITS).alias("e")).where("e is not null").groupBy("step", "e").agg(F.count(F.lit(1)).alias("n"))
    q = seen.groupBy("step").agg(F.percentile("e", F.lit(0.025), F.col("n")).alias("lo"), F.percentile("e", F.lit(0.975), F.col("n")).alias("hi"))
    return fc.join(F.broadcast(q), "step").select("series_id", "step", r6(F.col("mean") * (1 + F.col("lo"))).alias("lower"), r6(F.col("mean") * (1 + F.col("hi"))).alias("upper"))


@query("natural_sort_ids", "SELECT id, CAST(row_number() OVER (ORDER BY substr(id, 1, 1), CAST(substr(id, 2) AS INTEGER)) AS BIGINT) AS place FROM (SELECT chr(CAST(65 + n_regionkey AS INTEGER)) || n_nationkey AS id FROM nation)")
def _(spark, d):
    """Places are counted in range partitions: the order passes no single task."""
    ids = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.char(65 + F.col("n_regionkey")), F.col("n_nationkey").cast("string")).alias("id"))
    keyed = ids.withColumn("head", F.substring("id", 1, 1)).withColumn("number", F.expr("cast(substr(id, 2) as int)"))
    return files.placed(keyed, ["head", "number"], "natural-order").select("id", "place")
