"""Queries on intervals, cross-validation, gates, fallbacks and combinations."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6, smape
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import theta as T
from ..registry import query
from ..sources.series import SPECS, obs_sql, packed, series, split
from ..sources.files import placed
from .forecasting import MAIN, benchmark, oracle
from .thetas import _BEST, _ahead_sql, variants_sql

_B = "OVER (PARTITION BY series_id)"
_H = SPECS[MAIN].h
#: Level weights of three smoothing models that stand for members with intervals of their own.
MEMBERS = (0.1, 0.3, 0.5)
_Z = 1.959964

#: Common table expressions mb: (series_id, alpha, n, level, sigma, aicc) of the members on the adjusted training values.
_MEMBERS_SQL = f""", gr AS (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in MEMBERS)}]) AS alpha), rc(series_id, alpha, t, l, sse) AS (SELECT d.series_id, g.alpha, d.t, d.y, 0.0::DOUBLE FROM des d, gr g WHERE d.t = 1
UNION ALL SELECT r.series_id, r.alpha, d.t, r.alpha * d.y + (1 - r.alpha) * r.l, r.sse + (d.y - r.l) * (d.y - r.l) FROM rc r JOIN des d ON d.series_id = r.series_id AND d.t = r.t + 1),
mb AS (SELECT r.series_id, r.alpha, p.n, r.l AS level, sqrt(r.sse / (p.n - 1)) AS sigma, p.n * ln(r.sse / p.n) + 4 + 12.0 / (p.n - 3) AS aicc FROM rc r JOIN pk p ON p.series_id = r.series_id AND p.n = r.t),
iv AS (SELECT m.*, o.step, m.level * o.ix AS mean, m.sigma * sqrt(1 + (o.step - 1) * m.alpha * m.alpha) * o.ix AS wide FROM mb m JOIN oi o ON o.series_id = m.series_id)"""


def members(prepared: DataFrame, h: int) -> DataFrame:
    """(series_id, alpha, aicc, step, mean, wide): smoothing forecasts, and the deviation of their errors at each step."""
    fits = F.transform(F.array(*map(F.lit, MEMBERS)), lambda a: F.struct(a.alias("alpha"), R.ses_level(F.col("des"), a).alias("level"), R.ses_error(F.col("des"), a).alias("sse")))
    rows = prepared.select("series_id", "n", "out", F.explode(fits).alias("f")).select("series_id", "n", "out", "f.*")
    aicc = F.col("n") * F.ln(F.col("sse") / F.col("n")) + 4 + 12.0 / (F.col("n") - 3)
    rows = rows.select("series_id", "alpha", "level", F.sqrt(F.col("sse") / (F.col("n") - 1)).alias("sigma"), aicc.alias("aicc"), F.posexplode("out").alias("i", "ix"))
    wide = F.col("sigma") * F.sqrt(1 + F.col("i") * F.col("alpha") * F.col("alpha")) * F.col("ix")
    return rows.select("series_id", "alpha", "aicc", (F.col("i") + 1).cast("long").alias("step"), (F.col("level") * F.col("ix")).alias("mean"), wide.alias("wide"))


def _members(spark, d) -> DataFrame:
    return members(M.prepare(series(spark, d, MAIN), SPECS[MAIN].m, _H), _H)


@query("combine_aicc_weights", oracle(_MEMBERS_SQL + f", wt AS (SELECT *, exp((min(aicc) {_B} - aicc) / 2) AS w FROM mb) SELECT series_id, alpha, round(w / sum(w) {_B}, 6) AS weight FROM wt"))
def _(spark, d):
    rows = _members(spark, d).where("step = 1").select("series_id", "alpha", "aicc")
    return E.aicc_weights(rows).select("series_id", "alpha", r6("weight").alias("weight"))


@query("pi_model_level95", oracle(_MEMBERS_SQL + f" SELECT series_id, alpha, CAST(step AS BIGINT) AS step, round(mean - {_Z} * wide, 6) AS lower, round(mean + {_Z} * wide, 6) AS upper FROM iv"))
def _(spark, d):
    """The interval of each model by itself."""
    return _members(spark, d).select("series_id", "alpha", "step", r6(F.col("mean") - _Z * F.col("wide")).alias("lower"), r6(F.col("mean") + _Z * F.col("wide")).alias("upper"))


@query("pi_mean_of_models", oracle(_MEMBERS_SQL + f" SELECT series_id, CAST(step AS BIGINT) AS step, round(avg(mean - {_Z} * wide), 6) AS lower, round(avg(mean + {_Z} * wide), 6) AS upper FROM iv GROUP BY 1, 2"))
def _(spark, d):
    low, high = F.avg(F.col("mean") - _Z * F.col("wide")), F.avg(F.col("mean") + _Z * F.col("wide"))
    return _members(spark, d).groupBy("series_id", "step").agg(r6(low).alias("lower"), r6(high).alias("upper"))


@query("pi_hybrid_mean", oracle(_MEMBERS_SQL + f" SELECT series_id, CAST(step AS BIGINT) AS step, round(greatest(avg(mean), 0), 4) AS mean, round(greatest(avg(mean - {_Z} * wide), 0), 4) AS lower, round(greatest(avg(mean + {_Z} * wide), 0), 4) AS upper FROM iv GROUP BY 1, 2"))
def _(spark, d):
    """Point and bounds of equal weights, not below zero, at four digits."""
    at = lambda c: F.round(F.greatest(F.avg(c), F.lit(0.0)), 4)
    half = _Z * F.col("wide")
    return _members(spark, d).groupBy("series_id", "step").agg(at(F.col("mean")).alias("mean"), at(F.col("mean") - half).alias("lower"), at(F.col("mean") + half).alias("upper"))


@query("thetaf", oracle(_MEMBERS_SQL + f" SELECT f.series_id, CAST(f.step AS BIGINT) AS step, round(f.f, 6) AS mean, round(f.f - {_Z} * i.wide, 6) AS lower, round(f.f + {_Z} * i.wide, 6) AS upper FROM fc f JOIN iv i ON i.series_id = f.series_id AND i.step = f.step WHERE f.model = 'theta' AND i.alpha = 0.3"))
def _(spark, d):
    """The theta method with its own seasonal adjustment, and the interval of the smoothing in it."""
    prepared = M.prepare(series(spark, d, MAIN), SPECS[MAIN].m, _H)
    point = M.forecasts(prepared, {"theta": M.benchmark_models(SPECS[MAIN].m, _H)["theta"]}).select("series_id", "step", F.col("mean").alias("f"))
    rows = point.join(members(prepared, _H).where("alpha = 0.3").select("series_id", "step", "wide"), ["series_id", "step"])
    half = _Z * F.col("wide")
    return rows.select("series_id", "step", r6("f").alias("mean"), r6(F.col("f") - half).alias("lower"), r6(F.col("f") + half).alias("upper"))


#: Normal quantiles of the levels 0.01 .. 0.99.
_Q99 = [round(NormalDist().inv_cdf(k / 100), 9) for k in range(1, 100)]


@query(
    "pi_quantile_mixture",
    oracle(
        _MEMBERS_SQL
        + f""", wt AS (SELECT series_id, alpha, w / sum(w) {_B} AS w FROM (SELECT *, exp((min(aicc) {_B} - aicc) / 2) AS w FROM mb)), qu AS (SELECT i.series_id, i.step, w.w, i.mean + i.wide * z.z AS q FROM iv i JOIN wt w ON w.series_id = i.series_id AND w.alpha = i.alpha, (SELECT unnest({_Q99}) AS z) z),
ed AS (SELECT series_id, step, min(q) AS lo, max(q) AS hi FROM qu GROUP BY 1, 2), gd AS (SELECT e.*, k, lo + (hi - lo) * (k - 1) / 98.0::DOUBLE AS g FROM ed e, (SELECT unnest(range(1, 100)) AS k)),
cd AS (SELECT g.series_id, g.step, g.k, g.g, sum(CASE WHEN q.q <= g.g + 1e-9 THEN q.w ELSE 0 END) / 100 AS p FROM gd g JOIN qu q ON q.series_id = g.series_id AND q.step = g.step GROUP BY 1, 2, 3, 4),
pt AS (SELECT i.series_id, i.step, sum(w.w * i.mean) AS mean FROM iv i JOIN wt w ON w.series_id = i.series_id AND w.alpha = i.alpha GROUP BY 1, 2)
SELECT c.series_id, CAST(c.step AS BIGINT) AS step, round(max(p.mean), 6) AS mean, round(min(CASE WHEN p >= 0.025 THEN g END), 6) AS lower, round(min(CASE WHEN p >= 0.975 THEN g END), 6) AS upper FROM cd c JOIN pt p ON p.series_id = c.series_id AND p.step = c.step GROUP BY 1, 2"""
    ),
)
def _(spark, d):
    """99 quantiles of each model, weighted by their criterion: bounds where the mixture, on a grid of 99 points, reaches 0.025 and 0.975."""
    weighted = E.aicc_weights(_members(spark, d))
    # the criteria are the same at every step
    rows = weighted.withColumn("w", F.col("weight") / F.sum("weight").over(W.partitionBy("series_id", "step")))
    z = F.array(*map(F.lit, _Q99))
    own = rows.groupBy("series_id", "step").agg(F.collect_list(F.struct("w", "mean", F.transform(z, lambda x: F.col("mean") + F.col("wide") * x).alias("q"))).alias("ms"))  # as long as there are models
    lo, hi = F.array_min(F.transform("ms", lambda x: F.array_min(x["q"]))), F.array_max(F.transform("ms", lambda x: F.array_max(x["q"])))
    own = own.withColumn("e", F.struct(lo.alias("lo"), hi.alias("hi")))

    def first(p: float) -> Column:
        share = lambda g: F.aggregate("ms", F.lit(0.0), lambda a, x: a + x["w"] * F.size(F.filter(x["q"], lambda v: v <= g + 1e-9))) / 100
        grid = F.transform(F.sequence(F.lit(0), F.lit(98)), lambda k: F.col("e.lo") + (F.col("e.hi") - F.col("e.lo")) * k / 98.0)
        return F.get(F.filter(grid, lambda g: share(g) >= p), F.lit(0))

    mean = F.aggregate("ms", F.lit(0.0), lambda a, x: a + x["w"] * x["mean"])
    return own.select("series_id", "step", r6(mean).alias("mean"), r6(first(0.025)).alias("lower"), r6(first(0.975)).alias("upper"))


@query(
    "pi_diffusion",
    oracle(
        f""", va AS (SELECT series_id, step, var_samp(f) AS v, median(f) AS mid FROM fc GROUP BY 1, 2), vm AS (SELECT series_id, avg(v) AS vm FROM va GROUP BY 1),
bs AS (SELECT series_id, var_samp(y) AS base FROM tr WHERE t > n - {2 * _H + 1} GROUP BY 1), ns AS (SELECT a.series_id, a.mse / (0.0001 + b.mse) AS nmse FROM er a JOIN er b ON b.series_id = a.series_id AND b.model = 'naive' WHERE a.model = 'comb')
SELECT v.series_id, CAST(v.step AS BIGINT) AS step, round(v.mid, 6) AS mean, round(greatest(v.mid - 1.96 * sqrt(b.base * n.nmse * v.v / m.vm), 0), 6) AS lower, round(v.mid + 1.96 * sqrt(b.base * n.nmse * v.v / m.vm), 6) AS upper
FROM va v JOIN vm m ON m.series_id = v.series_id JOIN bs b ON b.series_id = v.series_id JOIN ns n ON n.series_id = v.series_id"""
    ),
)
def _(spark, d):
    """The spread of the last 2 h + 1 values times the error against naive, shared over the steps as the continuations' variances are."""
    fc, prepared = benchmark(spark, d)
    mse = lambda k: F.avg(F.when(F.col("model") == k, F.pow(F.col("actual") - F.col("mean"), 2)))
    nmse = fc.groupBy("series_id").agg((mse("comb") / (1e-4 + mse("naive"))).alias("nmse"))
    base = prepared.select("series_id", F.explode(F.slice("train", -(2 * _H + 1), 2 * _H + 1)).alias("y")).groupBy("series_id").agg(F.var_samp("y").alias("base"))
    steps = fc.groupBy("series_id", "step").agg(F.var_samp("mean").alias("v"), F.median("mean").alias("mid"))
    steps = steps.withColumn("vm", F.avg("v").over(W.partitionBy("series_id"))).join(nmse, "series_id").join(base, "series_id")
    half = 1.96 * F.sqrt(F.col("base") * F.col("nmse") * F.col("v") / F.col("vm"))
    return steps.select("series_id", "step", r6("mid").alias("mean"), r6(F.greatest(F.col("mid") - half, F.lit(0.0))).alias("lower"), r6(F.col("mid") + half).alias("upper"))


#: Coefficients of the expansion of the t quantile at 0.975 in powers of 1 / degrees of freedom (Hill 1970), highest last.
_G = (1.959964, 2.372271, 2.822499, 2.55585, 1.589534)


def t_quantile(v: Column) -> Column:
    """The 0.975 quantile of the t distribution with v degrees of freedom, to three digits from four degrees on."""
    return sum((F.lit(g) / F.pow(v, F.lit(float(k))) for k, g in enumerate(_G[1:], 1)), F.lit(_G[0]))


_T_SQL = f"({_G[0]} + " + " + ".join(f"{g} / pow(n - 2, {k})" for k, g in enumerate(_G[1:], 1)) + ")"


@query(
    "pi_t_regression",
    f"WITH {obs_sql('D_event')}, al AS (SELECT *, count(*) {_B} AS n, max_by(y, t) {_B} AS last FROM obs), sl AS (SELECT series_id, median((last - y) / (n - t)) AS b FROM al WHERE t < n GROUP BY 1), "
    f"fi AS (SELECT a.series_id, max(n) AS n, max(last) AS last, max(b) AS b, sum(pow(y - (last - (n - t) * b), 2)) AS sse FROM al a JOIN sl s ON s.series_id = a.series_id GROUP BY 1), "
    f"w AS (SELECT *, {_T_SQL} * sqrt(sse / (n - 2)) * sqrt(1 + 1.0 / n + pow(n + step - (n + 1) / 2.0, 2) / (n * (n * n - 1.0) / 12)) AS half FROM fi, (SELECT unnest(range(1, 8)) AS step)) "
    "SELECT series_id, CAST(step AS BIGINT) AS step, round(last + step * b, 6) AS mean, round(last + step * b - half, 6) AS lower, round(last + step * b + half, 6) AS upper FROM w",
)
def _(spark, d):
    """Bunch lines with the interval of a regression: the errors of the fit, and the t quantile of n - 2 degrees of freedom."""
    own = packed(series(spark, d, "D_event")).withColumn("f", M.bunch_line(F.col("ys"), 7))
    n, last = F.col("n"), F.element_at("ys", -1)
    slope = F.get("f", F.lit(0)) - last
    sse = R.let(slope, lambda b: F.aggregate(F.transform("ys", lambda y, i: y - (last - (n - i - 1) * b)), F.lit(0.0), lambda a, e: a + e * e))
    own = own.withColumn("s", F.sqrt(sse / (n - 2)))
    at = F.col("n") + F.col("i") + 1 - (F.col("n") + 1) / 2
    half = t_quantile(F.col("n") - 2) * F.col("s") * F.sqrt(1 + 1.0 / F.col("n") + at * at / (F.col("n") * (F.col("n") * F.col("n") - 1.0) / 12))
    rows = own.select("series_id", "n", "s", F.posexplode("f").alias("i", "f"))
    return rows.select("series_id", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"), r6(F.col("f") - half).alias("lower"), r6(F.col("f") + half).alias("upper"))


def block_origins(n: Column, h: int) -> Column:
    """The last points of ten training parts that are h apart, the last one h before the end; h + 1 that are one apart where the first would lie in the first half."""
    first = n - 10 * h
    return F.when(first >= n / 2, F.sequence(first, n - h, F.lit(h).cast("long"))).otherwise(F.sequence(n - 2 * h, n - h))


for _key, _name, _h in (("cv_block10", "W_priority", 13), ("cv_block10_short", "M_segment", 6)):

    @query(
        _key,
        f"""WITH RECURSIVE {obs_sql(_name)}, al AS (SELECT *, count(*) {_B} AS n FROM obs), rc(series_id, t, n, l) AS (SELECT series_id, t, n, y FROM al WHERE t = 1 UNION ALL SELECT r.series_id, a.t, a.n, 0.3 * a.y + 0.7 * r.l FROM rc r JOIN al a ON a.series_id = r.series_id AND a.t = r.t + 1),
og AS (SELECT r.series_id, r.t AS origin, r.l, a.y AS last FROM rc r JOIN al a ON a.series_id = r.series_id AND a.t = r.t WHERE r.t <= r.n - {_h} AND CASE WHEN r.n - {10 * _h} >= r.n / 2.0 THEN r.t >= r.n - {10 * _h} AND (r.n - r.t) % {_h} = 0 ELSE r.t >= r.n - {2 * _h} END),
fo AS (SELECT o.series_id, o.origin, avg(200 * abs(a.y - o.last) / nullif(abs(a.y) + abs(o.last), 0)) AS naive, avg(200 * abs(a.y - o.l) / nullif(abs(a.y) + abs(o.l), 0)) AS ses FROM og o JOIN al a ON a.series_id = o.series_id AND a.t > o.origin AND a.t <= o.origin + {_h} GROUP BY 1, 2)
SELECT series_id, count(*) AS folds, round(avg(naive), 6) AS naive, round(avg(ses), 6) AS ses FROM fo GROUP BY 1""",
    )
    def _(spark, d, name=_name, h=_h):
        """Folds are places in one row: no training part is copied."""
        own = packed(series(spark, d, name)).withColumn("o", F.explode(block_origins(F.col("n"), h)))
        after = F.slice("ys", (F.col("o") + 1).cast("int"), h)
        score = lambda f: R.mean_of(F.filter(F.transform(after, lambda y: smape(y, f)), lambda x: x.isNotNull()))
        level = R.ses_level(F.slice("ys", 1, F.col("o").cast("int")), 0.3)
        folds = own.withColumn("l", level).select("series_id", score(F.get("ys", (F.col("o") - 1).cast("int"))).alias("naive"), score(F.col("l")).alias("ses"))
        return folds.groupBy("series_id").agg(F.count(F.lit(1)).alias("folds"), r6(F.avg("naive")).alias("naive"), r6(F.avg("ses")).alias("ses"))


@query("cv_scaled_score", oracle(f", z AS (SELECT *, sqrt(sum(smape * smape) {_B} / (count(*) {_B} - 1)) AS a, sqrt(sum(mase * mase) {_B} / (count(*) {_B} - 1)) AS b FROM er) SELECT series_id, model, round((smape / a + mase / b) / 2, 6) AS score FROM z"))
def _(spark, d):
    """The mean of two errors, each over its root mean square among the models of the series."""
    fc, prepared = benchmark(spark, d)
    w = W.partitionBy("series_id")
    scale = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(w) / (F.count(F.lit(1)).over(w) - 1))
    s = E.scores(fc, prepared, 12)
    return s.select("series_id", "model", r6((F.col("smape") / scale("smape") + F.col("mase") / scale("mase")) / 2).alias("score"))


#: The least length that a method is tried on.
LENGTHS = (("naive", 1), ("snaive", 13), ("ses", 24), ("holt", 36), ("theta", 75))


@query("gate_min_length", oracle(", z AS (SELECT e.series_id, e.model, e.smape, row_number() OVER (PARTITION BY e.series_id ORDER BY round(e.smape, 9), e.model) AS k FROM er e JOIN (SELECT DISTINCT series_id, n FROM tr) t ON t.series_id = e.series_id JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in LENGTHS) + ") g(model, least) ON g.model = e.model AND t.n >= g.least) SELECT series_id, model, round(smape, 6) AS smape FROM z WHERE k = 1"))
def _(spark, d):
    """The best model among those for which the series is long enough."""
    fc, prepared = benchmark(spark, d, models=tuple(k for k, _ in LENGTHS))
    gates = F.create_map(*[F.lit(x) for pair in LENGTHS for x in pair])
    s = E.scores(fc, prepared, 12).join(prepared.select("series_id", "n"), "series_id").where(F.col("n") >= gates[F.col("model")])
    best = s.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy(F.round("smape", 9), "model"))).where("k = 1")
    return best.select("series_id", "model", r6("smape").alias("smape"))


#: Collections of six frequencies, and the index before the first series of each in one numbering of all series.
NUMBERED = {"Y_nation": 0, "Q_nation": 23000, "M_segment": 47000, "W_priority": 95000, "D_event": 95359, "H_event": 99586}


def _numbered_sql() -> str:
    parts = [f"SELECT '{SPECS[n].letter}' AS period, series_id, {first} + row_number() OVER (ORDER BY series_id) AS i, n FROM (WITH {obs_sql(n)} SELECT series_id, count(*) AS n FROM obs GROUP BY 1)" for n, first in NUMBERED.items()]
    return " UNION ALL ".join(parts)


@query("gate_rf_long", f"SELECT g.period, g.series_id, CAST(g.i AS BIGINT) AS i, CAST(g.n AS BIGINT) AS n, m.model FROM ({_numbered_sql()}) g, (VALUES ('linear'), ('forest'), ('lazy')) m(model) WHERE m.model <> 'forest' OR NOT (g.n > 200 AND g.i > 95000)")
def _(spark, d):
    """Candidates by series; forests are not tried on series of over 200 values behind index 95000."""
    made = None
    for name, first in NUMBERED.items():
        sizes = series(spark, d, name).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
        rows = placed(sizes, ["series_id"], "numbered").select(F.lit(SPECS[name].letter).alias("period"), "series_id", (F.col("place") + first).alias("i"), "n")
        made = rows if made is None else made.unionByName(rows)
    own = made.withColumn("model", F.explode(F.array(*map(F.lit, ("linear", "forest", "lazy")))))
    return own.where((F.col("model") != "forest") | ~((F.col("n") > 200) & (F.col("i") > 95000)))


#: A model that fails where a value is not positive: a line of the logarithms.  D_event less 0.6 has such series.
_LOGS = f"WITH {obs_sql('D_event')}, al AS (SELECT series_id, t, y - 0.6 AS y, count(*) {_B} AS big FROM obs), tr AS (SELECT *, big - 7 AS n FROM al WHERE t <= big - 7), te AS (SELECT series_id, t - (big - 7) AS step, y FROM al WHERE t > big - 7), lo AS (SELECT series_id, max(n) AS n, min(y) AS low, max_by(y, t) AS last, regr_intercept(ln(CASE WHEN y > 0 THEN y ELSE 1 END), t) AS a, regr_slope(ln(CASE WHEN y > 0 THEN y ELSE 1 END), t) AS b FROM tr GROUP BY 1), fl AS (SELECT l.series_id, s.step, l.last, CASE WHEN l.low > 0 THEN exp(l.a + l.b * (l.n + s.step)) END AS f FROM lo l, (SELECT unnest(range(1, 8)) AS step) s)"


def _log_lines(spark, d) -> DataFrame:
    """(series_id, test, naive, logs): forecasts of a model that never fails and of one that may, null then."""
    made = split(packed(series(spark, d, "D_event").withColumn("y", F.col("y") - 0.6)), 7)
    logs = F.when(F.forall("train", lambda y: y > 0), F.transform("train", lambda y: F.ln(F.when(y > 0, y))))
    line = R.let(logs, lambda x: F.when(x.isNotNull(), R.let(M.line_of(x), lambda ab: F.transform(M.steps_of(7), lambda s: F.exp(ab["intercept"] + ab["slope"] * (F.size("train") + s))))))
    return made.select("series_id", "test", M.naive(F.col("train"), 7).alias("naive"), line.alias("logs"))


@query("fallback_on_error", _LOGS + " SELECT series_id, CAST(step AS BIGINT) AS step, round(coalesce(f, last), 6) AS mean, CASE WHEN f IS NULL THEN 'naive' ELSE 'log line' END AS used FROM fl")
def _(spark, d):
    """The forecasts of the second model where the first fails."""
    rows = _log_lines(spark, d).withColumn("used", F.when(F.col("logs").isNull(), "naive").otherwise("log line"))
    made = rows.select("series_id", "used", F.posexplode(F.coalesce("logs", "naive")).alias("i", "f"))
    return made.select("series_id", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"), "used")


@query("skip_on_error", _LOGS + " SELECT series_id, CAST(step AS BIGINT) AS step, round(f, 6) AS mean FROM fl")
def _(spark, d):
    """A series on which the model fails keeps its rows, without values."""
    rows = _log_lines(spark, d).select("series_id", F.posexplode(F.coalesce("logs", F.array_repeat(F.lit(None).cast("double"), 7))).alias("i", "f"))
    return rows.select("series_id", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


@query("score_inf_on_error", _LOGS + ", sc AS (SELECT f.series_id, avg(abs(t.y - f.last)) AS naive, avg(abs(t.y - f.f)) AS logs FROM fl f JOIN te t ON t.series_id = f.series_id AND t.step = f.step GROUP BY 1) SELECT series_id, logs IS NULL AS failed, CASE WHEN coalesce(logs, 'Infinity'::DOUBLE) < naive THEN 'log line' ELSE 'naive' END AS best, round(least(coalesce(logs, 'Infinity'::DOUBLE), naive), 6) AS score FROM sc")
def _(spark, d):
    """A candidate that failed has an infinite score, and is never the best."""
    error = lambda f: R.mean_of(F.zip_with("test", f, lambda y, x: F.abs(y - x)))
    s = _log_lines(spark, d).select("series_id", error("naive").alias("naive"), F.when(F.col("logs").isNotNull(), error("logs")).alias("raw"))
    s = s.withColumn("logs", F.coalesce("raw", F.lit(float("inf"))))
    best = F.when(F.col("logs") < F.col("naive"), "log line").otherwise("naive")
    return s.select("series_id", F.col("raw").isNull().alias("failed"), best.alias("best"), r6(F.least("logs", "naive")).alias("score"))


_BLEND = (10, 20, 48, 120)


@query("combine_blend_lengths", oracle(f", mn AS (SELECT t.series_id, l.len, avg(t.y) AS f FROM tr t, (SELECT unnest({list(_BLEND)}) AS len) l WHERE t.n >= l.len AND t.t > t.n - l.len GROUP BY 1, 2) SELECT series_id, CAST(step AS BIGINT) AS step, count(*) AS lengths, round(avg(f), 6) AS mean FROM mn, steps GROUP BY 1, 2"))
def _(spark, d):
    """The mean of the forecasts of all training lengths that the series has."""
    made = split(packed(series(spark, d, MAIN)), _H)
    usable = F.filter(F.array(*map(F.lit, _BLEND)), lambda k: k <= F.col("n"))
    fc = F.transform(usable, lambda k: R.mean_of(F.slice("train", (F.size("train") - k + 1).cast("int"), k)))
    rows = made.select("series_id", F.size(usable).cast("long").alias("lengths"), R.mean_of(fc).alias("f"), F.explode(M.steps_of(_H)).alias("step"))
    return rows.select("series_id", F.col("step").cast("long").alias("step"), "lengths", r6("f").alias("mean"))


@query(
    "combine_continuations",
    f"""WITH RECURSIVE {obs_sql('D_event')}, al AS (SELECT *, count(*) {_B} AS n FROM obs), st AS (SELECT a.alpha, o.off FROM (VALUES {", ".join(f"({a}::DOUBLE)" for a in MEMBERS)}) a(alpha), (SELECT CAST(unnest(range(0, 6)) AS BIGINT) AS off) o),
rc(series_id, alpha, off, t, n, l) AS (SELECT a.series_id, s.alpha, s.off, a.t, a.n, a.y FROM al a, st s WHERE a.t = s.off + 1 UNION ALL SELECT r.series_id, r.alpha, r.off, a.t, a.n, r.alpha * a.y + (1 - r.alpha) * r.l FROM rc r JOIN al a ON a.series_id = r.series_id AND a.t = r.t + 1)
SELECT series_id, count(*) AS continuations, round(median(l), 6) AS mean, round(stddev_samp(l), 6) AS spread FROM rc WHERE t = n GROUP BY 1""",
)
def _(spark, d):
    """Three configurations, each from six starts: the median of their continuations, and their spread."""
    own = packed(series(spark, d, "D_event"))
    levels = F.flatten(F.transform(F.array(*map(F.lit, MEMBERS)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda o: R.ses_level(F.slice("ys", o + 1, F.size("ys") - o), a))))
    rows = own.select("series_id", F.explode(levels).alias("l"))
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("continuations"), r6(F.median("l")).alias("mean"), r6(F.stddev_samp("l")).alias("spread"))


#: Four-theta forecasts of the adjusted values, as if these were a series of their own: fq.
_NINTH = ", adj AS (SELECT series_id, t, y FROM des UNION ALL SELECT series_id, n + step, NULL FROM oi), fq AS (" + variants_sql(MAIN, T.THETAS).replace(obs_sql(MAIN), "obs AS (SELECT * FROM adj)") + _BEST + _ahead_sql("best") + ")"


@query("amar_stat_predictors", oracle(_NINTH + ", k AS (SELECT unnest(range(1, 13)) AS place) SELECT t.series_id, CAST(k.place AS BIGINT) AS place, CAST(s.step AS BIGINT) AS step, coalesce(round(CASE WHEN k.place = 9 THEN q.mean ELSE f.f END, 6), 0.0) AS mean FROM (SELECT DISTINCT series_id FROM tr) t, k, steps s LEFT JOIN fc f ON f.series_id = t.series_id AND f.step = s.step AND f.model = ['naive', 'snaive', 'naive2', 'ses', 'holt', 'damped', 'theta', 'comb'][k.place] LEFT JOIN fq q ON q.series_id = t.series_id AND q.step = s.step"))
def _(spark, d):
    """Predictors by number: the eight methods, the four-theta method on the adjusted values, and zeros beyond."""
    s = SPECS[MAIN]
    prepared = M.prepare(series(spark, d, MAIN), s.m, s.h)
    ninth = T.four_theta(prepared.select("series_id", "n", F.col("des").alias("train"), "test"), s.m, s.h)
    prepared = prepared.join(ninth.select("series_id", F.col("f").alias("ninth")), "series_id", "left")
    named = {str(k): v for k, v in enumerate(M.benchmark_models(s.m, s.h).values(), 1)}
    zeros = F.array_repeat(F.lit(0.0), s.h)
    named |= {"9": F.coalesce("ninth", zeros)} | {str(k): zeros for k in range(10, 13)}
    return M.forecasts(prepared, named).select("series_id", F.col("model").cast("long").alias("place"), "step", r6("mean").alias("mean"))


_SIX = ("naive2", "snaive", "ses", "holt", "damped", "theta", "comb")


@query("rec_039_m_d", oracle(f", top AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(smape, 9), model) AS k FROM er WHERE model IN {_SIX}) SELECT f.series_id, CAST(f.step AS BIGINT) AS step, round(avg(f.f), 6) AS mean FROM fc f JOIN top t ON t.series_id = f.series_id AND t.model = f.model AND t.k <= 3 GROUP BY 1, 2", "D_event"))
def _(spark, d):
    """The mean of the three of seven candidates with the least error on the holdout."""
    s = SPECS["D_event"]
    fc, prepared = benchmark(spark, d, "D_event", _SIX)
    scores = E.scores(fc, prepared, s.m).withColumn("smape", F.round("smape", 9))
    chosen = E.best_models(scores, 3).select("series_id", "model")
    return E.combine(fc.join(chosen, ["series_id", "model"])).select("series_id", "step", r6("mean").alias("mean"))
