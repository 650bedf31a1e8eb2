"""Queries on ARMA models, on what they leave of other models, and on harmonics with such errors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6
from ..operators import arma as A
from ..operators import models as M
from ..operators import resampling as B
from ..operators import theta as T
from ..registry import query
from ..sources.files import written
from ..sources.series import SPECS, obs_sql, packed, series, split
from . import linear_sql as L
from .forecasting import MAIN
from .thetas import _BEST, _ahead_sql, _join, variants_sql

_SMALL = [(p, q) for p in range(3) for q in range(3)]
#: Terms of the long autoregression, at most; a quarter of the values where these are few.
LONG = 8


def centred(rows: DataFrame, values: Column) -> DataFrame:
    """Adds xs, the values less their mean, and level, the mean."""
    made = rows.withColumn("level", R.mean_of(values))
    return made.withColumn("xs", R.let(F.col("level"), lambda mean: F.transform(values, lambda v: v - mean)))


def best_stationary(rows: DataFrame, orders: list[tuple[int, int]], h: int) -> DataFrame:
    """Of each row of (series_id, xs, level, ...) the stationary model of least aicc, ties by order: p, q and ahead, h forecasts."""
    fits = A.fit_orders(rows, A.menu_of(orders), max(map(max, orders)), LONG).where(F.col("aicc").isNotNull() & A.is_stationary(F.slice("a", 1, F.col("p"))))
    best = fits.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy(F.round("aicc", 6), "p", "q"))).where("k = 1")
    return best.withColumn("ahead", F.transform(A.forecast(h), lambda f: f + F.col("level"))).drop("k")


def _best_sql(tag: str, source: str, h: int) -> str:
    """Tables {tag}_best: (series_id, p, q, ahead) from source (series_id, xs)."""
    return f"""{L.arma_tables(source, _SMALL, LONG, tag)},
{tag}_k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(aicc, 6), p, q) AS k FROM {tag}_fit WHERE aicc IS NOT NULL AND {L.stationary('list_slice(a, 1, p)')}),
{tag}_best AS (SELECT series_id, p, q, {L.ahead(h)} AS ahead FROM {tag}_k WHERE k = 1)"""


@query(
    "arma_stationary",
    f"""WITH {obs_sql(MAIN)}, cn AS (SELECT series_id, y, t, avg(y) OVER (PARTITION BY series_id) AS level FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS big FROM obs) WHERE t <= big - 18), src AS (SELECT series_id, list(y - level ORDER BY t) AS xs FROM cn GROUP BY 1), lv AS (SELECT series_id, max(level) AS level FROM cn GROUP BY 1),
{_best_sql('s', 'src', 18)} SELECT b.series_id, b.p, b.q, CAST(u.step AS BIGINT) AS step, round(l.level + b.ahead[u.step], 6) AS mean FROM s_best b JOIN lv l ON l.series_id = b.series_id, (SELECT unnest(range(1, 19)) AS step) u""",
)
def _(spark, d):
    """The stationary ARMA model, with a mean, of least aicc among those of up to two lags and two shocks."""
    made = best_stationary(centred(split(packed(series(spark, d, MAIN)), 18), F.col("train")), _SMALL, 18)
    rows = made.select("series_id", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), F.posexplode("ahead").alias("i", "f"))
    return rows.select("series_id", "p", "q", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


def theta_arma(splits: DataFrame, m: int, h: int) -> DataFrame:
    """(series_id, p, q, f): four-theta forecasts and, of quarterly series and of monthly ones of over 99 values, those of what they leave.

    Without a model of the residuals p and q are null.
    """
    made = written(T.four_theta_fit(splits, m, h), "theta-fits")
    rest = made.where(F.lit(m == 4) | (F.lit(m == 12) & (F.col("n") > 99)))
    models = best_stationary(centred(rest, F.col("e")).select("series_id", "xs", "level"), _SMALL, h).select("series_id", "p", "q", "ahead")
    both = made.select("series_id", "f").join(models, "series_id", "left")
    return both.withColumn("f", F.when(F.col("ahead").isNull(), F.col("f")).otherwise(F.zip_with("f", "ahead", lambda a, b: a + b))).drop("ahead")


def theta_arma_sql(name: str) -> str:
    """(series_id, p, q, step, mean) of `theta_arma`, for a collection."""
    s = SPECS[name]
    keys = "r.series_id = b.series_id AND r.season = b.season AND r.curve = b.curve AND r.model = b.model AND r.theta = b.theta"
    error = "z.y - " + "(" + _join("z.product", "r.level", "z.l0", "z.s", "r.theta", "r.season") + ")"
    fit = "true" if s.m == 4 else f"n > 99 AND {s.m} = 12"
    return f"""{variants_sql(name, T.THETAS)}{_BEST}, fo AS ({_ahead_sql('best').replace('round(greatest(', '(greatest(').replace(', 0), 6) AS mean', ', 0)) AS mean')}),
re0 AS (SELECT b.series_id, b.n, z.t, {error} AS e FROM best b JOIN rc r ON {keys} AND r.alpha = b.alpha AND r.t < b.n JOIN zz z ON z.series_id = r.series_id AND z.season = r.season AND z.curve = r.curve AND z.model = r.model AND z.theta = r.theta AND z.t = r.t + 1),
re1 AS (SELECT *, avg(e) OVER (PARTITION BY series_id) AS level FROM re0 WHERE {fit}), rlv AS (SELECT series_id, max(level) AS level FROM re1 GROUP BY 1), src AS (SELECT series_id, list(e - level ORDER BY t) AS xs FROM re1 GROUP BY 1), {_best_sql('s', 'src', s.h)}
SELECT f.series_id, b.p, b.q, f.step, round(f.mean + coalesce(b.ahead[f.step] + l.level, 0), 6) AS mean FROM fo f LEFT JOIN s_best b ON b.series_id = f.series_id LEFT JOIN rlv l ON l.series_id = f.series_id"""


def _theta_arma(spark, d, name: str) -> DataFrame:
    s = SPECS[name]
    rows = theta_arma(split(packed(series(spark, d, name)), s.h), s.m, s.h)
    made = rows.select("series_id", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), F.posexplode("f").alias("i", "f"))
    return made.select("series_id", "p", "q", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


query("theta_arma_residual", theta_arma_sql("Q_nation"))(lambda spark, d: _theta_arma(spark, d, "Q_nation"))
query("rec_039_y_q", f"SELECT 'Y' AS period, * FROM ({theta_arma_sql('Y_nation')}) UNION ALL SELECT 'Q', * FROM ({theta_arma_sql('Q_nation')})")(
    lambda spark, d: _theta_arma(spark, d, "Y_nation").select(F.lit("Y").alias("period"), "*").unionByName(_theta_arma(spark, d, "Q_nation").select(F.lit("Q").alias("period"), "*"))
)


# ---- log returns --------------------------------------------------------------------------------------------------

#: Orders up to four, and larger ones, of which the three with the best diagnostics are kept.
_GRID = [(p, q) for p in range(1, 6) for q in range(1, 6)]
_LEAD = 5
def _steady() -> Column:
    """Whether values and errors of a fit both die away; one that does not failed."""
    shocks = F.transform(F.slice("a", F.col("p") + 1, F.col("q")), lambda x: -x)
    return F.col("a").isNotNull() & A.is_stationary(F.slice("a", 1, F.col("p"))) & A.is_stationary(shocks)



_DIAGNOSTICS = ("lb_out", "lb_mean", "acf_in", "acf_mean")


def diagnostics(e: Column, h: int) -> Column:
    """struct(lb_out, lb_mean, acf_in, acf_mean): shares and means of p values up to lag h and of autocorrelations up to 10 log10 n."""

    def of(r: Column) -> Column:
        n = F.size(e)
        terms = F.transform(F.slice(r, 1, h), lambda x, i: x * x / (n - i - 1))
        qs = F.transform(terms, lambda _, i: n * (n + 2) * F.aggregate(F.slice(terms, 1, i + 1), F.lit(0.0), lambda a, x: a + x))
        ps = F.transform(qs, lambda q, i: B.chi_square_tail(q, i + 1, h))
        share = lambda xs, f: R.mean_of(F.transform(xs, lambda x: F.when(f(x), 1.0).otherwise(0.0)))
        return R.let(ps, lambda p: F.struct(share(p, lambda x: x >= 0.05).alias("lb_out"), R.mean_of(p).alias("lb_mean"), share(r, lambda x: F.abs(x) <= 0.05).alias("acf_in"), R.mean_of(F.transform(r, lambda x: -F.abs(x))).alias("acf_mean")))

    most = F.greatest(F.lit(h), F.floor(10 * F.log10(F.size(e))).cast("int"))
    return R.let(R.let(R.deviations(e), lambda dev: F.transform(F.sequence(F.lit(1), F.least(most, F.size(e) - 1)), lambda k: R.acf(dev, k))), of)


def log_returns(packs: DataFrame) -> DataFrame:
    """Adds rs, the log returns, and last, the last value, of series whose values are positive."""
    rs = F.zip_with(F.slice("ys", 2, F.size("ys") - 1), F.slice("ys", 1, F.size("ys") - 1), lambda a, b: F.ln(a / b))
    return packs.where(F.forall("ys", lambda y: y > 0)).withColumn("rs", rs).withColumn("last", F.element_at("ys", -1))


def folds_of(n: Column, h: int) -> Column:
    """Places, from 1, where the tests of the folds begin: ten blocks of h at the end, or h + 1 shifted ones if ten reach into the first half."""
    upper = n - (h - 1)
    blocks = F.sequence(upper - 9 * h, upper, F.lit(h))
    return F.when(upper - 9 * h < n / 2, F.sequence(upper - h, upper)).otherwise(blocks)


def chosen_orders(rows: DataFrame, h: int) -> DataFrame:
    """Of (series_id, rs) the order of an ARMA model with a mean: (series_id, p, q, smape, mase, place), the best at place 1.

    All orders are fitted to the whole series and their residuals diagnosed.  Those up to four whose diagnostics are
    good in more than half of the lags, and the three best of the others by the sum of the four figures, are
    fitted again before each fold and measured on it; what fails on over half of the folds has no score.  A fit whose
    autoregression, or whose shocks, do not die away counts as failed.
    """
    fits = A.fit_orders(centred(rows, F.col("rs")), A.menu_of(_GRID), _LEAD, LONG).where(_steady())
    fits = written(fits.select("series_id", "p", "q", A.arma_errors(F.col("xs"), F.col("a"), F.col("p"), F.col("q")).alias("e")), "errors")
    fits = written(fits.select("series_id", "p", "q", diagnostics(F.col("e"), h).alias("d")), "diagnostics").select("series_id", "p", "q", "d.*")
    large = (F.col("p") > 4) | (F.col("q") > 4)
    total = sum((F.col(c) for c in _DIAGNOSTICS[1:]), F.col(_DIAGNOSTICS[0]))
    some = fits.where(large).withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy(F.round(total, 6).desc(), "p", "q"))).where("k <= 3")
    kept = fits.where(~large & (F.col("lb_out") > 0.5) & (F.col("acf_in") > 0.5)).select("series_id", "p", "q").unionByName(some.select("series_id", "p", "q"))
    folds = rows.withColumn("lo", F.explode(folds_of(F.size("rs"), h)))
    train = F.slice("rs", 1, F.col("lo") - 1)
    folds = folds.select("series_id", "lo", train.alias("train"), F.slice("rs", F.col("lo"), F.lit(h)).alias("test"))
    menus = kept.groupBy("series_id").agg(F.collect_list(F.struct("p", "q")).alias("menu"))  # no more than there are orders
    made = A.fit_orders(centred(folds.join(menus, "series_id"), F.col("train")), F.col("menu"), _LEAD, LONG)
    ahead = F.when(_steady(), F.transform(A.forecast(h), lambda f: f + F.col("level")))
    steps = F.transform(F.slice("train", 2, F.size("train") - 1), lambda x, i: F.abs(x - F.get("train", i)))
    made = written(made.select("series_id", "p", "q", "test", ahead.alias("f"), R.mean_of(steps).alias("scale")), "folds")
    error = lambda f: R.mean_of(F.zip_with("test", "f", f))
    scored = made.select("series_id", "p", "q", F.col("f").isNull().alias("failed"), error(lambda y, x: 2 * F.abs(y - x) / (F.abs(y) + F.abs(x))).alias("smape"), (error(lambda y, x: F.abs(y - x)) / F.col("scale")).alias("mase"))
    means = scored.groupBy("series_id", "p", "q").agg(F.avg(F.col("failed").cast("double")).alias("failed"), F.avg("smape").alias("smape"), F.avg("mase").alias("mase")).where("failed <= 0.5")
    w = W.partitionBy("series_id")
    root = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(w) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)))
    order = F.round((F.col("smape") / root("smape") + F.col("mase") / root("mase")) / 2, 6)
    return means.withColumn("o", order).withColumn("place", F.row_number().over(w.orderBy("o", "p", "q"))).drop("o", "failed")


def _log_return_sql(name: str, h: int) -> str:
    s = SPECS[name]
    big = "(p > 4 OR q > 4)"
    fold = f"CASE WHEN len(xs0) - {h - 1} - {9 * h} < len(xs0) / 2.0 THEN range(len(xs0) - {h - 1} - {h}, len(xs0) - {h - 1} + 1) ELSE range(len(xs0) - {h - 1} - {9 * h}, len(xs0) - {h - 1} + 1, {h}) END"
    p_value = "(SELECT 1 - sum(exp(k * ln(q.q / 2) + q.lag / 2.0 * ln(q.q / 2) - q.q / 2 - lgamma(q.lag / 2.0 + k + 1))) FROM (SELECT unnest(range(0, CAST(200 + 2 * q.q AS BIGINT))) AS k))"
    return f"""WITH {obs_sql(name)}, ps AS (SELECT series_id FROM obs GROUP BY 1 HAVING min(y) > 0), lr AS (SELECT o.series_id, t, y, ln(y / lag(y) OVER (PARTITION BY o.series_id ORDER BY t)) AS r FROM obs o JOIN ps ON ps.series_id = o.series_id),
rw AS (SELECT series_id, list(r ORDER BY t) AS xs0 FROM lr WHERE r IS NOT NULL GROUP BY 1), la AS (SELECT series_id, max_by(y, t) AS last FROM lr GROUP BY 1),
src AS (SELECT series_id, list_transform(xs0, lambda v: v - list_avg(xs0)) AS xs, list_avg(xs0) AS level FROM rw), {L.arma_tables('src', _GRID, LONG, 'w')},
ex AS (SELECT series_id, p, q, len(e) AS n, unnest(e) AS e, unnest(range(1, len(e) + 1)) AS t FROM w_fit WHERE a IS NOT NULL AND {L.stationary('list_slice(a, 1, p)')} AND {L.stationary('list_transform(list_slice(a, p + 1, p + q), lambda m: -m)')}), dv AS (SELECT *, e - avg(e) OVER (PARTITION BY series_id, p, q) AS c FROM ex), sq AS (SELECT series_id, p, q, sum(c * c) AS s FROM dv GROUP BY ALL),
ac AS (SELECT a.series_id, a.p, a.q, b.t - a.t AS lag, max(a.n) AS n, sum(a.c * b.c) / max(s.s) AS r FROM dv a JOIN dv b ON b.series_id = a.series_id AND b.p = a.p AND b.q = a.q AND b.t > a.t AND b.t - a.t <= greatest({h}, floor(10 * log10(a.n))) JOIN sq s ON s.series_id = a.series_id AND s.p = a.p AND s.q = a.q GROUP BY ALL),
qs AS (SELECT *, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY series_id, p, q ORDER BY lag) AS q0 FROM ac), pv AS (SELECT series_id, p, q AS q_order, lag, q0 AS q FROM qs WHERE lag <= {h}), pw AS (SELECT q.*, {p_value} AS pval FROM pv q),
d1 AS (SELECT series_id, p, q_order AS q, avg(CASE WHEN pval >= 0.05 THEN 1.0 ELSE 0.0 END) AS lb_out, avg(pval) AS lb_mean FROM pw GROUP BY ALL), d2 AS (SELECT series_id, p, q, avg(CASE WHEN abs(r) <= 0.05 THEN 1.0 ELSE 0.0 END) AS acf_in, avg(-abs(r)) AS acf_mean FROM ac GROUP BY ALL), dg AS (SELECT d1.*, acf_in, acf_mean FROM d1 JOIN d2 ON d2.series_id = d1.series_id AND d2.p = d1.p AND d2.q = d1.q),
lg AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(lb_out + lb_mean + acf_in + acf_mean, 6) DESC, p, q) AS k FROM dg WHERE {big}), kp AS (SELECT series_id, p, q FROM dg WHERE NOT {big} AND lb_out > 0.5 AND acf_in > 0.5 UNION ALL SELECT series_id, p, q FROM lg WHERE k <= 3),
fl AS (SELECT series_id, lo, list_slice(xs0, 1, lo - 1) AS train, list_slice(xs0, lo, lo + {h - 1}) AS test FROM (SELECT series_id, xs0, unnest({fold}) AS lo FROM rw)),
fs AS (SELECT series_id, lo, list_transform(train, lambda v: v - list_avg(train)) AS xs FROM fl), {L.arma_tables('fs', _GRID, LONG, 'f', 'series_id, lo')},
fa AS (SELECT f.series_id, f.lo, f.p, f.q, CASE WHEN {L.stationary('list_slice(a, 1, p)')} AND {L.stationary('list_transform(list_slice(a, p + 1, p + q), lambda m: -m)')} THEN {L.ahead(h)} END AS f FROM f_fit f WHERE (f.series_id, f.p, f.q) IN (SELECT (series_id, p, q) FROM kp)),
er AS (SELECT a.series_id, a.p, a.q, a.f IS NULL AS failed, list_avg(list_transform(a.f, lambda x, i: 2 * abs(l.test[i] - x - list_avg(l.train)) / (abs(l.test[i]) + abs(x + list_avg(l.train))))) AS smape, list_avg(list_transform(a.f, lambda x, i: abs(l.test[i] - x - list_avg(l.train)))) / list_avg(list_transform(list_slice(l.train, 2, len(l.train)), lambda x, i: abs(x - l.train[i]))) AS mase FROM fa a JOIN fl l ON l.series_id = a.series_id AND l.lo = a.lo),
me AS (SELECT series_id, p, q, avg(smape) AS smape, avg(mase) AS mase FROM er GROUP BY ALL HAVING avg(CAST(failed AS DOUBLE)) <= 0.5),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round((smape / rs + mase / rm) / 2, 6), p, q) AS place FROM (SELECT *, sqrt(sum(smape * smape) OVER (PARTITION BY series_id) / greatest(count(*) OVER (PARTITION BY series_id) - 1, 1)) AS rs, sqrt(sum(mase * mase) OVER (PARTITION BY series_id) / greatest(count(*) OVER (PARTITION BY series_id) - 1, 1)) AS rm FROM me)),
fin AS (SELECT series_id, p, q, level, {L.ahead(h)} AS f FROM (SELECT w.*, s.level FROM w_fit w JOIN (SELECT series_id, level FROM src) s ON s.series_id = w.series_id WHERE (w.series_id, w.p, w.q) IN (SELECT (series_id, p, q) FROM rk WHERE place = 1)))"""


def _arma_forecast(spark, d, name: str, h: int) -> DataFrame:
    rows = written(log_returns(packed(series(spark, d, name))).select("series_id", "rs", "last"), "log-returns")
    chosen = chosen_orders(rows.select("series_id", "rs"), h).where("place = 1").select("series_id", "p", "q")
    own = centred(rows.join(chosen, "series_id"), F.col("rs")).select("series_id", "last", "level", "xs", F.array(F.struct("p", "q")).alias("menu"))
    fits = A.fit_orders(own, F.col("menu"), _LEAD, LONG)
    total = lambda f: F.transform(f, lambda _, i: F.aggregate(F.slice(f, 1, i + 1), F.lit(0.0), lambda a, x: a + x) + (i + 1) * F.col("level"))
    made = fits.withColumn("f", F.transform(R.let(A.forecast(h), total), lambda x: F.col("last") * F.exp(x)))
    out = made.select("series_id", F.col("p").cast("long").alias("p"), F.col("q").cast("long").alias("q"), F.posexplode("f").alias("i", "f"))
    return out.select("series_id", "p", "q", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


_RETURNS = " SELECT f.series_id, f.p, f.q, CAST(u.step AS BIGINT) AS step, round(la.last * exp(list_sum(list_slice(f.f, 1, u.step)) + u.step * f.level), 6) AS mean FROM fin f JOIN la ON la.series_id = f.series_id, (SELECT unnest(range(1, {h} + 1)) AS step) u"

for _key, _name in (("arma_log_return", "D_event"), ("rec_106", "M_segment")):
    _h = SPECS[_name].h
    query(_key, _log_return_sql(_name, _h) + _RETURNS.replace("{h}", str(_h)))(lambda spark, d, name=_name, h=_h: _arma_forecast(spark, d, name, h))


# ---- harmonics ----------------------------------------------------------------------------------------------------

_TERMS = 6
_SINUS = [(p, q) for p in range(3) for q in range(2)]


def arima_fourier(splits: DataFrame, m: int, h: int, terms: int = _TERMS) -> DataFrame:
    """(series_id, terms, p, q, f): a level and harmonics of the season with ARMA errors, of least aicc over the number of harmonics and orders."""
    rows = splits.withColumn("terms", F.explode(F.sequence(F.lit(1), F.lit(terms))))
    at = lambda t: F.concat(F.array(F.lit(1.0)), A.harmonics(t, m, F.col("terms")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = written(rows.withColumn("c", A.regress(F.transform("train", lambda y, i: F.concat(at(i + 1), F.array(y))))), "harmonics")
    rows = rows.select("series_id", "n", "terms", "c", F.transform("train", lambda y, i: y - dot(F.col("c"), at(i + 1))).alias("xs"))
    fits = A.fit_orders(rows, A.menu_of(_SINUS), 2, LONG)
    nn, k = F.size("xs") - F.least(F.lit(LONG), F.floor(F.size("xs") / 4).cast("int")) - 2, F.col("p") + F.col("q") + 2 + 2 * F.col("terms")
    score = F.when(nn > k + 1, nn * F.ln(F.col("sse") / nn) + 2 * k + 2 * k * (k + 1) / (nn - k - 1))
    fits = fits.withColumn("score", score).where("score is not null")
    best = fits.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy(F.round("score", 6), "terms", "p", "q"))).where("k = 1")
    f = F.transform(A.forecast(h), lambda x, i: x + dot(F.col("c"), at(F.col("n") + i + 1)))
    return best.select("series_id", "terms", "p", "q", f.alias("f"))


def arima_fourier_sql(name: str, terms: int = _TERMS) -> str:
    s = SPECS[name]
    angle = lambda t: f"list_concat([1.0], flatten(list_transform(range(1, terms + 1), lambda j: [sin({2 * math.pi / s.m!r} * j * ({t})), cos({2 * math.pi / s.m!r} * j * ({t}))])))"
    return f"""WITH {obs_sql(name)}, al AS (SELECT *, count(*) OVER (PARTITION BY series_id) - {s.h} AS n FROM obs), tr AS (SELECT series_id, max(n) AS n, list(y ORDER BY t) AS ys FROM al WHERE t <= n GROUP BY 1),
hr AS (SELECT series_id, n, ys, CAST(k.terms AS BIGINT) AS terms FROM tr, (SELECT unnest(range(1, {terms + 1})) AS terms) k), hx AS (SELECT *, list_transform(ys, lambda y, i: list_append({angle('i')}, y)) AS rws FROM hr),
hq AS (SELECT *, {L.normal_equations('rws', '(2 * terms + 2)')} AS eq FROM hx), hc AS (SELECT *, {L.solve('eq')} AS c FROM hq),
src AS (SELECT series_id, terms, n, c, list_transform(ys, lambda y, i: y - {L.dot('c', angle('i'))}) AS xs FROM hc), {L.arma_tables('src', _SINUS, LONG, 'h', 'series_id, terms')},
sc AS (SELECT f.*, nn * ln(sse / nn) + 2 * kk + 2.0 * kk * (kk + 1) / (nn - kk - 1) AS score FROM (SELECT *, p + q + 2 + 2 * terms AS kk FROM h_fit) f WHERE a IS NOT NULL AND nn > kk + 1),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 6), terms, p, q) AS k FROM sc) WHERE k = 1), fc AS (SELECT series_id, terms, p, q, {L.ahead(s.h)} AS f FROM be)
SELECT f.series_id, f.terms, f.p, f.q, CAST(u.step AS BIGINT) AS step, round(f.f[u.step] + {L.dot('s.c', angle('s.n + u.step').replace('terms', 's.terms'))}, 6) AS mean FROM fc f JOIN src s ON s.series_id = f.series_id AND s.terms = f.terms, (SELECT unnest(range(1, {s.h + 1})) AS step) u"""


def _fourier(spark, d, name: str) -> DataFrame:
    s = SPECS[name]
    made = arima_fourier(split(packed(series(spark, d, name)), s.h), s.m, s.h)
    rows = made.select("series_id", *[F.col(c).cast("long").alias(c) for c in ("terms", "p", "q")], F.posexplode("f").alias("i", "f"))
    return rows.select("series_id", "terms", "p", "q", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


for _key, _name in (("arima_fourier", "H_event"), ("arima_fourier_w", "W_priority")):
    query(_key, arima_fourier_sql(_name))(lambda spark, d, name=_name: _fourier(spark, d, name))
