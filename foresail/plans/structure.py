"""Queries on temporal hierarchies, resampled series, clusters of them, shrunk seasons and tests of residuals."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6
from ..operators import clusters as C
from ..operators import models as M
from ..operators import resampling as B
from ..operators import seasonal as S
from ..registry import query
from ..sources.files import written
from ..sources.series import SPECS, obs_sql, packed, series, split
from .forecasting import MAIN
from .preparing import SHRUNK, _all

_B = "OVER (PARTITION BY series_id)"
_M, _H = SPECS[MAIN].m, SPECS[MAIN].h
_LEVELS = [k for k in range(1, _M + 1) if _M % k == 0]


def structural_weights(m: int) -> np.ndarray:
    """The m rows that make the values of one cycle from the forecasts of all its levels, finest first, by structural weights."""
    levels = [k for k in range(1, m + 1) if m % k == 0]
    sums = np.array([[1.0 if i * k <= j < (i + 1) * k else 0.0 for j in range(m)] for k in levels for i in range(m // k)])
    inverse = np.array([1.0 / k for k in levels for _ in range(m // k)])
    return np.linalg.solve((sums.T * inverse) @ sums, sums.T * inverse)


def blocks(ys: Column, k: int) -> Column:
    """The sums of stretches of k values that end with the last one."""
    n = F.floor(F.size(ys) / k).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(ys, F.size(ys) - (n - i) * k + 1, k), F.lit(0.0), lambda a, x: a + x))).otherwise(F.array().cast("array<double>"))


def thief(ys: Column, m: int, h: int, model: str) -> Column:
    """Forecasts of every level of aggregation that divides m, reconciled: seasonal naive, or smoothing with level weight 0.3."""
    cycles = -(-h // m)
    levels = [k for k in range(1, m + 1) if m % k == 0]
    ahead = [M.seasonal_naive(blocks(ys, k), m // k, m // k * cycles) if model == "snaive" else M.ses(blocks(ys, k), 0.3, m // k * cycles) for k in levels]
    weights = F.array(*[F.array(*[F.lit(round(float(g), 12)) for g in row]) for row in structural_weights(m)])

    def cycle(all_levels: Column, c: int) -> Column:
        nodes = F.concat(*[F.slice(all_levels[f"k{k}"], c * (m // k) + 1, m // k) for k in levels])
        return F.transform(weights, lambda row: F.aggregate(F.zip_with(row, nodes, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))

    held = F.struct(*[f.alias(f"k{k}") for k, f in zip(levels, ahead, strict=True)])
    return F.slice(R.let(held, lambda x: F.concat(*[cycle(x, c) for c in range(cycles)])), 1, h)


def _thief_sql(model: str) -> str:
    nodes = [(k, i) for k in _LEVELS for i in range(_M // k)]
    g = ", ".join(f"({j}, {k}, {i}, {round(float(row[x]), 12)}::DOUBLE)" for j, row in enumerate(structural_weights(_M)) for x, (k, i) in enumerate(nodes))
    base = f"""WITH RECURSIVE {obs_sql(MAIN)}, al AS (SELECT series_id, t, y, count(*) {_B} - {_H} AS n FROM obs), tr AS (SELECT * FROM al WHERE t <= n),
ag AS (SELECT series_id, k, CAST(floor((t - 1 - n % k) / k) AS BIGINT) AS b, max(n) // k AS nb, sum(y) AS v FROM tr, (SELECT unnest({_LEVELS}) AS k) WHERE t > n % k GROUP BY 1, 2, 3), """
    if model == "snaive":
        nodes_sql = f"z AS (SELECT series_id, k, b - (nb - {_M} // k) AS i, v AS f FROM ag WHERE b >= nb - {_M} // k)"
    else:
        nodes_sql = f"rc(series_id, k, b, nb, l) AS (SELECT series_id, k, b, nb, v FROM ag WHERE b = 0 UNION ALL SELECT r.series_id, r.k, a.b, a.nb, 0.3 * a.v + 0.7 * r.l FROM rc r JOIN ag a ON a.series_id = r.series_id AND a.k = r.k AND a.b = r.b + 1), z AS (SELECT r.series_id, r.k, CAST(x.i AS BIGINT) AS i, r.l AS f FROM rc r JOIN (SELECT unnest(range(0, {_M})) AS i) x ON x.i < {_M} // r.k WHERE r.b = r.nb - 1)"
    return base + nodes_sql + f", g(j, k, i, w) AS (VALUES {g}), bt AS (SELECT z.series_id, g.j, sum(g.w * z.f) AS f FROM z JOIN g ON g.k = z.k AND g.i = z.i GROUP BY 1, 2) SELECT series_id, CAST(s.step AS BIGINT) AS step, round(f, 6) AS mean FROM bt JOIN (SELECT unnest(range(1, {_H + 1})) AS step) s ON (s.step - 1) % {_M} = bt.j"


for _key, _model in (("thief", "snaive"), ("thief_ses", "ses")):

    @query(_key, _thief_sql(_model))
    def _(spark, d, model=_model):
        made = split(packed(series(spark, d, MAIN)), _H)
        return M.forecasts(made, {"thief": thief(F.col("train"), _M, _H, model)}).select("series_id", "step", r6("mean").alias("mean"))


@query(
    "mapa",
    f"""WITH RECURSIVE {obs_sql(MAIN)}, al AS (SELECT series_id, t, y, count(*) {_B} - {_H} AS n FROM obs), tr AS (SELECT * FROM al WHERE t <= n),
ag AS (SELECT series_id, k, CAST(floor((t - 1 - n % k) / k) AS BIGINT) AS b, max(n) // k AS nb, sum(y) / k AS v FROM tr, (SELECT CAST(unnest(range(1, {_M + 1})) AS BIGINT) AS k) WHERE t > n % k GROUP BY 1, 2, 3),
rc(series_id, k, b, nb, l, s) AS (SELECT a.series_id, a.k, a.b, a.nb, a.v, z.v - a.v FROM ag a JOIN ag z ON z.series_id = a.series_id AND z.k = a.k AND z.b = 1 WHERE a.b = 0
UNION ALL SELECT r.series_id, r.k, a.b, a.nb, 0.3 * a.v + 0.7 * (r.l + r.s), 0.1 * (0.3 * a.v + 0.7 * (r.l + r.s) - r.l) + 0.9 * r.s FROM rc r JOIN ag a ON a.series_id = r.series_id AND a.k = r.k AND a.b = r.b + 1)
SELECT r.series_id, CAST(s.step AS BIGINT) AS step, round(avg(r.l + r.s * ceil(s.step::DOUBLE / r.k)), 6) AS mean FROM rc r, (SELECT unnest(range(1, {_H + 1})) AS step) s WHERE r.b = r.nb - 1 GROUP BY 1, 2""",
)
def _(spark, d):
    """Level and trend of the means of 1 to m values, each smoothed by itself, put together at every step."""
    made = split(packed(series(spark, d, MAIN)), _H)

    def states(ys: Column) -> Column:
        each = [F.struct(F.lit(float(k)).alias("k"), R.holt_state(F.transform(blocks(ys, k), lambda x: x / k), 0.3, 0.1).alias("s")) for k in range(1, _M + 1)]  # noqa: B023
        return F.array(*each)

    at = lambda held, s: F.aggregate(held, F.lit(0.0), lambda a, x: a + x["s"]["level"] + x["s"]["trend"] * F.ceil(s / x["k"])) / _M
    fc = R.let(states(F.col("train")), lambda held: F.transform(M.steps_of(_H), lambda s: at(held, s)))
    return M.forecasts(made, {"mapa": fc}).select("series_id", "step", r6("mean").alias("mean"))


_COPIES = 10
#: Resampled copies: cp (series_id, copy, t, n, y), blocks of the residuals of a line on that line.
_COPY_SQL = f"""WITH RECURSIVE {obs_sql('D_event')}, ln0 AS (SELECT series_id, count(*) AS n, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM obs GROUP BY 1), re AS (SELECT o.series_id, o.t, l.n, l.a, l.b, o.y - (l.a + l.b * o.t) AS e FROM obs o JOIN ln0 l ON l.series_id = o.series_id),
cn AS (SELECT CAST(unnest(range(1, {_COPIES + 1})) AS BIGINT) AS copy), pl AS (SELECT r.series_id, c.copy, r.t, r.n, r.a, r.b, least(r.n, 14) AS w, {B.lot_sql('c.copy', '99')} % least(r.n, 14) AS off FROM re r, cn c),
pk AS (SELECT *, {B.lot_sql('copy', '((t - 1 + off) // w)')} % (n - w + 1) + (t - 1 + off) % w + 1 AS src FROM pl), cp AS (SELECT p.series_id, p.copy, p.t, p.n, p.a + p.b * p.t + e.e AS y, p.a, p.b FROM pk p JOIN re e ON e.series_id = p.series_id AND e.t = p.src)"""


def _copies(spark, d) -> DataFrame:
    return packed(series(spark, d, "D_event")).withColumn("copies", B.block_copies(F.col("ys"), 7, _COPIES))


@query("mbb_bootstrap", _COPY_SQL + " SELECT series_id, copy, t, round(y, 6) AS y FROM cp")
def _(spark, d):
    rows = _copies(spark, d).select("series_id", F.posexplode("copies").alias("c", "own")).select("series_id", "c", F.posexplode("own").alias("i", "y"))
    return rows.select("series_id", (F.col("c") + 1).cast("long").alias("copy"), (F.col("i") + 1).cast("long").alias("t"), r6("y").alias("y"))


@query("pi_bootstrap_minmax", _COPY_SQL + ", rc(series_id, copy, t, n, l) AS (SELECT series_id, copy, t, n, y FROM cp WHERE t = 1 UNION ALL SELECT r.series_id, r.copy, c.t, c.n, 0.3 * c.y + 0.7 * r.l FROM rc r JOIN cp c ON c.series_id = r.series_id AND c.copy = r.copy AND c.t = r.t + 1) SELECT series_id, round(min(l), 6) AS lower, round(median(l), 6) AS mean, round(max(l), 6) AS upper FROM rc WHERE t = n GROUP BY 1")
def _(spark, d):
    """The least, middle and largest forecast over resampled copies."""
    rows = _copies(spark, d).select("series_id", F.explode(F.transform("copies", lambda c: R.ses_level(c, 0.3))).alias("l"))
    return rows.groupBy("series_id").agg(r6(F.min("l")).alias("lower"), r6(F.median("l")).alias("mean"), r6(F.max("l")).alias("upper"))


_DIST = _COPY_SQL + ", ds AS (SELECT a.series_id, a.copy AS i, b.copy AS j, sqrt(sum((a.y - b.y) * (a.y - b.y))) AS d FROM cp a JOIN cp b ON b.series_id = a.series_id AND b.t = a.t GROUP BY 1, 2, 3)"


@query("euclid_diss", _DIST + " SELECT series_id, i AS copy, j AS other, round(d, 6) AS distance FROM ds WHERE i < j")
def _(spark, d):
    """Distances between the copies of each series, of which there is a given number."""
    rows = _copies(spark, d).select("series_id", F.posexplode(B.distances(F.col("copies"))).alias("a", "row")).select("series_id", "a", F.posexplode("row").alias("b", "v"))
    return rows.where("a < b").select("series_id", (F.col("a") + 1).cast("long").alias("copy"), (F.col("b") + 1).cast("long").alias("other"), r6("v").alias("distance"))


def _medoids_sql(sizes: tuple[int, ...]) -> str:
    sets = [(k, x, c) for k in sizes for x, own in enumerate(combinations(range(1, _COPIES + 1), k)) for c in own]
    values = ", ".join(f"({k}, {x}, {c})" for k, x, c in sets)
    return f"""{_DIST}, st(k, s, medoid) AS (VALUES {values}), ne AS (SELECT d.series_id, t.k, t.s, d.i, min(d.d) AS d FROM ds d JOIN st t ON t.medoid = d.j GROUP BY 1, 2, 3, 4),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, k ORDER BY cost, s) AS r FROM (SELECT series_id, k, s, round(sum(d), 9) AS cost FROM ne GROUP BY 1, 2, 3)) WHERE r = 1),
cl AS (SELECT * FROM (SELECT b.series_id, b.k, b.cost, d.i, t.medoid, row_number() OVER (PARTITION BY b.series_id, b.k, d.i ORDER BY d.d, t.medoid) AS r FROM be b JOIN st t ON t.k = b.k AND t.s = b.s JOIN ds d ON d.series_id = b.series_id AND d.j = t.medoid) WHERE r = 1)"""


@query("pam_cluster", _medoids_sql((3,)) + " SELECT series_id, i AS copy, CAST(medoid AS BIGINT) AS medoid, round(cost, 6) AS cost FROM cl")
def _(spark, d):
    """Each copy with the medoid of its cluster, of three found by building and swapping."""
    rows = written(_copies(spark, d).select("series_id", B.distances(F.col("copies")).alias("d")), "distances")
    rows = written(rows.withColumn("best", C.pam(F.col("d"), F.lit(3))), "medoids")
    made = rows.select("series_id", "best.cost", F.posexplode(B.nearest(F.col("d"), F.col("best.set"))).alias("i", "medoid"))
    return made.select("series_id", (F.col("i") + 1).cast("long").alias("copy"), (F.col("medoid") + 1).cast("long").alias("medoid"), r6("cost").alias("cost"))


_SIZES = (2, 3, 4)


@query(
    "silhouette_k",
    _medoids_sql(_SIZES)
    + """, sz AS (SELECT series_id, k, medoid, count(*) AS n FROM cl GROUP BY 1, 2, 3), mn AS (SELECT a.series_id, a.k, a.i, a.medoid AS own, b.medoid AS other, sum(d.d) / CASE WHEN a.medoid = b.medoid THEN nullif(count(*) - 1, 0) ELSE count(*) END AS d
FROM cl a JOIN cl b ON b.series_id = a.series_id AND b.k = a.k JOIN ds d ON d.series_id = a.series_id AND d.i = a.i AND d.j = b.i GROUP BY 1, 2, 3, 4, 5), ab AS (SELECT series_id, k, i, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM mn GROUP BY 1, 2, 3),
si AS (SELECT series_id, k, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS width FROM ab GROUP BY 1, 2) SELECT series_id, CAST(k AS BIGINT) AS k, width, row_number() OVER (PARTITION BY series_id ORDER BY width DESC, k) = 1 AS chosen FROM si""",
)
def _(spark, d):
    """The mean silhouette of two to four clusters, and which is largest."""
    rows = written(_copies(spark, d).select("series_id", B.distances(F.col("copies")).alias("d")), "distances").withColumn("k", F.explode(F.array(*map(F.lit, _SIZES))))
    rows = written(rows.withColumn("best", C.pam(F.col("d"), F.col("k"))), "medoids")
    rows = written(rows.withColumn("own", B.nearest(F.col("d"), F.col("best.set"))), "members")
    made = rows.select("series_id", F.col("k").cast("long").alias("k"), r6(B.silhouette(F.col("d"), F.col("own"))).alias("width"))
    first = F.row_number().over(W.partitionBy("series_id").orderBy(F.col("width").desc(), "k")) == 1
    return made.withColumn("chosen", first)


@query("bagged_cluster_ets")
def _(spark, d):
    """A hundred copies of each monthly series, thirty good ones in clusters by silhouette, ten of these forecast."""
    prepared = M.prepare(series(spark, d, MAIN), 12, _H)
    rows = C.bagged_clusters(prepared, 12, _H)
    return rows.select("series_id", F.col("step").cast("long").alias("step"), *[r6(c).alias(c) for c in ("lower", "mean", "upper")])


#: The choice of shrinkage: W from the shrinking query, skewness of the indices.
_CHOSEN = SHRUNK + f""", lk AS (SELECT x.series_id, x.phase, sum(exp(-(x.ix - z.ix) * (x.ix - z.ix) / (2 * x.v)) * z.ix) / sum(exp(-(x.ix - z.ix) * (x.ix - z.ix) / (2 * x.v))) AS lk FROM w x JOIN w z ON x.series_id = z.series_id GROUP BY 1, 2),
c0 AS (SELECT *, ix - avg(ix) {_B} AS c FROM w), sk AS (SELECT *, avg(c * c * c) {_B} / pow(avg(c * c) {_B}, 1.5) AS skew FROM c0),
mw AS (SELECT s.series_id, s.phase, s.skew, s.w, CASE WHEN skew < 0.5 AND w < 0.2 THEN 'classical' WHEN skew >= 0.5 AND w < 0.5 THEN 'lemon_krutchkoff' ELSE 'james_stein' END AS used,
 CASE WHEN skew < 0.5 AND w < 0.2 THEN ix WHEN skew >= 0.5 AND w < 0.5 THEN l.lk ELSE w + (1 - w) * ix END AS six FROM sk s JOIN lk l ON l.series_id = s.series_id AND l.phase = s.phase)"""


@query("shrink_miller_williams", _all(_CHOSEN + " SELECT series_id, CAST(phase AS BIGINT) AS phase, round(skew, 6) AS skew, used, round(six, 6) AS shrunk FROM mw"))
def _(spark, d):
    made = S.chosen_shrinkage(S.shrink(S.trimmed_indices(series(spark, d, MAIN), 12), 12))
    return made.select("series_id", "phase", r6("skew").alias("skew"), "used", r6("shrunk").alias("shrunk"))


@query(
    "seasonal_dec_shrunk",
    _all(_CHOSEN + f""", nn AS (SELECT series_id, max(t) AS n FROM obs GROUP BY 1), dv0 AS (SELECT series_id, t, y - avg(y) {_B} AS e FROM obs), rr0 AS (SELECT a.series_id, b.t - a.t AS lag, sum(a.e * b.e) / (SELECT sum(z.e * z.e) FROM dv0 z WHERE z.series_id = a.series_id) AS r FROM dv0 a JOIN dv0 b ON b.series_id = a.series_id AND b.t > a.t AND b.t <= a.t + 12 GROUP BY 1, 2),
 te0 AS (SELECT n.series_id, coalesce(n.n >= 36 AND floor(10 * log10(n.n)) >= 12 AND abs(max(CASE WHEN lag = 12 THEN r END)) > 1.645 * sqrt((1 + 2 * sum(CASE WHEN lag < 12 THEN r * r END)) / n.n), false) AS seasonal FROM nn n LEFT JOIN rr0 r ON r.series_id = n.series_id GROUP BY n.series_id, n.n)""" + f" SELECT m.series_id, CAST(s.step AS BIGINT) AS step, CASE WHEN te0.seasonal THEN round(m.six, 6) ELSE 1.0 END AS index, CASE WHEN te0.seasonal THEN m.used ELSE 'none' END AS used FROM mw m JOIN te0 ON te0.series_id = m.series_id JOIN nn n ON n.series_id = m.series_id JOIN (SELECT unnest(range(1, {_H + 1})) AS step) s ON (n.n - 24 + s.step - 1) % 12 = m.phase"),
)
def _(spark, d):
    """The index of each step ahead from the chosen shrinkage, as it stands two cycles before; 1 where the test finds no season."""
    obs = series(spark, d, MAIN)
    found = S.seasonality_test(packed(obs), 12).select("series_id", "is_seasonal")
    made = S.chosen_shrinkage(S.shrink(S.trimmed_indices(obs, 12), 12))
    steps = obs.groupBy("series_id").agg(F.max("t").alias("n")).withColumn("step", F.explode(M.steps_of(_H)))
    at = steps.withColumn("phase", (F.col("n") - 24 + F.col("step") - 1) % 12)
    on = F.col("is_seasonal")
    rows = at.join(made, ["series_id", "phase"]).join(found, "series_id")
    return rows.select("series_id", F.col("step").cast("long").alias("step"), F.when(on, r6("shrunk")).otherwise(F.lit(1.0)).alias("index"), F.when(on, F.col("used")).otherwise(F.lit("none")).alias("used"))


_LAGS = 10
_LJUNG = f"WITH {obs_sql('D_event')}, df AS (SELECT series_id, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS e FROM obs), rs AS (SELECT series_id, t, e - avg(e) {_B} AS e, count(*) {_B} AS n FROM df WHERE e IS NOT NULL), ss AS (SELECT series_id, sum(e * e) AS s FROM rs GROUP BY 1), ac AS (SELECT a.series_id, b.t - a.t AS lag, max(a.n) AS n, sum(a.e * b.e) / max(s.s) AS r FROM rs a JOIN rs b ON b.series_id = a.series_id AND b.t > a.t AND b.t <= a.t + 14 JOIN ss s ON s.series_id = a.series_id GROUP BY 1, 2), qq AS (SELECT series_id, lag, n, r, n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY series_id ORDER BY lag) AS q FROM ac), pv AS (SELECT q.*, (SELECT 1 - sum(exp(k * ln(q.q / 2) + q.lag / 2.0 * ln(q.q / 2) - q.q / 2 - lgamma(q.lag / 2.0 + k + 1))) FROM (SELECT unnest(range(0, CAST(200 + 2 * q.q AS BIGINT))) AS k)) AS p FROM qq q WHERE lag <= {_LAGS})"


def _box(spark, d) -> DataFrame:
    """(series_id, n, rs, qs, ps): autocorrelations of the residuals of a random walk, the statistic and its p value up to each lag."""
    own = packed(series(spark, d, "D_event"))
    steps = F.zip_with(F.slice("ys", 2, F.size("ys") - 1), F.slice("ys", 1, F.size("ys") - 1), lambda a, b: a - b)
    rs = R.let(R.deviations(steps), lambda dev: F.transform(F.sequence(F.lit(1), F.lit(14)), lambda k: R.acf(dev, k)))
    own = own.withColumn("rs", rs).withColumn("n", F.col("n") - 1)
    terms = F.transform(F.slice("rs", 1, _LAGS), lambda r, i: r * r / (F.col("n") - i - 1))
    qs = R.let(terms, lambda x: F.transform(F.sequence(F.lit(1), F.lit(_LAGS)), lambda k: F.col("n") * (F.col("n") + 2) * F.aggregate(F.slice(x, 1, k), F.lit(0.0), lambda a, v: a + v)))
    own = own.withColumn("qs", qs)
    return own.withColumn("ps", F.transform("qs", lambda q, i: B.chi_square_tail(q, i + 1, _LAGS)))


@query("ljung_box", _LJUNG + " SELECT series_id, CAST(lag AS BIGINT) AS lag, round(q, 6) AS statistic, round(p, 6) AS p_value FROM pv")
def _(spark, d):
    rows = _box(spark, d).select("series_id", F.posexplode(F.arrays_zip("qs", "ps")).alias("i", "x"))
    return rows.select("series_id", (F.col("i") + 1).cast("long").alias("lag"), r6("x.qs").alias("statistic"), r6("x.ps").alias("p_value"))


@query("arima_residual_diag", _LJUNG + ", a AS (SELECT series_id, avg(CASE WHEN p >= 0.05 THEN 1.0 ELSE 0.0 END) AS lb_out, avg(p) AS lb_mean FROM pv GROUP BY 1), b AS (SELECT series_id, avg(CASE WHEN abs(r) <= 0.05 THEN 1.0 ELSE 0.0 END) AS acf_in, avg(-abs(r)) AS acf_mean FROM qq GROUP BY 1) SELECT a.series_id, round(lb_out, 6) AS lb_out, round(lb_mean, 6) AS lb_mean, round(acf_in, 6) AS acf_in, round(acf_mean, 6) AS acf_mean FROM a JOIN b ON b.series_id = a.series_id")
def _(spark, d):
    """Shares and means of p values and of autocorrelations that tell good residuals."""
    share = lambda c, f: R.mean_of(F.transform(c, lambda x: F.when(f(x), 1.0).otherwise(0.0)))
    return _box(spark, d).select(
        "series_id",
        r6(share("ps", lambda p: p >= 0.05)).alias("lb_out"),
        r6(R.mean_of(F.col("ps"))).alias("lb_mean"),
        r6(share("rs", lambda r: F.abs(r) <= 0.05)).alias("acf_in"),
        r6(R.mean_of(F.transform("rs", lambda r: -F.abs(r)))).alias("acf_mean"),
    )
