"""Queries on smoothers, and on recipes that are put together from the models of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import preparation as P
from ..operators import seasonal as S
from ..operators import smoothing as L
from ..operators import theta as T
from ..registry import query
from ..sources.series import SPECS, obs_sql, packed, series, split
from .forecasting import MAIN, _frame, benchmark, oracle
from .selecting import _SIX
from .thetas import _BEST, _ahead_sql, variants_sql

_B = "OVER (PARTITION BY series_id)"


def _steps(rows: DataFrame, *keep: str) -> DataFrame:
    """(series_id, step, mean) and what is kept, from an array column f."""
    made = rows.select("series_id", *keep, F.posexplode("f").alias("i", "mean"))
    return made.select("series_id", *keep, (F.col("i") + 1).cast("long").alias("step"), r6("mean").alias("mean"))


_SPAN = 0.4


def _loess_sql(source: str, y: str, name: str, span: float = _SPAN) -> str:
    """Tables `name`: (series_id, t, f), the local lines through a table (series_id, t, n, y)."""
    return f"""{name}_q AS (SELECT series_id, t, n, least(greatest(ceil({span} * n), 3), n) AS q FROM {source}),
{name}_r AS (SELECT *, greatest(CASE WHEN least(t - 1, n - t) >= floor((q - 1) / 2) THEN ceil((q - 1) / 2) ELSE q - 1 - least(t - 1, n - t) END, 1) * (1 + 1e-9) AS reach FROM {name}_q),
{name}_w AS (SELECT r.series_id, r.t, CAST(s.t - r.t AS DOUBLE) AS x, s.{y} AS y, pow(greatest(1 - pow(abs(s.t - r.t) / r.reach, 3), 0), 3) AS w FROM {name}_r r JOIN {source} s ON s.series_id = r.series_id AND abs(s.t - r.t) <= r.q),
{name} AS (SELECT series_id, t, CASE WHEN sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x) > 1e-12 THEN (sum(w * x * x) * sum(w * y) - sum(w * x) * sum(w * x * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) ELSE sum(w * y) / sum(w) END AS f FROM {name}_w GROUP BY 1, 2)"""


@query("loess_trend", f"WITH {obs_sql('D_event')}, al AS (SELECT series_id, t, y, count(*) {_B} AS n FROM obs), {_loess_sql('al', 'y', 'lo')} SELECT series_id, t, round(f, 6) AS trend FROM lo")
def _(spark, d):
    made = packed(series(spark, d, "D_event")).withColumn("f", L.loess(F.col("ys"), _SPAN))
    return made.select("series_id", F.posexplode("f").alias("i", "f")).select("series_id", (F.col("i") + 1).cast("long").alias("t"), r6("f").alias("trend"))


#: Tables d2: (series_id, t, n, y, trend), and q2: (series_id, phase, s), of the decomposition below.
_STL = f"""WITH RECURSIVE {obs_sql('D_event')}, al AS (SELECT series_id, t, y, count(*) {_B} AS n FROM obs), {_loess_sql('al', 'y', 'l1')}, d1 AS (SELECT a.*, a.y - l.f AS r FROM al a JOIN l1 l ON l.series_id = a.series_id AND l.t = a.t),
p1 AS (SELECT series_id, (t - 1) % 7 AS phase, avg(r) AS p FROM d1 GROUP BY 1, 2), s1 AS (SELECT a.*, a.y - (p.p - q.p) AS z FROM al a JOIN p1 p ON p.series_id = a.series_id AND p.phase = (a.t - 1) % 7 JOIN (SELECT series_id, avg(p) AS p FROM p1 GROUP BY 1) q ON q.series_id = a.series_id),
{_loess_sql('s1', 'z', 'l2')}, d2 AS (SELECT a.*, l.f AS trend, a.y - l.f AS r FROM al a JOIN l2 l ON l.series_id = a.series_id AND l.t = a.t), p2 AS (SELECT series_id, (t - 1) % 7 AS phase, avg(r) AS p FROM d2 GROUP BY 1, 2), q2 AS (SELECT *, p - avg(p) {_B} AS s FROM p2)"""


def decomposed(packs: DataFrame, m: int, span: float = _SPAN) -> DataFrame:
    """Adds trend, a value for each point, and s, one for each phase: a periodic season and a local trend, taken out of each other twice."""
    def season(rest: Column) -> Column:
        means = R.let(rest, lambda r: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: R.mean_of(F.transform(F.sequence(p, F.size(r) - 1, F.lit(m)), lambda j: F.get(r, j)))))
        return R.let(means, lambda x: R.let(R.mean_of(x), lambda level: F.transform(x, lambda v: v - level)))

    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    own = packs.withColumn("trend", L.loess(F.col("ys"), span)).withColumn("s", season(less("ys", "trend")))
    clear = R.let(F.col("s"), lambda s: F.transform("ys", lambda y, i: y - F.get(s, i % m)))
    return own.withColumn("trend", L.loess(clear, span)).withColumn("s", season(less("ys", "trend")))


@query("stl_loess", _STL + " SELECT d.series_id, d.t, round(d.trend, 6) AS trend, round(q.s, 6) AS seasonal, round(d.y - d.trend - q.s, 6) AS remainder FROM d2 d JOIN q2 q ON q.series_id = d.series_id AND q.phase = (d.t - 1) % 7")
def _(spark, d):
    own = decomposed(packed(series(spark, d, "D_event")), 7)
    rows = own.select("series_id", "s", F.posexplode(F.arrays_zip("ys", "trend")).alias("i", "x")).withColumn("seasonal", F.get("s", F.col("i") % 7))
    return rows.select("series_id", (F.col("i") + 1).cast("long").alias("t"), r6("x.trend").alias("trend"), r6("seasonal").alias("seasonal"), r6(F.col("x.ys") - F.col("x.trend") - F.col("seasonal")).alias("remainder"))


@query(
    "stl_forecast",
    _STL + """, ad AS (SELECT d.series_id, d.t, d.n, d.y - q.s AS z FROM d2 d JOIN q2 q ON q.series_id = d.series_id AND q.phase = (d.t - 1) % 7), rc(series_id, t, n, l) AS (SELECT series_id, t, n, z FROM ad WHERE t = 1 UNION ALL SELECT r.series_id, a.t, a.n, 0.3 * a.z + 0.7 * r.l FROM rc r JOIN ad a ON a.series_id = r.series_id AND a.t = r.t + 1)
SELECT r.series_id, CAST(s.step AS BIGINT) AS step, round(r.l + q.s, 6) AS mean FROM rc r JOIN (SELECT unnest(range(1, 8)) AS step) s ON true JOIN q2 q ON q.series_id = r.series_id AND q.phase = (r.n + s.step - 1) % 7 WHERE r.t = r.n""",
)
def _(spark, d):
    """The series without its season is smoothed with level weight 0.3, and the season put back."""
    own = decomposed(packed(series(spark, d, "D_event")), 7)

    def ahead(s: Column) -> Column:
        level = R.ses_level(F.transform("ys", lambda y, i: y - F.get(s, i % 7)), 0.3)
        return R.let(level, lambda v: F.transform(M.steps_of(7), lambda k: v + F.get(s, ((F.col("n") + k - 1) % 7).cast("int"))))

    return _steps(own.withColumn("f", R.let(F.col("s"), ahead)))


_CES = [(a, b) for a in (0.8, 1.0, 1.2, 1.4) for b in (0.9, 1.0, 1.1)]


@query(
    "ces",
    f"""WITH RECURSIVE {obs_sql(MAIN)}, al AS (SELECT *, count(*) {_B} - 18 AS n FROM obs), tr AS (SELECT * FROM al WHERE t <= n),
rc(series_id, a, b, t, n, l, c, f, sse) AS (SELECT r.series_id, g.a, g.b, 0::BIGINT, r.n, r.y, r.y, 0.0::DOUBLE, 0.0::DOUBLE FROM tr r, (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _CES)}) g(a, b) WHERE r.t = 1
UNION ALL SELECT series_id, a, b, t, n, l - (1 - b) * c + (a - b) * e, l + (1 - a) * c + (a + b) * e, l, sse + e * e FROM (SELECT r.series_id, r.a, r.b, r.t + 1 AS t, r.n, r.l, r.c, r.sse, coalesce(o.y - r.l, 0) AS e FROM rc r LEFT JOIN tr o ON o.series_id = r.series_id AND o.t = r.t + 1 WHERE r.t < r.n + 18)),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(sse, 9), a, b) AS k FROM rc WHERE t = n) WHERE k = 1)
SELECT r.series_id, r.a, r.b, CAST(r.t - r.n AS BIGINT) AS step, round(r.f, 6) AS mean FROM rc r JOIN be ON be.series_id = r.series_id AND be.a = r.a AND be.b = r.b WHERE r.t > r.n""",
)
def _(spark, d):
    """Complex exponential smoothing without season, with the parameter of a grid that has the least squared error."""
    menu = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _CES])
    fits = F.transform(menu, lambda g: R.let(L.complex_run(F.col("train"), 18, g["a"], g["b"]), lambda x: F.struct(F.round(x["sse"], 9).alias("sse"), g["a"].alias("a"), g["b"].alias("b"), x["f"].alias("f"))))
    return _steps(split(packed(series(spark, d, MAIN)), 18).withColumn("x", F.array_min(fits)).select("series_id", "x.a", "x.b", "x.f"), "a", "b")


def _lags_sql(x: str) -> str:
    """Tables lg: (series_id, c, a1, a2, a3) and rc: forecasts, from a table x of (series_id, t, n, y)."""
    pairs = [(j, k) for j in range(4) for k in range(j, 4)]
    cov = lambda j, k: f"(m{min(j, k)}{max(j, k)} - m{j} * m{k} / z)"
    m = [[cov(j, k) for k in (1, 2, 3)] for j in (1, 2, 3)]
    v = [cov(0, k) for k in (1, 2, 3)]
    det = lambda a: f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"
    put = lambda k: [[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return f"""w AS (SELECT series_id, t, n, y AS y0, lag(y) OVER o AS y1, lag(y, 2) OVER o AS y2, lag(y, 3) OVER o AS y3 FROM {x} WINDOW o AS (PARTITION BY series_id ORDER BY t)),
sm AS (SELECT series_id, count(*) AS z, {", ".join(f"sum(y{k}) AS m{k}" for k in range(4))}, {", ".join(f"sum(y{j} * y{k}) AS m{j}{k}" for j, k in pairs)} FROM w WHERE y3 IS NOT NULL GROUP BY 1),
so AS (SELECT *, {", ".join(f"{det(put(k))} / nullif({det(m)}, 0) AS a{k + 1}" for k in range(3))} FROM sm), lg AS (SELECT series_id, (m0 - a1 * m1 - a2 * m2 - a3 * m3) / z AS c, a1, a2, a3 FROM so),
rc(series_id, step, p1, p2, p3) AS (SELECT w.series_id, 0::BIGINT, w.y0, w.y1, w.y2 FROM w WHERE w.t = w.n UNION ALL SELECT r.series_id, r.step + 1, l.c + l.a1 * r.p1 + l.a2 * r.p2 + l.a3 * r.p3, r.p1, r.p2 FROM rc r JOIN lg l ON l.series_id = r.series_id WHERE r.step < 18)"""


@query("nn_mlp_bench", f"WITH RECURSIVE {obs_sql(MAIN)}, al AS (SELECT series_id, t, y, count(*) {_B} - 18 AS n FROM obs), x AS (SELECT * FROM al WHERE t <= n), {_lags_sql('x')} SELECT series_id, step, round(p1, 6) AS mean FROM rc WHERE step > 0")
def _(spark, d):
    """A net with an identity activation is linear in its three lags: this is the fit that its training tends to, fed back."""
    made = split(packed(series(spark, d, MAIN)), 18)
    return _steps(made.withColumn("f", L.fed_back(F.col("train"), L.linear_lags(F.col("train")), 18)))


@query(
    "rec_ml_mlp",
    f"WITH RECURSIVE {obs_sql(MAIN)}{_frame(12, 18)}, ld AS (SELECT series_id, regr_intercept(y, t) AS i0, regr_slope(y, t) AS s0 FROM des GROUP BY 1), x AS (SELECT d.series_id, d.t, d.n, d.y - (l.i0 + l.s0 * d.t) AS y FROM des d JOIN ld l ON l.series_id = d.series_id), {_lags_sql('x')}, "
    "tp AS (SELECT series_id, max(y) AS top, max(n) AS n FROM tr GROUP BY 1), ff AS (SELECT r.series_id, r.step, greatest((r.p1 + l.i0 + l.s0 * (t.n + r.step)) * o.ix, 0) AS f, t.top FROM rc r JOIN ld l ON l.series_id = r.series_id JOIN tp t ON t.series_id = r.series_id JOIN oi o ON o.series_id = r.series_id AND o.step = r.step WHERE r.step > 0) "
    "SELECT series_id, step, round(CASE WHEN f > 1000 * top THEN top ELSE f END, 6) AS mean FROM ff",
)
def _(spark, d):
    """Without season and line, three lags fed back, then both put back; no forecast below zero, or over 1000 times the largest value."""
    prepared = M.prepare(series(spark, d, MAIN), 12, 18).withColumn("line", M.line_of(F.col("des")))
    line = lambda t: F.col("line.intercept") + F.col("line.slope") * t
    prepared = prepared.withColumn("rest", F.transform("des", lambda y, i: y - line(i + 1)))
    prepared = prepared.withColumn("a", L.fed_back(F.col("rest"), L.linear_lags(F.col("rest")), 18))
    made = F.transform("a", lambda f, i: F.greatest((f + line(F.col("n") + i + 1)) * F.get("out", i), F.lit(0.0)))
    return _steps(prepared.withColumn("f", F.transform(made, lambda f: F.when(f > 1000 * F.array_max("train"), F.array_max("train")).otherwise(f))))


_TOP = f", top AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(smape, 9), model) AS k FROM er WHERE model IN {_SIX}) SELECT f.series_id, CAST(f.step AS BIGINT) AS step, 'three of seven' AS method, round(avg(f.f), 6) AS mean FROM fc f JOIN top t ON t.series_id = f.series_id AND t.model = f.model AND t.k <= 3 GROUP BY 1, 2"


_NLS = f"""hl0(series_id, t, l, b) AS (SELECT d.series_id, 1::BIGINT, d.y, e.y - d.y FROM ser d JOIN ser e ON e.series_id = d.series_id AND e.t = 2 WHERE d.t = 1 UNION ALL SELECT o.series_id, d.t, 0.3 * d.y + 0.7 * (o.l + 0.9 * o.b), 0.1 * (0.3 * d.y + 0.7 * (o.l + 0.9 * o.b) - o.l) + 0.9 * 0.9 * o.b FROM hl0 o JOIN ser d ON d.series_id = o.series_id AND d.t = o.t + 1),
rv AS (SELECT series_id, max(n) {_B} + 1 - t AS t, y, n FROM ser), hb0(series_id, t, l, b) AS (SELECT d.series_id, 1::BIGINT, d.y, e.y - d.y FROM rv d JOIN rv e ON e.series_id = d.series_id AND e.t = 2 WHERE d.t = 1 UNION ALL SELECT o.series_id, d.t, 0.3 * d.y + 0.7 * (o.l + 0.9 * o.b), 0.1 * (0.3 * d.y + 0.7 * (o.l + 0.9 * o.b) - o.l) + 0.9 * 0.9 * o.b FROM hb0 o JOIN rv d ON d.series_id = o.series_id AND d.t = o.t + 1),
xs AS (SELECT s.series_id, list(s.y ORDER BY s.t) AS ys, max(s.n) AS n FROM ser s GROUP BY 1), x0 AS (SELECT x.series_id, x.n, list_concat(list_concat([b.l + 0.9 * b.b], x.ys), [a.l + 0.9 * a.b]) AS xs FROM xs x JOIN hl0 a ON a.series_id = x.series_id AND a.t = x.n JOIN hb0 b ON b.series_id = x.series_id AND b.t = x.n),
st(series_id, n, k, xs, go) AS (SELECT series_id, n, 0, xs, true FROM x0 UNION ALL SELECT series_id, n, k + 1, CASE WHEN top >= 1 THEN list_transform(range(1, n + 3), lambda i: CASE WHEN i = place + 1 THEN (xs[i] + (xs[i - 1] + xs[i + 1]) / 2) / 2 ELSE xs[i] END) ELSE xs END, top >= 1 FROM
 (SELECT *, list_max(lv) AS top, list_position(lv, list_max(lv)) AS place FROM (SELECT *, list_transform(range(2, n + 2), lambda i: round(abs(300 * (xs[i + 1] + xs[i - 1] - 2 * xs[i]) / (xs[i + 1] + xs[i - 1] + xs[i])), 9)) AS lv FROM st WHERE go))),
sm0 AS (SELECT series_id, n, max_by(xs, k) AS xs FROM st GROUP BY 1, 2), nls AS (SELECT series_id, n, CAST(u.t AS BIGINT) AS t, CASE WHEN xs[u.t + 1] <= 0 THEN 1.0 ELSE xs[u.t + 1] END AS y FROM sm0 JOIN (SELECT unnest(range(1, 2000)) AS t) u ON u.t <= n)"""


def settled(rows: DataFrame, ys: Column) -> DataFrame:
    """rows with s: the series smoothed at its roughest points, a damped forecast behind it and one of the reversed series before."""
    one = lambda xs: F.get(M.holt(xs, 0.3, 0.1, 1, 0.9), F.lit(0))
    return L.settle(rows, ys, one(F.reverse(ys)), one(ys), "s")


@query("smooth_nls_max", f"WITH RECURSIVE {obs_sql('Y_nation')}, ser AS (SELECT series_id, t, y * 100 AS y, count(*) {_B} AS n FROM obs), {_NLS} SELECT series_id, t, round(y, 6) AS smooth FROM nls")
def _(spark, d):
    own = packed(series(spark, d, "Y_nation").withColumn("y", F.col("y") * 100))
    made = settled(own, F.col("ys")).select("series_id", F.posexplode("s").alias("i", "s"))
    return made.select("series_id", (F.col("i") + 1).cast("long").alias("t"), r6("s").alias("smooth"))


def exponential_theta(ys: Column, h: int) -> Column:
    """Additive theta on an exponential curve, with theta 2 and level weight 0.3; the values must be positive."""
    def ahead(x: Column) -> Column:
        curve = lambda t: F.exp(x["line"]["intercept"] + x["line"]["slope"] * t)
        level = R.ses_level(F.transform(x["ys"], lambda y, i: 2 * y - curve(i + 1)), 0.3)
        return R.let(level, lambda v: F.transform(M.steps_of(h), lambda s: (v + curve(F.size(x["ys"]) + s)) / 2))

    with_line = lambda y: R.let(M.line_of(F.transform(y, lambda v: F.ln(v))), lambda line: F.struct(y.alias("ys"), line.alias("line")))
    return R.let(R.let(ys, with_line), ahead)


@query(
    "hybrid_theta",
    f"""WITH RECURSIVE {obs_sql('Y_nation')}, ser AS (SELECT series_id, t, y * 100 AS y, count(*) {_B} AS n FROM obs), {_NLS},
lx AS (SELECT series_id, regr_intercept(ln(y), t) AS a, regr_slope(ln(y), t) AS b FROM nls GROUP BY 1), zz AS (SELECT s.series_id, s.t, s.n, 2 * s.y - exp(l.a + l.b * s.t) AS z FROM nls s JOIN lx l ON l.series_id = s.series_id),
rs(series_id, t, n, l) AS (SELECT series_id, t, n, z FROM zz WHERE t = 1 UNION ALL SELECT r.series_id, z.t, z.n, 0.3 * z.z + 0.7 * r.l FROM rs r JOIN zz z ON z.series_id = r.series_id AND z.t = r.t + 1)
SELECT r.series_id, CAST(s.step AS BIGINT) AS step, round((r.l + exp(l.a + l.b * (r.n + s.step))) / 2, 6) AS mean FROM rs r JOIN lx l ON l.series_id = r.series_id, (SELECT unnest([1, 2]) AS step) s WHERE r.t = r.n""",
)
def _(spark, d):
    """Yearly series, which have no season to shrink: smoothed at the roughest points, then theta on an exponential curve."""
    own = settled(packed(series(spark, d, "Y_nation").withColumn("y", F.col("y") * 100)), F.col("ys"))
    return _steps(own.withColumn("f", exponential_theta(F.col("s"), 2)))


@query("hybrid_theta_seasonal")
def _(spark, d):
    """Monthly series with the chosen shrinkage of their season taken out before, and put back behind."""
    obs = series(spark, d, MAIN).withColumn("y", F.col("y") * 100)
    shrunk = S.chosen_shrinkage(S.shrink(S.trimmed_indices(obs, 12), 12)).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("phase", "shrunk"))), lambda x: x["shrunk"]).alias("si"))
    own = settled(packed(obs).join(shrunk, "series_id"), F.transform("ys", lambda y, i: F.try_divide(y, F.get("si", i % 12))))
    back = F.zip_with(exponential_theta(F.col("s"), 18), F.transform(M.steps_of(18), lambda s: F.get("si", ((F.col("n") + s - 1) % 12).cast("int"))), lambda f, x: f * x)
    return _steps(own.withColumn("f", back))


def _ble_sql(name: str, h: int, most: int) -> str:
    return f"WITH {obs_sql(name)}, al AS (SELECT *, count(*) {_B} AS n FROM obs), cut AS (SELECT series_id, t, y, n FROM al WHERE t > n - {most}), la AS (SELECT series_id, max_by(y, t) AS last FROM cut GROUP BY 1), sl AS (SELECT c.series_id, max(l.last) AS last, median((l.last - c.y) / (c.n - c.t)) AS b FROM cut c JOIN la l ON l.series_id = c.series_id WHERE c.t < c.n GROUP BY 1) SELECT series_id, CAST(step AS BIGINT) AS step, round(last + step * b, 6) AS mean FROM sl, (SELECT unnest(range(1, {h + 1})) AS step)"


for _key, _name in (("rec_225_d", "D_event"), ("rec_225_y", "Y_nation"), ("rec_225_w", "W_priority"), ("rec_225_m", "M_segment")):

    @query(_key, _ble_sql(_name, SPECS[_name].h, 10 * SPECS[_name].h))
    def _(spark, d, name=_name):
        """Bunch lines through the last ten horizons."""
        s = SPECS[name]
        own = packed(series(spark, d, name)).withColumn("ys", F.slice("ys", F.greatest(F.size("ys") - 10 * s.h + 1, F.lit(1)), 10 * s.h))
        return _steps(own.withColumn("f", M.bunch_line(F.col("ys"), s.h)))


_POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query(
    "rec_260",
    f"""WITH RECURSIVE {obs_sql('D_event')}{_frame(7, 7)}, ok AS (SELECT series_id FROM des GROUP BY 1 HAVING min(y) > 0), bc AS (SELECT d.series_id, g.p, d.t, d.n, ln(d.y) AS lg, CASE WHEN g.p = 0 THEN ln(d.y) ELSE (pow(d.y, g.p) - 1) / CASE WHEN g.p = 0 THEN 1 ELSE g.p END END AS x FROM des d JOIN ok ON ok.series_id = d.series_id, (VALUES {", ".join(f"({p}::DOUBLE)" for p in _POWERS)}) g(p)),
lk AS (SELECT series_id, p, round(count(*) / 2.0 * ln(var_pop(x)) - (p - 1) * sum(lg), 9) AS v FROM bc GROUP BY 1, 2), be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v, p) AS k FROM lk) WHERE k = 1),
sx AS (SELECT b.series_id, b.p, b.t, b.n, b.x FROM bc b JOIN be e ON e.series_id = b.series_id AND e.p = b.p), ls AS (SELECT series_id, regr_intercept(x, t) AS a, regr_slope(x, t) AS b FROM sx GROUP BY 1), zx AS (SELECT s.series_id, s.p, s.t, s.n, 2 * s.x - (l.a + l.b * s.t) AS z FROM sx s JOIN ls l ON l.series_id = s.series_id),
rx(series_id, p, t, n, l) AS (SELECT series_id, p, t, n, z FROM zx WHERE t = 1 UNION ALL SELECT r.series_id, z.p, z.t, z.n, 0.3 * z.z + 0.7 * r.l FROM rx r JOIN zx z ON z.series_id = r.series_id AND z.t = r.t + 1),
fx AS (SELECT r.series_id, r.p, o.step, o.ix, (r.l + l.a + l.b * (r.n + o.step)) / 2 AS f FROM rx r JOIN ls l ON l.series_id = r.series_id JOIN oi o ON o.series_id = r.series_id WHERE r.t = r.n)
SELECT series_id, p AS power, CAST(step AS BIGINT) AS step, round(greatest(CASE WHEN p = 0 THEN exp(f) ELSE pow(greatest(p * f + 1, 0), 1 / CASE WHEN p = 0 THEN 1 ELSE p END) END * ix, 0), 6) AS mean FROM fx""",
)
def _(spark, d):
    """Theta on powers of the deseasonalised values, the power from a grid by its likelihood; back in units, times the index, not below zero."""
    prepared = M.prepare(series(spark, d, "D_event"), 7, 7).where(F.forall("des", lambda y: y > 0))

    def likelihood(x: Column, p: float) -> Column:
        about = R.let(R.mean_of(x), lambda mean: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(x))
        logs = F.aggregate(F.transform("des", lambda y: F.ln(y)), F.lit(0.0), lambda a, v: a + v)
        return F.round(F.size(x) / 2 * F.ln(about) - (p - 1) * logs, 9)

    def powered(p: float) -> Column:
        return R.let(F.transform("des", lambda y: P.box_cox(y, p)), lambda x: F.struct(likelihood(x, p).alias("v"), F.lit(p).alias("p"), x.alias("x")))

    def theta_line(x: Column) -> Column:
        def ahead(line: Column) -> Column:
            level = R.ses_level(F.transform(x, lambda y, i: 2 * y - (line["intercept"] + line["slope"] * (i + 1))), 0.3)
            return R.let(level, lambda v: F.transform(M.steps_of(7), lambda s: (v + line["intercept"] + line["slope"] * (F.size(x) + s)) / 2))

        return R.let(M.line_of(x), ahead)

    def back(b: Column) -> Column:
        value = lambda f: F.when(b["p"] == 0, F.exp(f)).otherwise(F.pow(F.greatest(b["p"] * f + 1, F.lit(0.0)), 1 / F.when(b["p"] == 0, 1.0).otherwise(b["p"])))
        made = F.zip_with(R.let(b["x"], theta_line), "out", lambda f, ix: F.greatest(value(f) * ix, F.lit(0.0)))
        return F.struct(b["p"].alias("power"), made.alias("f"))

    found = prepared.withColumn("r", R.let(F.array_min(F.array(*[powered(p) for p in _POWERS])), back))
    return _steps(found.select("series_id", F.col("r.power").alias("power"), F.col("r.f").alias("f")), "power")


_MEDIANS = (("M", "M_segment"), ("Q", "Q_nation"), ("D", "D_event"))


@query("rec_072_final", " UNION ALL ".join(f"SELECT '{k}' AS period, * FROM ({oracle('SELECT series_id, CAST(step AS BIGINT) AS step, round(median(f), 6) AS mean FROM fc GROUP BY 1, 2', name)})" for k, name in _MEDIANS))
def _(spark, d):
    """The medians of the models of every period, one under the other."""
    parts = [E.combine(benchmark(spark, d, name)[0], "median").select(F.lit(k).alias("period"), "series_id", "step", r6("mean").alias("mean")) for k, name in _MEDIANS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CELLS = f"""WITH RECURSIVE {obs_sql('D_event')}, al AS (SELECT series_id, t, y, count(*) {_B} - 7 AS n FROM obs), tr AS (SELECT * FROM al WHERE t <= n), te AS (SELECT series_id, t - n AS step, y FROM al WHERE t > n), l0 AS (SELECT series_id, regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM tr GROUP BY 1),
dt AS (SELECT r.series_id, k.detrend, r.t, r.n, r.y - CASE WHEN k.detrend THEN l.a + l.b * r.t ELSE 0 END AS y FROM tr r JOIN l0 l ON l.series_id = r.series_id, (VALUES (false), (true)) k(detrend)),
df AS (SELECT series_id, detrend, false AS diff, t, n, y FROM dt UNION ALL SELECT series_id, detrend, true, t - 1, n - 1, y - before FROM (SELECT *, lag(y) OVER (PARTITION BY series_id, detrend ORDER BY t) AS before FROM dt) WHERE t > 1),
rs(series_id, detrend, diff, t, n, l) AS (SELECT series_id, detrend, diff, t, n, y FROM df WHERE t = 1 UNION ALL SELECT r.series_id, r.detrend, r.diff, d.t, d.n, 0.3 * d.y + 0.7 * r.l FROM rs r JOIN df d ON d.series_id = r.series_id AND d.detrend = r.detrend AND d.diff = r.diff AND d.t = r.t + 1),
me AS (SELECT series_id, detrend, diff, 'last' AS method, y AS f FROM df WHERE t = n UNION ALL SELECT series_id, detrend, diff, 'mean', avg(y) FROM df GROUP BY 1, 2, 3 UNION ALL SELECT series_id, detrend, diff, 'smooth', l FROM rs WHERE t = n),
fo AS (SELECT m.series_id, m.method, m.detrend, m.diff, e.step, e.y, CASE WHEN m.diff THEN x.y + e.step * m.f ELSE m.f END + CASE WHEN m.detrend THEN l.a + l.b * (x.n + e.step) ELSE 0 END AS f, w.y AS last FROM me m JOIN te e ON e.series_id = m.series_id JOIN l0 l ON l.series_id = m.series_id JOIN dt x ON x.series_id = m.series_id AND x.detrend = m.detrend AND x.t = x.n JOIN tr w ON w.series_id = m.series_id AND w.t = w.n)
SELECT series_id, method, detrend, diff, round(avg((y - f) * (y - f)) / (0.0001 + avg((y - last) * (y - last))), 6) AS nmse FROM fo GROUP BY 1, 2, 3, 4"""


@query("calibrate_grid", _CELLS)
def _(spark, d):
    """Every cell of method, line taken out or not, differences or not: its squared error on the holdout over that of naive."""
    own = split(packed(series(spark, d, "D_event")), 7).withColumn("line", M.line_of(F.col("train"))).withColumn("detrend", F.explode(F.array(F.lit(False), F.lit(True))))
    line = lambda t: F.when(F.col("detrend"), F.col("line.intercept") + F.col("line.slope") * t).otherwise(F.lit(0.0))
    own = own.withColumn("ys", F.transform("train", lambda y, i: y - line(i + 1))).withColumn("diff", F.explode(F.array(F.lit(False), F.lit(True))))
    steps = F.zip_with(F.slice("ys", 2, F.size("ys") - 1), F.slice("ys", 1, F.size("ys") - 1), lambda a, b: a - b)
    own = own.withColumn("xs", F.when(F.col("diff"), steps).otherwise(F.col("ys")))
    flat = F.array(F.struct(F.lit("last").alias("method"), F.element_at("xs", -1).alias("f")), F.struct(F.lit("mean").alias("method"), R.mean_of(F.col("xs")).alias("f")), F.struct(F.lit("smooth").alias("method"), R.ses_level(F.col("xs"), 0.3).alias("f")))
    rows = own.withColumn("end", F.element_at("ys", -1)).withColumn("last", F.element_at("train", -1)).withColumn("m", F.explode(flat)).select("series_id", "n", "line", "detrend", "diff", "end", "last", "m.*", F.posexplode("test").alias("i", "y"))
    f = F.when(F.col("diff"), F.col("end") + (F.col("i") + 1) * F.col("f")).otherwise(F.col("f")) + line(F.col("n") + F.col("i") + 1)
    square = lambda a: F.avg((F.col("y") - a) * (F.col("y") - a))
    return rows.withColumn("g", f).groupBy("series_id", "method", "detrend", "diff").agg(r6(square(F.col("g")) / (1e-4 + square(F.col("last")))).alias("nmse"))
