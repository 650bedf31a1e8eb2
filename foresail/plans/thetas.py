"""Queries on theta models of every kind and on ATA models."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6
from ..operators import models as M
from ..operators import theta as T
from ..registry import query
from ..sources.series import SPECS, obs_sql, packed, series, split
from .forecasting import MAIN, _frame

_ROWS = "PARTITION BY series_id, season"


def variants_sql(name: str, thetas: tuple[float, ...], test: bool = True) -> str:
    """Common table expressions up to `fit`: each variant and theta with the smoothing that fits its line best."""
    s = SPECS[name]
    numbers = lambda xs: ", ".join(f"({x}::DOUBLE)" for x in xs)
    return f"""WITH RECURSIVE {obs_sql(name)}{_frame(s.m, s.h, test)},
pa AS (SELECT series_id, (t - 1) % {s.m} AS phase, avg(y - trend) AS p FROM ma GROUP BY 1, 2), ia AS (SELECT series_id, phase, p - avg(p) OVER (PARTITION BY series_id) AS ix FROM pa),
se AS (SELECT f.series_id, f.n, v.season FROM sf f JOIN (VALUES ('N'), ('M'), ('A')) v(season) ON (v.season <> 'N') = f.seasonal),
pl AS (SELECT e.series_id, e.season, e.n, p.t, r.y, CASE e.season WHEN 'M' THEN i.ix WHEN 'A' THEN a.ix ELSE 0.0 END AS s FROM se e JOIN (SELECT unnest(range(1, 2000)) AS t) p ON p.t <= e.n + {s.h}
  LEFT JOIN tr r ON r.series_id = e.series_id AND r.t = p.t LEFT JOIN ix0 i ON i.series_id = e.series_id AND i.phase = (p.t - 1) % {s.m} LEFT JOIN ia a ON a.series_id = e.series_id AND a.phase = (p.t - 1) % {s.m}),
dd AS (SELECT *, CASE season WHEN 'M' THEN y / s WHEN 'A' THEN y - s ELSE y END AS d FROM pl), po AS (SELECT series_id, season, bool_and(d > 0) AS pos FROM dd WHERE t <= n GROUP BY 1, 2),
cu AS (SELECT d.*, o.pos, c.curve, c.curve = 'Exp' AND o.pos AS bent FROM dd d JOIN po o ON o.series_id = d.series_id AND o.season = d.season, (VALUES ('Lrl'), ('Exp')) c(curve)),
ol AS (SELECT series_id, season, curve, regr_slope(CASE WHEN bent THEN ln(CASE WHEN d > 0 THEN d ELSE 1 END) ELSE d END, t) AS b, regr_intercept(CASE WHEN bent THEN ln(CASE WHEN d > 0 THEN d ELSE 1 END) ELSE d END, t) AS a FROM cu WHERE t <= n GROUP BY 1, 2, 3),
l0 AS (SELECT c.*, CASE WHEN bent THEN exp(a + b * t) ELSE a + b * t END AS l0 FROM cu c JOIN ol o ON o.series_id = c.series_id AND o.season = c.season AND o.curve = c.curve),
vr AS (SELECT *, pos AND bool_and(l0 > 0) OVER ({_ROWS}, curve) AS plus FROM l0),
zz AS (SELECT v.*, m.model, h.theta, m.model = 'M' AND v.plus AS product, CASE WHEN m.model = 'M' AND v.plus THEN exp(h.theta * ln(CASE WHEN d > 0 THEN d ELSE 1 END) + (1 - h.theta) * ln(CASE WHEN l0 > 0 THEN l0 ELSE 1 END)) ELSE h.theta * d + (1 - h.theta) * l0 END AS z
  FROM vr v, (VALUES ('M'), ('A')) m(model), (VALUES {numbers(thetas)}) h(theta)),
rc(series_id, season, curve, model, theta, alpha, t, n, level, sse, ae) AS (
  SELECT series_id, season, curve, model, theta, a.alpha, 0::BIGINT, n, z, 0.0::DOUBLE, 0.0::DOUBLE FROM zz, (VALUES {numbers(T.ALPHAS)}) a(alpha) WHERE t = 1
  UNION ALL SELECT r.series_id, r.season, r.curve, r.model, r.theta, r.alpha, z.t, r.n, r.alpha * z.z + (1 - r.alpha) * r.level, r.sse + (z.z - r.level) * (z.z - r.level), r.ae + abs(z.y - {_join("z.product", "r.level", "z.l0", "z.s", "r.theta", "r.season")})
  FROM rc r JOIN zz z ON z.series_id = r.series_id AND z.season = r.season AND z.curve = r.curve AND z.model = r.model AND z.theta = r.theta AND z.t = r.t + 1 WHERE r.t < r.n),
fa AS (SELECT *, row_number() OVER ({_ROWS}, curve, model, theta ORDER BY round(sse, 9), alpha) AS k FROM rc WHERE t = n), fit AS (SELECT *, round(ae / n, 9) AS mae FROM fa WHERE k = 1)"""


def _join(product: str, level: str, line: str, s: str, theta: str, season: str) -> str:
    f = f"CASE WHEN {product} THEN exp(ln(CASE WHEN {level} > 0 THEN {level} ELSE 1 END) / {theta} + (1 - 1 / {theta}) * ln(CASE WHEN {line} > 0 THEN {line} ELSE 1 END)) ELSE {level} / {theta} + (1 - 1 / {theta}) * {line} END"
    return f"CASE {season} WHEN 'M' THEN ({f}) * {s} WHEN 'A' THEN ({f}) + {s} ELSE {f} END"


def _ahead_sql(table: str) -> str:
    f = _join("f.model = 'M' AND v.plus", "f.level", "v.l0", "v.s", "f.theta", "f.season")
    return f"SELECT f.series_id, f.season, f.curve, f.model, f.theta, f.mae, CAST(v.t - f.n AS BIGINT) AS step, round(greatest({f}, 0), 6) AS mean FROM {table} f JOIN vr v ON v.series_id = f.series_id AND v.season = f.season AND v.curve = f.curve AND v.t > f.n"


_BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, season = 'A', model = 'A', curve = 'Exp', theta) AS place FROM fit) WHERE place = 1) "
_SOME = (1.0, 2.0, 3.0)


@query("theta_fit", variants_sql(MAIN, _SOME, False) + f" SELECT * EXCLUDE (mae) FROM ({_ahead_sql('fit')})")
def _(spark, d):
    """Every model, curve and season at given thetas; the season is taken whatever the test says."""
    s = SPECS[MAIN]
    rows = T.fitted(T.variants(split(packed(series(spark, d, MAIN)), s.h), s.m, s.h, -1.0), _SOME).withColumn("f", T.ahead_of(s.h))
    made = rows.select("series_id", "season", "curve", "model", "theta", F.posexplode("f").alias("i", "f"))
    return made.select("series_id", "season", "curve", "model", "theta", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


for _key, _name in (("four_theta", MAIN), ("four_theta_q_nation", "Q_nation"), ("rec_4theta", "D_event")):

    @query(_key, variants_sql(_name, T.THETAS) + _BEST + _ahead_sql("best").replace("f.mae", "round(f.mae, 6) AS mae"))
    def _(spark, d, name=_name):
        s = SPECS[name]
        best = T.four_theta(split(packed(series(spark, d, name)), s.h), s.m, s.h)
        made = best.select("series_id", "season", "curve", "model", "theta", "mae", F.posexplode("f").alias("i", "f"))
        return made.select("series_id", "season", "curve", "model", "theta", r6("mae").alias("mae"), (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


_CURVES = {"Lin": ("y", "t", "x"), "Exp": ("ln(y)", "t", "exp(x)"), "Log": ("y", "ln(t)", "x"), "Inv": ("y", "1.0 / t", "x"), "Pow": ("ln(y)", "ln(t)", "exp(x)")}


def _curves_sql() -> str:
    fits = " UNION ALL ".join(f"SELECT '{k}' AS curve, series_id, regr_intercept({y}, {x}) AS a, regr_slope({y}, {x}) AS b FROM tr GROUP BY 2" for k, (y, x, _) in _CURVES.items())
    value = " ".join(f"WHEN '{k}' THEN " + back.replace("x", f"(a + b * ({x}))") if back == "x" else f"WHEN '{k}' THEN exp(a + b * ({x}))" for k, (_, x, back) in _CURVES.items())
    return f"""WITH RECURSIVE {obs_sql('D_event')}, al AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, min(y) OVER (PARTITION BY series_id) AS low FROM obs), tr AS (SELECT * FROM al WHERE low > 0), cv AS ({fits}),
ns AS (SELECT DISTINCT series_id, n FROM tr), l0 AS (SELECT c.curve, c.series_id, n.n, CAST(p.t AS BIGINT) AS t, CASE c.curve {value} END AS l0 FROM cv c JOIN ns n ON n.series_id = c.series_id JOIN (SELECT unnest(range(1, 100)) AS t) p ON p.t <= n.n + 7),
zz AS (SELECT l.curve, l.series_id, l.t, 2 * r.y - l.l0 AS z FROM l0 l JOIN tr r ON r.series_id = l.series_id AND r.t = l.t),
rc(curve, series_id, t, level) AS (SELECT curve, series_id, t, z FROM zz WHERE t = 1 UNION ALL SELECT r.curve, r.series_id, z.t, 0.3 * z.z + 0.7 * r.level FROM rc r JOIN zz z ON z.curve = r.curve AND z.series_id = r.series_id AND z.t = r.t + 1)
SELECT l.curve, l.series_id, CAST(l.t - l.n AS BIGINT) AS step, round((r.level + l.l0) / 2, 6) AS mean FROM l0 l JOIN rc r ON r.curve = l.curve AND r.series_id = l.series_id AND r.t = l.n WHERE l.t > l.n"""


@query("theta_generalized", _curves_sql())
def _(spark, d):
    """Additive theta with five curves, theta 2 and level weight 0.3, for positive series."""
    own = packed(series(spark, d, "D_event")).where(F.forall("ys", lambda y: y > 0))
    places = F.sequence(F.lit(1).cast("long"), F.col("n") + 7)
    named = []
    for k, (y, x, back) in _CURVES.items():
        at = {"t": lambda t: t.cast("double"), "ln(t)": lambda t: F.ln(t.cast("double")), "1.0 / t": lambda t: 1.0 / t}[x]
        value = (lambda v: F.ln(v)) if y == "ln(y)" else (lambda v: v)
        line = M.line_through(F.transform("ys", lambda v, i: F.struct(at(i + 1).alias("x"), value(v).alias("y"))))  # noqa: B023
        made = R.let(line, lambda ab: F.transform(places, lambda t: ab["intercept"] + ab["slope"] * at(t)))  # noqa: B023
        named.append(F.struct(F.lit(k).alias("curve"), (F.transform(made, F.exp) if back == "exp(x)" else made).alias("l0")))
    rows = own.withColumn("c", F.explode(F.array(*named))).select("series_id", "n", "ys", "c.curve", "c.l0")
    level = R.ses_level(F.zip_with("ys", F.slice("l0", 1, F.col("n").cast("int")), lambda y, x: 2 * y - x), 0.3)
    fc = R.let(level, lambda v: F.transform(F.slice("l0", (F.col("n") + 1).cast("int"), 7), lambda x: (v + x) / 2))
    made = rows.select("curve", "series_id", F.posexplode(fc).alias("i", "f"))
    return made.select("curve", "series_id", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


def _ata_sql(source: str, phis: tuple[float, ...]) -> str:
    """Runs of ATA models over a table (series_id, t, n, x): `fr` and `fx`, the best with a free and with a fixed level weight, for both kinds."""
    a = "CASE WHEN s.t > r.p THEN r.p::DOUBLE / s.t ELSE 1.0 END"
    b = "CASE WHEN s.t > r.q THEN r.q::DOUBLE / s.t ELSE 1.0 END"
    seen = "CASE WHEN r.kind = 'M' THEN r.l * pow(r.b, r.phi) ELSE r.l + r.phi * r.b END"
    held = "CASE WHEN r.kind = 'M' THEN pow(r.b, r.phi) ELSE r.phi * r.b END"
    return f"""ok AS (SELECT series_id, min(x) AS low, max(n) AS n FROM {source} GROUP BY 1),
ru(series_id, kind, p, q, phi, t, l, b, ae) AS (SELECT s.series_id, k.kind, p.p, g.q, g.phi, s.t, s.x, CASE k.kind WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE, 0.0::DOUBLE
  FROM {source} s JOIN ok o ON o.series_id = s.series_id JOIN (VALUES ('A'), ('M')) k(kind) ON k.kind = 'A' OR o.low > 0 JOIN (SELECT CAST(unnest(range(1, 2000)) AS BIGINT) AS p) p ON p.p <= o.n, (VALUES (0, 1.0::DOUBLE), {", ".join(f"(1, {x}::DOUBLE)" for x in phis)}) g(q, phi) WHERE s.t = 1
  UNION ALL SELECT series_id, kind, p, q, phi, t, l2, CASE WHEN q = 0 THEN b ELSE bw * CASE WHEN kind = 'M' THEN l2 / nullif(l, 0) ELSE l2 - l END + (1 - bw) * held END, ae + abs(x - seen) FROM
  (SELECT *, aw * x + (1 - aw) * seen AS l2 FROM (SELECT r.series_id, r.kind, r.p, r.q, r.phi, s.t, r.l, r.b, r.ae, s.x, {a} AS aw, {b} AS bw, {seen} AS seen, {held} AS held FROM ru r JOIN {source} s ON s.series_id = r.series_id AND s.t = r.t + 1))),
en AS (SELECT r.*, round(r.ae, 9) AS cost FROM ru r JOIN ok o ON o.series_id = r.series_id AND o.n = r.t),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY cost, p, phi) AS k FROM en WHERE q = 1) WHERE k = 1),
p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY cost, p) AS k FROM en WHERE q = 0) WHERE k = 1),
fx AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.series_id, e.kind ORDER BY e.cost, e.phi) AS k FROM en e JOIN p0 z ON z.series_id = e.series_id AND z.kind = e.kind AND z.p = e.p WHERE e.q = 1) WHERE k = 1)"""


def _ata_far(h: int) -> str:
    return f"(SELECT f.*, s.step, list_sum(list_transform(range(1, s.step + 1), lambda k: pow(f.phi, k))) AS far FROM (SELECT *, 'free' AS weight FROM fr UNION ALL SELECT *, 'fixed' FROM fx) f, (SELECT CAST(unnest(range(1, {h + 1})) AS BIGINT) AS step) s)"


_ATA_MEAN = "greatest(CASE WHEN kind = 'M' THEN l * pow(b, far) ELSE l + far * b END, 0)"
_YEARLY = tuple(round(0.05 * k, 2) for k in range(1, 21))
_SEASONAL = (0.85, 0.9, 0.95, 1.0)


@query(
    "ata",
    f"WITH RECURSIVE {obs_sql('Y_nation')}, src AS (SELECT series_id, t, count(*) OVER (PARTITION BY series_id) AS n, y AS x FROM obs), {_ata_sql('src', (0.8, 0.9, 1.0))} "
    f"SELECT series_id, kind, weight, CAST(p AS BIGINT) AS p, phi, step, round({_ATA_MEAN}, 6) AS mean FROM {_ata_far(2)}",
)
def _(spark, d):
    """The four ATA models: trend added or multiplied, level weight free or fixed before the trend."""
    own = packed(series(spark, d, "Y_nation"))
    named = []
    for kind, weight in (("A", "free"), ("A", "fixed"), ("M", "free"), ("M", "fixed")):
        model = T.ata(F.col("ys"), (0.8, 0.9, 1.0), kind == "M", weight == "fixed")
        named.append(R.let(model, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), x["p"].alias("p"), x["phi"].alias("phi"), T.ata_ahead(x, 2, kind == "M").alias("f"))))  # noqa: B023
    rows = own.select("series_id", F.explode(F.array(*named)).alias("m")).select("series_id", "m.*").where("p is not null")
    made = rows.select("series_id", "kind", "weight", F.col("p").cast("long").alias("p"), "phi", F.posexplode("f").alias("i", "f"))
    return made.select("series_id", "kind", "weight", "p", "phi", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


@query(
    "rec_252_y",
    f"WITH RECURSIVE {obs_sql('Y_nation')}, al AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS big FROM obs), src AS (SELECT series_id, t, big - 2 AS n, y AS x FROM al WHERE t <= big - 2), {_ata_sql('src', _YEARLY)} "
    f"SELECT series_id, step, round({_ATA_MEAN}, 6) AS mean FROM {_ata_far(2)} WHERE kind = 'A' AND weight = 'free'",
)
def _(spark, d):
    """Yearly series: the additive model, damping from 0.05 to 1, no season, nothing below zero."""
    made = split(packed(series(spark, d, "Y_nation")), 2)
    return M.forecasts(made, {"ata": T.ata_ahead(T.ata(F.col("train"), _YEARLY), 2)}).select("series_id", "step", r6("mean").alias("mean"))


def ata_four(prepared, phis: tuple[float, ...], h: int):
    """(series_id, step, mean): the mean of the four ATA models of the deseasonalised values, with the season put back."""
    fits = {f"{k}{w}": T.ata_ahead(T.ata(F.col("des"), phis, k == "M", w == "fixed"), h, k == "M") for k in "AM" for w in ("free", "fixed")}
    fc = M.forecasts(prepared, {k: M.reseasoned(v) for k, v in fits.items()})
    return fc.groupBy("series_id", "step").agg(F.greatest(F.avg("mean"), F.lit(0.0)).alias("mean"))


for _key, _name in (("combine_ata4", "D_event"), ("rec_252_q_m_d", "Q_nation"), ("rec_252_m", "M_segment")):

    @query(
        _key,
        f"WITH RECURSIVE {obs_sql(_name)}{_frame(SPECS[_name].m, SPECS[_name].h).replace('1.645', '1.28')}, src AS (SELECT series_id, t, n, y AS x FROM des), {_ata_sql('src', _SEASONAL)} "
        f"SELECT a.series_id, a.step, round(greatest(avg({_ATA_MEAN} * o.ix), 0), 6) AS mean FROM {_ata_far(SPECS[_name].h)} a JOIN oi o ON o.series_id = a.series_id AND o.step = a.step GROUP BY 1, 2",
    )
    def _(spark, d, name=_name):
        s = SPECS[name]
        prepared = M.prepare(series(spark, d, name), s.m, s.h, critical=1.28)
        return ata_four(prepared, _SEASONAL, s.h).select("series_id", "step", r6("mean").alias("mean"))


#: Weekly series of fewer values have no season.
WEEKLY_LEAST = 104
_WEEKLY = SPECS["W_priority"]


@query(
    "rec_252_w",
    f"WITH RECURSIVE {obs_sql('W_priority')}{_frame(_WEEKLY.m, _WEEKLY.h, False).replace('coalesce(true, false)', f'coalesce(s.n >= {WEEKLY_LEAST}, false)').replace('CASE WHEN f.seasonal THEN i.ix', 'CASE WHEN f.seasonal AND min(i.ix) OVER (PARTITION BY i.series_id) > 0 THEN i.ix')}, src AS (SELECT series_id, t, n, y AS x FROM des), {_ata_sql('src', _SEASONAL)} "
    f"SELECT a.series_id, a.step, round(greatest(avg({_ATA_MEAN} * o.ix), 0), 6) AS mean FROM {_ata_far(_WEEKLY.h)} a JOIN oi o ON o.series_id = a.series_id AND o.step = a.step GROUP BY 1, 2",
)
def _(spark, d):
    """Weekly series: the mean of the four ATA models, with a season of 52 weeks whatever a test says, where there are two years.

    A series with a week that is always empty has no season, as its values can't be divided by it.
    """
    prepared = M.prepare(series(spark, d, "W_priority"), _WEEKLY.m, _WEEKLY.h, test=False)
    few = F.col("few")
    prepared = prepared.withColumn("few", (F.col("n") < WEEKLY_LEAST) | F.exists("des", lambda y: y.isNull()))
    prepared = prepared.withColumn("des", F.when(few, F.col("train")).otherwise(F.col("des"))).withColumn("out", F.when(few, F.array_repeat(F.lit(1.0), _WEEKLY.h)).otherwise(F.col("out")))
    return ata_four(prepared, _SEASONAL, _WEEKLY.h).select("series_id", "step", r6("mean").alias("mean"))


_DOTM = [(t, a) for t in (1.0, 1.5, 2.0, 3.0, 5.0) for a in T.ALPHAS]


_DOTM_SQL = f"""WITH RECURSIVE {obs_sql(MAIN)}, al AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM obs), tr AS (SELECT series_id, t, y, n - 18 AS n FROM al WHERE t <= n - 18),
rc(series_id, theta, alpha, t, n, l, a, b, m, f, sse) AS (SELECT r.series_id, g.theta, g.alpha, 0::BIGINT, r.n, r.y / g.theta, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM tr r, (VALUES {", ".join(f"({t}::DOUBLE, {a}::DOUBLE)" for t, a in _DOTM)}) g(theta, alpha) WHERE r.t = 1
UNION ALL SELECT series_id, theta, alpha, k, n, alpha * y + (1 - alpha) * l, m2 - (k + 1) / 2.0 * b2, b2, m2, mu, sse + CASE WHEN k BETWEEN 3 AND n THEN (y - mu) * (y - mu) ELSE 0 END FROM
(SELECT *, CASE WHEN k > 1 THEN 1.0::DOUBLE / (k + 1) * ((k - 2) * b + 6.0 / k * (y - m)) ELSE 0 END AS b2, 1.0::DOUBLE / k * ((k - 1) * m + y) AS m2 FROM
(SELECT *, coalesce(y0, mu) AS y FROM (SELECT r.*, r.t + 1 AS k, o.y AS y0, r.l + (1 - 1 / r.theta) * (pow(1 - r.alpha, r.t) * r.a + (1 - pow(1 - r.alpha, r.t + 1)) / r.alpha * r.b) AS mu FROM rc r LEFT JOIN tr o ON o.series_id = r.series_id AND o.t = r.t + 1 WHERE r.t < r.n + 18)))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(sse, 9), theta, alpha) AS k FROM rc WHERE t = n) WHERE k = 1)
"""


def _dynamic(spark, d):
    """(series_id, n, b): the fit of each series, struct(sse, theta, alpha, f)."""
    s = SPECS[MAIN]
    made = split(packed(series(spark, d, MAIN)), s.h)
    named = F.array(*[F.struct(F.lit(t).alias("theta"), F.lit(a).alias("alpha")) for t, a in _DOTM])
    fits = F.transform(named, lambda g: R.let(T.dynamic_run(F.col("train"), s.h, g["theta"], g["alpha"]), lambda x: F.struct(F.round(x["sse"], 9).alias("sse"), g["theta"].alias("theta"), g["alpha"].alias("alpha"), x["f"].alias("f"))))
    return made.select("series_id", "n", F.array_min(fits).alias("b"))


@query("dotm", _DOTM_SQL + " SELECT r.series_id, r.theta, r.alpha, CAST(r.t - r.n AS BIGINT) AS step, round(r.f, 6) AS mean FROM rc r JOIN best b ON b.series_id = r.series_id AND b.theta = r.theta AND b.alpha = r.alpha WHERE r.t > r.n")
def _(spark, d):
    """The dynamic theta model with theta and level weight from a grid; its line is estimated anew at every point."""
    rows = _dynamic(spark, d).select("series_id", "b.theta", "b.alpha", F.posexplode("b.f").alias("i", "f"))
    return rows.select("series_id", "theta", "alpha", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


#: Half of what a level of 97.5 % leaves out is above the interval.
_Z975 = NormalDist().inv_cdf(0.9875)


@query("rec_251", _DOTM_SQL + f" SELECT r.series_id, CAST(r.t - r.n AS BIGINT) AS step, round(r.f, 6) AS mean, round(r.f - {_Z975} * sqrt(b.sse / (r.n - 2) * (1 + (r.t - r.n - 1) * b.alpha * b.alpha)), 6) AS lower, round(r.f + {_Z975} * sqrt(b.sse / (r.n - 2) * (1 + (r.t - r.n - 1) * b.alpha * b.alpha)), 6) AS upper FROM rc r JOIN best b ON b.series_id = r.series_id AND b.theta = r.theta AND b.alpha = r.alpha WHERE r.t > r.n")
def _(spark, d):
    """The dynamic theta model with bounds of 97.5 %: the errors of its level grow as those of smoothing do."""
    rows = _dynamic(spark, d).select("series_id", "n", "b.sse", "b.alpha", F.posexplode("b.f").alias("i", "f"))
    wide = _Z975 * F.sqrt(F.col("sse") / (F.col("n") - 2) * (1 + F.col("i") * F.col("alpha") * F.col("alpha")))
    return rows.select("series_id", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"), r6(F.col("f") - wide).alias("lower"), r6(F.col("f") + wide).alias("upper"))
