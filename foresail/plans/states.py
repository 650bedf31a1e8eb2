"""Queries on state space models and on seasons found by phase."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import states as S
from ..registry import query
from ..sources.series import SPECS, obs_sql, packed, series, split
from . import linear_sql as L


def _train(name: str, h: int, shift: float = 0.0) -> str:
    return f"{obs_sql(name)}, tr AS (SELECT series_id, max(n) AS n, list(y + {shift} ORDER BY t) AS ys FROM (SELECT *, count(*) OVER (PARTITION BY series_id) - {h} AS n FROM obs) WHERE t <= n GROUP BY 1)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT" for v in r) + ")" for r in rows)


def _steps(h: int) -> str:
    return f"(SELECT CAST(unnest(range(1, {h + 1})) AS BIGINT) AS step) u"


def _fold(over: str, state: dict[str, tuple[str, str]], start: dict[str, str]) -> str:
    """A fold over a list of numbers, in the field y of structs: state maps a field to its type and its next value."""
    empty = ", ".join(f"'{k}': NULL::{t}" for k, (t, _) in state.items())
    step = ", ".join(f"'{k}': {e}" for k, (_, e) in state.items())
    first = ", ".join(f"'{k}': ({start[k]})::{t}" for k, (t, _) in state.items())
    return f"list_reduce(list_transform({over}, lambda v0: {{{empty}, 'y': v0}}), lambda c, x: {{{step}, 'y': x.y}}, {{{first}, 'y': NULL::DOUBLE}})"


def tbats_sql(name: str) -> str:
    s = SPECS[name]
    lam = lambda j: f"{2 * math.pi / s.m!r} * {j}"
    harmonics = lambda t: f"flatten(list_transform(range(1, k + 1), lambda j: [sin({lam('j')} * {t}), cos({lam('j')} * {t})]))"
    pairs = sorted({(w, k) for w, _, k, _, _ in S.TBATS})
    ts = f"list_transform(c.s, lambda q, j: q * cos({lam('j')}) + c.z[j] * sin({lam('j')}))"
    tz = f"list_transform(c.z, lambda q, j: q * cos({lam('j')}) - c.s[j] * sin({lam('j')}))"
    e = f"(x.y - c.l - phi * c.b - coalesce(list_sum({ts}), 0.0))"
    beta = f"(CASE WHEN phi > 0 THEN {S.TREND} ELSE 0.0 END)"
    state = {
        "l": ("DOUBLE", f"c.l + phi * c.b + a * {e}"), "b": ("DOUBLE", f"phi * c.b + {beta} * {e}"),
        "s": ("DOUBLE[]", f"list_transform({ts}, lambda q2: q2 + g * {e})"), "z": ("DOUBLE[]", f"list_transform({tz}, lambda q2: q2 + g * {e})"), "sse": ("DOUBLE", f"c.sse + {e} * {e}"),
    }
    start = {"l": "cf[1]", "b": "CASE WHEN phi > 0 THEN cf[2] ELSE 0.0 END", "s": "list_transform(range(0, k), lambda j: cf[4 + 2 * j])", "z": "list_transform(range(0, k), lambda j: cf[3 + 2 * j])", "sse": "0.0"}
    back = lambda x: f"CASE WHEN w = 0 THEN exp({x}) ELSE {x} + 1 END"
    f = f"r.l + coalesce(list_sum(list_transform(range(1, u.step + 1), lambda i: pow(phi, i))), 0.0) * r.b + coalesce(list_sum(list_transform(r.s, lambda q, j: q * cos({lam('j')} * u.step) + r.z[j] * sin({lam('j')} * u.step))), 0.0)"
    return f"""WITH {_train(name, s.h)}, tw AS (SELECT series_id, n, ys, p.w, p.k, list_transform(ys, lambda y: CASE WHEN p.w = 0 THEN ln(CASE WHEN y > 0 THEN y END) ELSE y - 1 END) AS xs FROM tr, (VALUES {_values(pairs)}) p(w, k)),
t0 AS (SELECT * FROM tw WHERE len(list_filter(xs, lambda v: v IS NULL)) = 0 AND n > 2 * k + 4), t1 AS (SELECT *, list_transform(xs, lambda v, i: list_concat(list_concat([1.0, i]::DOUBLE[], {harmonics('i')}), [v])) AS rws FROM t0),
t2 AS (SELECT *, {L.normal_equations('rws', '(2 * k + 3)')} AS eq FROM t1), t3 AS (SELECT series_id, n, ys, xs, w, k, {L.solve('eq')} AS cf FROM t2), t4 AS (SELECT t3.*, p.phi, p.a, p.g FROM t3 JOIN (VALUES {_values(S.TBATS)}) p(w, phi, k, a, g) ON p.w = t3.w AND p.k = t3.k WHERE len(list_filter(cf, lambda v: v IS NULL)) = 0),
t5 AS (SELECT *, {_fold('xs', state, start)} AS r FROM t4), t6 AS (SELECT *, n * ln(r.sse / n) + CASE WHEN w = 0 THEN 2 * list_sum(list_transform(ys, lambda y: ln(CASE WHEN y > 0 THEN y END))) ELSE 0 END + 2 * (3 + 2 * k + CASE WHEN phi > 0 THEN 3 ELSE 0 END) AS aic FROM t5),
t7 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(aic, 6), w, phi, k, a, g) AS place FROM t6 WHERE aic IS NOT NULL AND NOT isnan(aic)) WHERE place = 1)
SELECT series_id, w AS power, phi, k AS pairs, round(aic, 6) AS aic, u.step, round({back('(' + f + ')')}, 6) AS mean FROM t7, {_steps(s.h)}"""


for _key, _name in (("tbats", "W_priority"), ("tbats_d", "D_event"), ("bats", "Y_nation")):

    @query(_key, tbats_sql(_name))
    def _(spark, d, name=_name):
        s = SPECS[name]
        made = S.tbats(split(packed(series(spark, d, name)), s.h), s.m, s.h).select("series_id", F.col("w").alias("power"), "phi", F.col("k").cast("long").alias("pairs"), r6("aic").alias("aic"), F.posexplode("f").alias("i", "f"))
        return made.select("series_id", "power", "phi", "pairs", "aic", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


def dshw_sql(name: str, short: int, long: int, shift: float) -> str:
    h = SPECS[name].h
    level = "(a * x.y / (c.s[1] * c.z[1]) + (1 - a) * (c.l + c.b))"
    plain = "((c.l + c.b) * c.s[1] * c.z[1])"
    state = {
        "l": ("DOUBLE", level), "b": ("DOUBLE", f"{S.SLOPE} * ({level} - c.l) + (1 - {S.SLOPE}) * c.b"),
        "s": ("DOUBLE[]", f"list_append(list_slice(c.s, 2, {short}), g * x.y / ({level} * c.z[1]) + (1 - g) * c.s[1])"), "z": ("DOUBLE[]", f"list_append(list_slice(c.z, 2, {long}), o * x.y / ({level} * c.s[1]) + (1 - o) * c.z[1])"),
        "e": ("DOUBLE", f"x.y - {plain}"), "sse": ("DOUBLE", f"c.sse + pow(x.y - {plain} - f1 * c.e, 2)"),
    }
    start = {"l": "l0", "b": "b0", "s": "s0", "z": "z0", "e": "0.0", "sse": "0.0"}
    return f"""WITH {_train(name, h, shift)}, q0 AS (SELECT *, list_avg(list_slice(ys, 1, {long})) AS l0, (list_avg(list_slice(ys, {long + 1}, {2 * long})) - list_avg(list_slice(ys, 1, {long}))) / {long} AS b0 FROM tr WHERE n >= {2 * long} AND list_min(ys) > 0),
q1 AS (SELECT *, list_transform(range(0, {short}), lambda p: list_avg(list_transform(range(p, {long}, {short}), lambda i: ys[i + 1] / l0))) AS s0 FROM q0), q2 AS (SELECT *, list_transform(list_slice(ys, 1, {long}), lambda y, i: y / l0 / s0[(i - 1) % {short} + 1]) AS z0 FROM q1),
q3 AS (SELECT *, {_fold('ys', state, start)} AS r FROM q2, (VALUES {_values(S.DSHW)}) p(a, g, o, f1)), q4 AS (SELECT * FROM (SELECT *, r.sse / n AS mse, row_number() OVER (PARTITION BY series_id ORDER BY round(r.sse / n, 6), a, g, o, f1) AS place FROM q3) WHERE place = 1)
SELECT series_id, round(mse, 6) AS mse, u.step, round((r.l + u.step * r.b) * r.s[(u.step - 1) % {short} + 1] * r.z[(u.step - 1) % {long} + 1] + pow(f1, u.step) * r.e - {shift}, 6) AS mean FROM q4, {_steps(h)}"""


@query("dshw", dshw_sql("H_event", 24, 168, 1.0))
def _(spark, d):
    """A day and a week of hours; one is added before and taken off behind, as hours without events are 0."""
    s = SPECS["H_event"]
    rows = split(packed(series(spark, d, "H_event").withColumn("y", F.col("y") + 1)), s.h)
    made = S.dshw(rows, 24, 168, s.h).select("series_id", r6("mse").alias("mse"), F.posexplode("f").alias("i", "f"))
    return made.select("series_id", "mse", (F.col("i") + 1).cast("long").alias("step"), r6(F.col("f") - 1).alias("mean"))


def structural_sql(name: str) -> str:
    h = SPECS[name].h
    p, c, dd = "(c.p + 2 * c.k + c.d + q)", "(c.k + c.d)", "(c.d + r)"
    v, f = "(x.y - c.l - c.b)", f"({p} + 1)"
    counts = "(CASE WHEN c.t >= 2 THEN 1.0 ELSE 0.0 END)"
    state = {
        "l": ("DOUBLE", f"c.l + c.b + {p} / {f} * {v}"), "b": ("DOUBLE", f"c.b + {c} / {f} * {v}"), "p": ("DOUBLE", f"{p} - {p} * {p} / {f}"), "k": ("DOUBLE", f"{c} - {p} * {c} / {f}"), "d": ("DOUBLE", f"{dd} - {c} * {c} / {f}"),
        "logs": ("DOUBLE", f"c.logs + {counts} * ln({f})"), "ss": ("DOUBLE", f"c.ss + {counts} * {v} * {v} / {f}"), "t": ("DOUBLE", "c.t + 1"),
    }
    start = {"l": "ys[1]", "b": "0.0", "p": str(S.DIFFUSE), "k": "0.0", "d": str(S.DIFFUSE), "logs": "0.0", "ss": "0.0", "t": "0.0"}
    return f"""WITH {_train(name, h)}, k0 AS (SELECT series_id, n, p.q AS q, p.r AS r, ys FROM tr, (VALUES {_values(S.STRUCTURAL)}) p(q, r) WHERE n > 4), k1 AS (SELECT series_id, n, q, r, {_fold('ys', state, start)} AS s FROM k0),
k2 AS (SELECT *, -((n - 2) * ln(s.ss / (n - 2)) + s.logs) / 2 AS likelihood FROM k1), k3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(-likelihood, 6), q, r) AS place FROM k2 WHERE likelihood IS NOT NULL AND NOT isnan(likelihood)) WHERE place = 1)
SELECT series_id, q, r, round(likelihood, 6) AS likelihood, u.step, round(s.l + u.step * s.b, 6) AS mean FROM k3, {_steps(h)}"""


for _key, _name in (("structts", "D_event"), ("structts_m", "M_segment")):

    @query(_key, structural_sql(_name))
    def _(spark, d, name=_name):
        s = SPECS[name]
        made = S.structural(split(packed(series(spark, d, name)), s.h), s.h).select("series_id", "q", "r", r6("likelihood").alias("likelihood"), F.posexplode("f").alias("i", "f"))
        return made.select("series_id", "q", "r", "likelihood", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


def detect_sql(name: str, most: int, raw: bool) -> str:
    """Welch's tests between phases; the t tail by the power series of the incomplete beta function, on its quick side."""
    kinds = "(0, 'raw')" if raw else "(0, 'less the line'), (1, 'over the line')"
    value = "y" if raw else "CASE WHEN k.o = 0 THEN y - (a + b * t) ELSE y / nullif(a + b * t, 0) END"

    def beta(x: str, a: str, b: str) -> str:
        return f"(SELECT sum(exp(({a} + j) * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b} + j) - lgamma({b}) - lgamma({a} + 1 + j))) FROM (SELECT unnest(range(0, 400)) AS j))"

    x = "(df / (df + tt * tt))"
    tail = f"CASE WHEN tt = 0 THEN 1.0 WHEN {x} < 0.5 THEN {beta(x, '(df / 2)', '0.5')} ELSE 1 - {beta(f'(1 - {x})', '0.5', '(df / 2)')} END"
    return f"""WITH {obs_sql(name)}, ln0 AS (SELECT series_id, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, count(*) AS n FROM obs GROUP BY 1),
kd AS (SELECT o.series_id, k.o, k.kind, t, n, {value} AS v FROM obs o JOIN ln0 l ON l.series_id = o.series_id, (VALUES {kinds}) k(o, kind)), ok AS (SELECT series_id, kind, max(o) AS o, max(n) AS n, list(v ORDER BY t) AS ys FROM kd GROUP BY 1, 2 HAVING count(v) = count(*) AND count(*) >= 4),
ph AS (SELECT k.series_id, k.kind, k.o, s.s, p.p, k.ys[(p.p + j.j * s.s) % k.n + 1] AS v FROM ok k, (SELECT unnest(range(2, {most + 1})) AS s) s JOIN (SELECT unnest(range(0, {most})) AS p) p ON p.p < s.s JOIN (SELECT unnest(range(0, 5000)) AS j) j ON true WHERE j.j < ceil(k.n / s.s)),
ms AS (SELECT series_id, kind, o, s, p, avg(v) AS m, var_samp(v) / count(*) AS e, count(*) AS c FROM ph GROUP BY ALL),
pr AS (SELECT a.series_id, a.kind, a.o, a.s, (a.m - b.m) / sqrt(a.e + b.e) AS tt, (a.e + b.e) * (a.e + b.e) / (a.e * a.e / (a.c - 1) + b.e * b.e / (b.c - 1)) AS df FROM ms a JOIN ms b ON b.series_id = a.series_id AND b.kind = a.kind AND b.s = a.s AND b.p > a.p WHERE a.e + b.e > 0),
pv AS (SELECT *, {tail} AS pval FROM pr), sn AS (SELECT series_id, kind, o, s, median(pval) AS p FROM pv GROUP BY ALL),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY o, round(p, 9), s) AS k FROM sn WHERE p < 0.05) WHERE k = 1)"""


for _key, _name, _raw in (("detect_season_ttest", "D_event", False), ("detect_season_ttest_m_segment", "M_segment", False), ("detect_season_ttest_raw", "M_nation", True)):
    _most = 12 if _name.startswith("M") else 10

    @query(_key, detect_sql(_name, _most, _raw) + " SELECT l.series_id, CAST(coalesce(b.s, 0) AS BIGINT) AS season, b.kind, round(b.p, 6) AS p FROM ln0 l LEFT JOIN be b ON b.series_id = l.series_id")
    def _(spark, d, name=_name, most=_most, raw=_raw):
        made = S.detect_season(packed(series(spark, d, name)), most, raw=raw)
        return made.select("series_id", F.col("season").cast("long").alias("season"), "kind", r6("p").alias("p"))


@query("detect_season_tests", detect_sql("D_event", 10, True) + " SELECT series_id, CAST(s AS BIGINT) AS season, round(p, 6) AS p FROM sn")
def _(spark, d):
    """The median p value of every season up to ten."""
    rows = packed(series(spark, d, "D_event")).select("series_id", F.lit("raw").alias("kind"), "ys")
    return S.phase_tests(rows, 10).select("series_id", F.col("s").cast("long").alias("season"), r6("p").alias("p"))
