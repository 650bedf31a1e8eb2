"""Queries that choose among many candidates for each series, by a holdout and, behind a gate, by folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import selection as S
from ..registry import query
from ..sources.series import SPECS, obs_sql, packed, series
from . import linear_sql as L
from .recipes import _loess_sql


def _dsum(phi: str, k: str) -> str:
    return f"CASE WHEN {phi} = 1 THEN CAST({k} AS DOUBLE) ELSE {phi} * (1 - pow({phi}, {k})) / (CASE WHEN {phi} <> 1 THEN 1 - {phi} END) END"


def _run(a: str, b: str, phi: str, trended: str) -> str:
    e = f"(x.y - s.l - {phi} * s.b)"
    step = f"{{'l': s.l + {phi} * s.b + {a} * {e}, 'b': {phi} * s.b + {a} * {b} * {e}, 'sse': s.sse + {e} * {e}, 'y': x.y}}"
    zero = "0.0::DOUBLE"
    return f"list_reduce(list_transform(list_slice(ys, 2, len(ys)), lambda v: {{'l': {zero}, 'b': {zero}, 'sse': {zero}, 'y': v}}), lambda s, x: {step}, {{'l': ys[1], 'b': CASE WHEN {trended} THEN ys[2] - ys[1] ELSE {zero} END, 'sse': {zero}, 'y': {zero}}})"


def base_sql(source: str, t: str, m: int = 1) -> str:
    """Tables {t}_base: (series_id, model, step, f, w), from a table (series_id, ys, h, win)."""
    grid = ", ".join(f"('{k}', {i}, {a}::DOUBLE, {b}::DOUBLE, {p}::DOUBLE, {str(k != 'ses').lower()}, {S.SIZES[k]})" for i, k in enumerate(S.GRIDS) for a, b, p in S.GRIDS[k])
    spread = f"sqrt(sse / (n - 1) * (1 + coalesce(list_sum(list_transform(range(1, s.step), lambda j: pow(a + a * b * ({_dsum('phi', 'j')}), 2))), 0)))"
    steps = "(SELECT CAST(unnest(range(1, 60)) AS BIGINT) AS step) s"
    psi = f"list_reduce(list_transform(range(1, greatest(h, 2)), lambda k: {{'s': NULL::DOUBLE[], 'k': k}}), lambda s, x: {{'s': list_append(s.s, {L.dot('list_slice(a, 1, least(p, x.k))', 'list_reverse(s.s)')} + CASE WHEN q >= x.k THEN a[p + x.k] ELSE 0.0 END), 'k': x.k}}, {{'s': [1.0]::DOUBLE[], 'k': 0::BIGINT}}).s"
    if m > 1:
        season = f"""{t}_p AS (SELECT l.series_id, (l.t - 1) % {m} AS phase, avg(x.y - l.f) AS p FROM {t}_lo l JOIN {t}_lx x ON x.series_id = l.series_id AND x.t = l.t WHERE x.n >= {2 * m} GROUP BY 1, 2), {t}_ss AS (SELECT series_id, phase, p - avg(p) OVER (PARTITION BY series_id) AS s FROM {t}_p),
{t}_sa AS (SELECT x.series_id, list(x.y - z.s ORDER BY x.t) AS ys FROM {t}_lx x JOIN {t}_ss z ON z.series_id = x.series_id AND z.phase = (x.t - 1) % {m} GROUP BY 1),"""
        adjusted = f" UNION ALL SELECT l.series_id, l.ys, i.h, i.win, 'stl-', len(l.ys) FROM {t}_sa l JOIN {t}_i i ON i.series_id = l.series_id"
        naive = f" UNION ALL SELECT series_id, 'snaive', s.step, ys[len(ys) - {m} + (s.step - 1) % {m} + 1], sqrt(list_avg(list_transform(list_slice(ys, {m + 1}, len(ys)), lambda v, i: pow(v - ys[i], 2)))) * sqrt((s.step - 1) // {m} + 1) FROM {t}_i, {steps} WHERE s.step <= h AND len(ys) > {m}"
        back = f", {t}_base AS (SELECT b.series_id, b.model, b.step, b.f + coalesce(z.s, 0) AS f, b.w FROM {t}_raw b JOIN {t}_i i ON i.series_id = b.series_id LEFT JOIN {t}_ss z ON b.model LIKE 'stl-%' AND z.series_id = b.series_id AND z.phase = (len(i.ys) + b.step - 1) % {m})"
    else:
        season, adjusted, naive, back = "", "", "", f", {t}_base AS (SELECT * FROM {t}_raw)"
    return f"""{t}_i AS (SELECT * FROM {source} WHERE len(ys) > 4), {t}_lx AS (SELECT series_id, len(ys) AS n, unnest(ys) AS y, unnest(range(1, len(ys) + 1)) AS t FROM {t}_i), {_loess_sql(f'{t}_lx', 'y', f'{t}_lo', S.SPAN)},{season}
{t}_s AS (SELECT series_id, ys, h, win, '' AS o, len(ys) AS n FROM {t}_i UNION ALL SELECT l.series_id, l.ys, i.h, i.win, 'loess-', len(l.ys) FROM (SELECT series_id, list(f ORDER BY t) AS ys FROM {t}_lo GROUP BY 1) l JOIN {t}_i i ON i.series_id = l.series_id{adjusted}),
{t}_r AS (SELECT z.*, c.*, {_run('c.a', 'c.b', 'c.phi', 'c.trended')} AS r FROM {t}_s z, (VALUES {grid}) c(kind, place, a, b, phi, trended, size)),
{t}_f AS (SELECT * FROM (SELECT series_id, ys, h, win, o, n, kind, place, a, b, phi, r.l AS l, r.b AS slope, r.sse AS sse, CASE WHEN n > size + 1 AND r.sse > 0 THEN n * ln(r.sse / n) + 2 * size + 2.0 * size * (size + 1) / (n - size - 1) END AS aicc,
  row_number() OVER (PARTITION BY series_id, o, kind ORDER BY round(r.sse, 9), a, b, phi) AS k FROM {t}_r) WHERE k = 1),
{t}_e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, o ORDER BY round(coalesce(aicc, 'Infinity'::DOUBLE), 6), place) AS z FROM {t}_f) WHERE z = 1),
{t}_g AS (SELECT series_id, ys, h, win, o, n, 'ses.' || CAST(CAST(10 * a AS INT) AS VARCHAR) AS kind, a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS phi, r.l AS l, 0.0::DOUBLE AS slope, r.sse AS sse FROM (SELECT z.*, g.a, {_run('g.a', '0.0', '1.0', 'false')} AS r FROM {t}_s z, (VALUES (0.3::DOUBLE), (0.1::DOUBLE)) g(a) WHERE z.o = '')),
{t}_sl AS (SELECT series_id, o, regr_slope(y, x) AS line FROM (SELECT series_id, o, unnest(ys) AS y, unnest(range(1, len(ys) + 1)) AS x FROM {t}_s) GROUP BY 1, 2),
{t}_n AS (SELECT series_id, h, ys[-1] AS last, sqrt(list_avg(list_transform(list_slice(ys, 2, len(ys)), lambda v, i: (v - ys[i]) * (v - ys[i])))) AS s, list_avg(list_slice(ys, greatest(len(ys) - win + 1, 1), len(ys))) AS flat FROM {t}_i),
{t}_d0 AS (SELECT series_id, h, ys[-1] AS last, list_transform(list_slice(ys, 2, len(ys)), lambda v, i: v - ys[i]) AS ds FROM {source} WHERE len(ys) > 8), {t}_d AS (SELECT series_id, list_transform(ds, lambda v: v - list_avg(ds)) AS xs FROM {t}_d0), {L.arma_tables(f'{t}_d', S.ORDERS, S.LONG, f'{t}x')},
{t}_ak AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(aicc, 6), p, q) AS k FROM {t}x_fit WHERE aicc IS NOT NULL AND {L.stationary('list_slice(a, 1, p)')} AND {L.stationary('list_transform(list_slice(a, p + 1, p + q), lambda m: -m)')}),
{t}_aj AS (SELECT k.series_id, k.xs, k.p, k.q, k.a, k.e, k.sse, k.nn, d.h, d.last, list_avg(d.ds) AS drift FROM {t}_ak k JOIN {t}_d0 d ON d.series_id = k.series_id WHERE k.k = 1),
{t}_ag AS (SELECT *, {L.ahead('h')} AS g, {psi} AS psi FROM {t}_aj),
{t}_aw AS (SELECT *, list_transform(psi, lambda v, i: list_sum(list_slice(psi, 1, i))) AS c FROM {t}_ag),
{t}_raw AS (SELECT series_id, o || 'ets' AS model, s.step, l + slope * ({_dsum('phi', 's.step')}) AS f, {spread} AS w FROM {t}_e, {steps} WHERE s.step <= h
 UNION ALL SELECT series_id, kind, s.step, l + slope * ({_dsum('phi', 's.step')}), {spread} FROM (SELECT * FROM {t}_f WHERE o = ''), {steps} WHERE s.step <= h
 UNION ALL SELECT series_id, kind, s.step, l, {spread} FROM {t}_g, {steps} WHERE s.step <= h
 UNION ALL SELECT series_id, o || 'theta', s.step, l + line / 2 * (s.step - 1 + (1 - pow(1 - a, n)) / a), {spread} FROM (SELECT f.*, z.line FROM {t}_f f JOIN {t}_sl z ON z.series_id = f.series_id AND z.o = f.o WHERE f.kind = 'ses'), {steps} WHERE s.step <= h
 UNION ALL SELECT series_id, m.model, s.step, CASE m.model WHEN 'naive' THEN last ELSE flat END, {t}_n.s * sqrt(s.step) FROM {t}_n, {steps}, (VALUES ('naive'), ('avg')) m(model) WHERE s.step <= h
 UNION ALL SELECT series_id, 'arima', s.step, last + s.step * drift + list_sum(list_slice(g, 1, s.step)), sqrt(sse / nn * list_sum(list_transform(list_slice(c, 1, s.step), lambda v: v * v))) FROM {t}_aw, {steps} WHERE s.step <= h{naive}){back}"""


def candidates_sql(base: str, t: str, named: dict[int, tuple[str, ...]]) -> str:
    """Tables {t}: (series_id, place, step, mean, wide)."""
    members = ", ".join(f"({p}, '{m}', {len(ms)})" for p, ms in named.items() for m in ms)
    return f"{t} AS (SELECT b.series_id, m.place, b.step, avg(b.f) AS mean, avg(b.w) AS wide FROM {base} b JOIN (VALUES {members}) m(place, model, size) ON m.model = b.model WHERE b.f IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = max(m.size))"


def selection_sql(name: str, holdout: int, gate: float = 3.0, m: int = 1) -> str:
    """Common table expressions ch: (series_id, stage, place, score), and fo, its forecasts of the whole series."""
    h = SPECS[name].h
    menu, folded, other = S._menus(m)
    final = {p: other.get(p, ms) for p, ms in enumerate(menu, 1)} | {100 + p: ms for p, ms in enumerate(folded, 1)}
    return f"""WITH {obs_sql(name)}, pk AS (SELECT series_id, list(y ORDER BY t) AS ys0, count(*) AS n0 FROM obs GROUP BY 1), hd AS (SELECT *, CASE WHEN n0 > 24 THEN {holdout} ELSE {h} END AS h FROM pk),
i1 AS (SELECT series_id, list_slice(ys0, 1, n0 - h) AS ys, h, h + 1 AS win FROM hd WHERE n0 > h + 4), {base_sql('i1', 'a', m)}, {candidates_sql('a_base', 'c1', dict(enumerate(menu, 1)))},
e1 AS (SELECT c.series_id, place, avg(coalesce(200 * abs(ys0[n0 - h + step] - mean) / nullif(abs(ys0[n0 - h + step]) + abs(mean), 0), 0)) AS score FROM c1 c JOIN hd ON hd.series_id = c.series_id GROUP BY 1, 2),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 6), place) AS k FROM e1 WHERE score IS NOT NULL) WHERE k = 1), ps AS (SELECT series_id, place, score FROM b1 WHERE score <= {gate}),
fl AS (SELECT series_id, ys0, lead, unnest(range(start, n0 - lead + 1)) AS origin FROM (SELECT *, CASE WHEN n0 > 24 THEN 4 ELSE 3 END AS lead, n0 - CASE WHEN n0 > 24 THEN 12 ELSE 6 END AS start FROM pk) WHERE start > 4 AND series_id NOT IN (SELECT series_id FROM ps)),
i2 AS (SELECT series_id || '|' || origin AS series_id, list_slice(ys0, 1, origin) AS ys, lead AS h, lead + 1 AS win FROM fl), {base_sql('i2', 'b', m)}, {candidates_sql('b_base', 'c2', dict(enumerate(folded, 1)))},
e2 AS (SELECT f.series_id, c.place, avg(abs(f.ys0[f.origin + f.lead] - c.mean)) AS score FROM c2 c JOIN fl f ON f.series_id || '|' || f.origin = c.series_id AND c.step = f.lead GROUP BY 1, 2),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 6), place) AS k FROM e2) WHERE k = 1),
ch AS (SELECT series_id, 'holdout' AS stage, place, score FROM ps UNION ALL SELECT series_id, 'folds', place, score FROM b2 UNION ALL SELECT series_id, 'too short', place, score FROM b1 WHERE score > {gate} AND series_id NOT IN (SELECT series_id FROM b2)),
i3 AS (SELECT series_id, ys0 AS ys, {h} AS h, {h + 1} AS win FROM pk), {base_sql('i3', 'd', m)}, {candidates_sql('d_base', 'c3', final)},
fo AS (SELECT h.*, c.step, c.mean, c.mean - {S.Z} * c.wide AS lower, c.mean + {S.Z} * c.wide AS upper FROM ch h JOIN c3 c ON c.series_id = h.series_id AND c.place = h.place + CASE WHEN h.stage = 'folds' THEN 100 ELSE 0 END)"""


_ROWS = " SELECT series_id, stage, CAST(place AS BIGINT) AS place, round(score, 6) AS score, step, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper FROM fo"


def _selected(spark, d, name: str, holdout: int, gate: float, m: int) -> DataFrame:
    rows = S.select_and_forecast(packed(series(spark, d, name)), SPECS[name].h, holdout, gate, m)
    return rows.select("series_id", "stage", F.col("place").cast("long").alias("place"), r6("score").alias("score"), F.col("step").cast("long").alias("step"), *[r6(c).alias(c) for c in ("mean", "lower", "upper")])


#: Yearly and daily series without a season and a gate of 3 %, quarterly and monthly ones with one and of 5 %.
for _key, _name, _holdout, _gate, _m in (("rec_223_y", "Y_nation", 12, 3.0, 1), ("rec_223_d", "D_event", 14, 3.0, 1), ("rec_223_q", "Q_nation", 8, 5.0, 4), ("rec_223_m", "M_segment", 18, 5.0, 12)):
    query(_key, selection_sql(_name, _holdout, _gate, _m) + _ROWS)(lambda spark, d, name=_name, holdout=_holdout, gate=_gate, m=_m: _selected(spark, d, name, holdout, gate, m))


@query("select_holdout_smape_25", selection_sql("M_segment", 18, 5.0, 12) + " SELECT series_id, stage, CAST(place AS BIGINT) AS place, round(score, 6) AS score FROM ch")
def _(spark, d):
    """The same among 25 candidates, some of them on the values without season."""
    made = S.choose(packed(series(spark, d, "M_segment")), 18, 18, 5.0, 12)
    return made.select("series_id", "stage", F.col("place").cast("long").alias("place"), r6("score").alias("score"))


@query("select_holdout_smape_23", selection_sql("D_event", 14) + " SELECT series_id, stage, CAST(place AS BIGINT) AS place, round(score, 6) AS score FROM ch")
def _(spark, d):
    """Which of 23 candidates a series takes, or, where none is within the gate, which of the models that folds are tried on."""
    made = S.choose(packed(series(spark, d, "D_event")), SPECS["D_event"].h, 14)
    return made.select("series_id", "stage", F.col("place").cast("long").alias("place"), r6("score").alias("score"))


_FOLDS = f"""WITH {obs_sql('D_event')}, pk AS (SELECT series_id, list(y ORDER BY t) AS ys0, count(*) AS n0 FROM obs GROUP BY 1),
fl AS (SELECT series_id, ys0, lead, unnest(range(start, n0 - lead + 1)) AS origin FROM (SELECT *, CASE WHEN n0 > 24 THEN 4 ELSE 3 END AS lead, n0 - CASE WHEN n0 > 24 THEN 12 ELSE 6 END AS start FROM pk) WHERE start > 4),
i2 AS (SELECT series_id || '|' || origin AS series_id, list_slice(ys0, 1, origin) AS ys, lead AS h, lead + 1 AS win FROM fl), {base_sql('i2', 'b', 7)}, {candidates_sql('b_base', 'c2', dict(enumerate(S.SEASONAL_FOLDED, 1)))}
SELECT f.series_id, CASE c.place {" ".join(f"WHEN {p} THEN '{ms[0]}'" for p, ms in enumerate(S.SEASONAL_FOLDED, 1))} END AS model, round(avg(abs(f.ys0[f.origin + f.lead] - c.mean)), 6) AS error FROM c2 c JOIN fl f ON f.series_id || '|' || f.origin = c.series_id AND c.step = f.lead GROUP BY 1, 2"""


@query("cv_rolling_models", _FOLDS)
def _(spark, d):
    """The mean absolute error of each model over shifted origins, fitted anew before each; a model that fails has no row."""
    names = F.create_map(*[x for p, ms in enumerate(S.SEASONAL_FOLDED, 1) for x in (F.lit(p), F.lit(ms[0]))])
    return S.fold_scores(packed(series(spark, d, "D_event")), 7).select("series_id", names[F.col("place")].alias("model"), r6("error").alias("error"))
