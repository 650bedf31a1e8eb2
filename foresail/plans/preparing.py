"""Queries on preparation, windows, tests and decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import preparation as P
from ..operators import seasonal as S
from ..registry import query
from ..sources.series import SPECS, obs_sql, packed, series

MAIN = "M_segment"
_O = "OVER (PARTITION BY series_id ORDER BY t)"
_B = "OVER (PARTITION BY series_id)"


def sql(name: str, text: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{obs_sql(name)}{text}"


def _all(text: str, name: str = MAIN) -> str:
    return sql(name, "\n" + text)


for _name in SPECS:
    query(f"series_{_name.lower()}", _all("SELECT series_id, t, ds, value, round(y, 6) AS y FROM obs", _name))(
        lambda spark, d, n=_name: series(spark, d, n).select("series_id", "t", F.col("ds").cast("timestamp_ntz").alias("ds"), "value", r6("y").alias("y"))
    )


@query("prep_holdout_split", _all(f"SELECT series_id, t, round(y, 6) AS y, CASE WHEN max(t) {_B} - t < 18 THEN 'test' ELSE 'train' END AS part FROM obs"))
def _(spark, d):
    return P.holdout_part(series(spark, d, MAIN), 18).select("series_id", "t", r6("y").alias("y"), "part")


@query("prep_scale_by_mean", _all("SELECT series_id, t, round(y, 6) AS value_scaled FROM obs"))
def _(spark, d):
    return series(spark, d, MAIN).select("series_id", "t", r6("y").alias("value_scaled"))


@query("prep_scale_to_100", _all("SELECT series_id, t, round(100 * y, 6) AS value_scaled FROM obs"))
def _(spark, d):
    return series(spark, d, MAIN).select("series_id", "t", r6(100 * F.col("y")).alias("value_scaled"))


@query("prep_tail_cap", _all(f"SELECT series_id, t, round(y, 6) AS y FROM (SELECT *, max(t) {_B} AS n FROM obs) WHERE t > n - 24"))
def _(spark, d):
    return P.tail_cap(series(spark, d, MAIN), 24).select("series_id", "t", r6("y").alias("y"))


@query("prep_head_cap", _all("SELECT series_id, t, round(y, 6) AS y FROM obs WHERE t <= 70", "D_event"))
def _(spark, d):
    return P.head_cap(series(spark, d, "D_event"), 70).select("series_id", "t", r6("y").alias("y"))


@query("prep_zscore", _all(f"SELECT series_id, t, round((y - avg(y) {_B}) / stddev_samp(y) {_B}, 6) AS z FROM obs"))
def _(spark, d):
    return P.zscore(series(spark, d, MAIN)).select("series_id", "t", r6("z").alias("z"))


@query("prep_normalise_rows", _all(f"SELECT series_id, t, round((y - avg(y) {_B}) / nullif(stddev_pop(y) {_B}, 0), 6) AS z FROM obs"))
def _(spark, d):
    return P.zscore(series(spark, d, MAIN)).select("series_id", "t", r6("zp").alias("z"))


@query("prep_diff", _all(f"SELECT series_id, t, round(y - lag(y) {_O}, 6) AS d FROM obs"))
def _(spark, d):
    return P.difference(series(spark, d, MAIN)).select("series_id", "t", r6("d").alias("d"))


@query("prep_undiff", _all("SELECT series_id, t, round(y, 6) AS back FROM obs"))
def _(spark, d):
    return P.undifference(P.difference(series(spark, d, MAIN))).select("series_id", "t", r6("back").alias("back"))


@query(
    "prep_log_return",
    _all(f"SELECT series_id, t, round(CASE WHEN y > 0 AND p > 0 THEN ln(y) - ln(p) END, 6) AS r FROM (SELECT *, lag(y) {_O} AS p FROM obs)"),
)
def _(spark, d):
    return P.log_return(series(spark, d, MAIN)).select("series_id", "t", r6("r").alias("r"))


@query(
    "prep_boxcox",
    _all("SELECT series_id, t, round(CASE WHEN y > 0 THEN ln(y) END, 6) AS b0, round(CASE WHEN y > 0 THEN (sqrt(y) - 1) / 0.5 END, 6) AS b5, round(CASE WHEN y > 0 THEN y - 1 END, 6) AS b10 FROM obs"),
)
def _(spark, d):
    y = F.col("y")
    return series(spark, d, MAIN).select("series_id", "t", *[r6(P.box_cox(y, p)).alias(f"b{int(10 * p)}") for p in (0.0, 0.5, 1.0)])


@query("prep_inv_boxcox", _all("SELECT series_id, t, round(CASE WHEN y > 0 THEN y END, 6) AS y FROM obs"))
def _(spark, d):
    return series(spark, d, MAIN).select("series_id", "t", r6(P.inverse_box_cox(P.box_cox(F.col("y"), 0.5), 0.5)).alias("y"))


_LINE = f"SELECT *, regr_intercept(y, t) {_B} + regr_slope(y, t) {_B} * t AS line FROM obs"


@query("prep_detrend_linear", _all(f"SELECT series_id, t, round(y - line, 6) AS resid FROM ({_LINE})", "D_event"))
def _(spark, d):
    return P.trend_line(series(spark, d, "D_event")).select("series_id", "t", r6(F.col("y") - F.col("line")).alias("resid"))


@query(
    "prep_detrend_geometric",
    _all(f"SELECT series_id, t, round(y / CASE WHEN abs(line) < 0.01 THEN CASE WHEN line < 0 THEN -0.01 ELSE 0.01 END ELSE line END, 6) AS ratio FROM ({_LINE})", "D_event"),
)
def _(spark, d):
    return P.detrend_geometric(series(spark, d, "D_event")).select("series_id", "t", r6("ratio").alias("ratio"))


@query("prep_remove_seasonal_means", _all("SELECT series_id, t, round(y - avg(y) OVER (PARTITION BY series_id, (t - 1) % 12), 6) AS rest FROM obs"))
def _(spark, d):
    return P.remove_phase_means(series(spark, d, MAIN), 12).select("series_id", "t", r6("rest").alias("rest"))


@query(
    "prep_seasonal_diff_var",
    _all(
        f"""SELECT series_id, round(var_samp(CASE WHEN t > 168 THEN y - a END), 6) AS var24, round(var_samp(y - b), 6) AS var168,
  CAST(CASE WHEN var_samp(y - b) < var_samp(CASE WHEN t > 168 THEN y - a END) THEN 168 ELSE 24 END AS BIGINT) AS chosen_m
FROM (SELECT *, lag(y, 24) {_O} AS a, lag(y, 168) {_O} AS b FROM obs) GROUP BY 1""",
        "H_event",
    ),
)
def _(spark, d):
    made = P.difference(P.difference(series(spark, d, "H_event"), 24).withColumnRenamed("d", "d24"), 168)
    v24, v168 = F.var_samp(F.when(F.col("t") > 168, F.col("d24"))), F.var_samp("d")
    return made.groupBy("series_id").agg(r6(v24).alias("var24"), r6(v168).alias("var168"), F.when(v168 < v24, 168).otherwise(24).cast("long").alias("chosen_m"))


@query(
    "prep_lag_embed",
    _all(f"SELECT * FROM (SELECT series_id, t, round(y, 6) AS y, round(lag(y) {_O}, 6) AS l1, round(lag(y, 2) {_O}, 6) AS l2, round(lag(y, 3) {_O}, 6) AS l3 FROM obs) WHERE l3 IS NOT NULL", "D_event"),
)
def _(spark, d):
    return P.lags(series(spark, d, "D_event"), 3).select("series_id", "t", *[r6(c).alias(c) for c in ("y", "l1", "l2", "l3")])


@query(
    "prep_augment_windows",
    _all(
        """, k AS (SELECT series_id, count(*) AS n, least(7, count(*) - 13) AS k FROM obs GROUP BY 1),
s AS (SELECT series_id, n, k, unnest(range(k)) AS shift FROM k WHERE n >= 14)
SELECT s.series_id, CAST(s.shift AS BIGINT) AS shift, round(1.0 / max(k), 6) AS weight, CAST(o.t - (n - 14 - s.shift) AS BIGINT) AS place, round(max(o.y), 6) AS y
FROM s JOIN obs o ON o.series_id = s.series_id AND o.t > n - 14 - s.shift AND o.t <= n - s.shift GROUP BY 1, 2, 4""",
        "D_event",
    ),
)
def _(spark, d):
    made = P.shifted_windows(packed(series(spark, d, "D_event")), 14, 7)
    rows = made.select("series_id", "shift", "weight", F.posexplode("window").alias("i", "y"))
    return rows.select("series_id", "shift", r6("weight").alias("weight"), (F.col("i") + 1).cast("long").alias("place"), r6("y").alias("y"))


@query(
    "prep_pad_short",
    _all(
        """, n AS (SELECT series_id, count(*) AS n FROM obs GROUP BY 1), g AS (SELECT series_id, n, unnest(range(1, 41)) AS place FROM n)
SELECT g.series_id, CAST(g.place AS BIGINT) AS place, round(o.y, 6) AS y FROM g JOIN obs o ON o.series_id = g.series_id
AND o.t = CASE WHEN g.place > 40 - n THEN g.place - 40 + n ELSE ((g.place - (40 - n) - 1) % 4 + 4) % 4 + 1 END WHERE n < 40""",
        "Q_nation",
    ),
)
def _(spark, d):
    made = P.pad_left(packed(series(spark, d, "Q_nation")), 40, 4)
    return made.where("n < 40").select("series_id", F.posexplode("ys").alias("i", "y")).select("series_id", (F.col("i") + 1).cast("long").alias("place"), r6("y").alias("y"))


@query(
    "prep_na_contiguous",
    _all(
        f""", r AS (SELECT *, t - row_number() {_O} AS g FROM obs WHERE y > 1), s AS (SELECT series_id, g, count(*) AS size, min(t) AS a FROM r GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY size DESC, a) AS k FROM s)
SELECT series_id, CAST(a AS BIGINT) AS first, CAST(size AS BIGINT) AS size FROM b WHERE k = 1"""
    ),
)
def _(spark, d):
    return P.longest_run(series(spark, d, MAIN), F.col("y") > 1).select("series_id", "first", F.col("size").cast("long").alias("size")).distinct()


@query("prep_trim_right", _all(f"SELECT series_id, t, round(y, 6) AS y FROM (SELECT *, max(CASE WHEN y > 1 THEN t END) {_B} AS last FROM obs) WHERE t <= last"))
def _(spark, d):
    return P.trim_right(series(spark, d, MAIN), F.col("y") > 1).select("series_id", "t", r6("y").alias("y"))


@query("prep_clip_outliers", _all(f"SELECT series_id, t, round(greatest(least(y, 1 + stddev_samp(y) {_B}), 1 - stddev_samp(y) {_B}), 6) AS y FROM obs"))
def _(spark, d):
    sd = F.stddev_samp("y").over(P.by_series())
    return series(spark, d, MAIN).select("series_id", "t", r6(F.greatest(F.least(F.col("y"), 1 + sd), 1 - sd)).alias("y"))


def _ma(m: int) -> str:
    k = m // 2
    w = lambda a, b: f"OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
    value = f"avg(y) {w(k, k)}" if m % 2 else f"(sum(y) {w(k, k - 1)} + sum(y) {w(k - 1, k)}) / {2 * m}"
    return f"SELECT *, CASE WHEN t > {k} AND t <= count(*) {_B} - {k} THEN {value} END AS trend FROM obs"


@query("win_centered_ma_2xm", _all(f"SELECT series_id, t, round(trend, 6) AS ma FROM ({_ma(12)})"))
def _(spark, d):
    return S.centered_average(series(spark, d, MAIN), 12, "ma").select("series_id", "t", r6("ma").alias("ma"))


@query("win_centered_ma_odd", _all(f"SELECT series_id, t, round(trend, 6) AS ma FROM ({_ma(7)})", "D_event"))
def _(spark, d):
    return S.centered_average(series(spark, d, "D_event"), 7, "ma").select("series_id", "t", r6("ma").alias("ma"))


_W3 = "OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(
    "win_ma3x3",
    _all(
        f""", a AS (SELECT *, CASE WHEN count(y) {_W3} = 3 THEN avg(y) {_W3} END AS a, count(*) {_B} AS n FROM obs), b AS (SELECT *, CASE WHEN t > 2 AND t < n - 1 THEN avg(a) {_W3} ELSE a END AS b FROM a)
SELECT x.series_id, x.t, round(CASE WHEN x.b IS NULL THEN (x.y + y.y) / 2 + (y.b - z.b) / 2 ELSE x.b END, 6) AS ma FROM b x LEFT JOIN b y ON y.series_id = x.series_id AND x.b IS NULL AND y.t = CASE WHEN x.t = 1 THEN 2 ELSE x.n - 1 END
LEFT JOIN b z ON z.series_id = x.series_id AND x.b IS NULL AND z.t = CASE WHEN x.t = 1 THEN 3 ELSE x.n - 2 END"""
    ),
)
def _(spark, d):
    return S.ma3x3(series(spark, d, MAIN)).select("series_id", "t", r6("ma").alias("ma"))


@query("win_cumsum", _all(f"SELECT series_id, t, round(sum(y) OVER (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS total FROM obs"))
def _(spark, d):
    return series(spark, d, MAIN).select("series_id", "t", r6(F.sum("y").over(P.ordered())).alias("total"))


@query(
    "win_nonoverlap_blocks",
    _all("SELECT series_id, t, CAST(floor((t - 1) / 24) AS BIGINT) AS block, round(avg(y) OVER (PARTITION BY series_id, floor((t - 1) / 24)), 6) AS mean, round(y - avg(y) OVER (PARTITION BY series_id, floor((t - 1) / 24)), 6) AS residual FROM obs", "H_event"),
)
def _(spark, d):
    obs = series(spark, d, "H_event").withColumn("block", F.floor((F.col("t") - 1) / 24))
    mean = F.avg("y").over(P.W.partitionBy("series_id", "block"))
    return obs.select("series_id", "t", "block", r6(mean).alias("mean"), r6(F.col("y") - mean).alias("residual"))


@query(
    "win_temporal_aggregation",
    _all(
        f""", k AS (SELECT unnest([1, 2, 3, 4, 6, 12]) AS k), o AS (SELECT *, count(*) {_B} AS n FROM obs)
SELECT series_id, CAST(k AS BIGINT) AS level, CAST(floor((n - t) / k) AS BIGINT) AS back, round(sum(y), 6) AS y FROM o, k WHERE n - t < floor(n / k) * k GROUP BY 1, 2, 3"""
    ),
)
def _(spark, d):
    obs = series(spark, d, MAIN).withColumn("n", F.max("t").over(P.by_series())).withColumn("level", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 4, 6, 12)])))
    kept = obs.where(F.col("n") - F.col("t") < F.floor(F.col("n") / F.col("level")) * F.col("level"))
    return kept.groupBy("series_id", "level", F.floor((F.col("n") - F.col("t")) / F.col("level")).alias("back")).agg(r6(F.sum("y")).alias("y"))


@query(
    "win_rolling_origin",
    _all(
        f""", o AS (SELECT *, count(*) {_B} AS n FROM obs)
SELECT a.series_id, a.t AS origin, CAST(b.t - a.t AS BIGINT) AS lead, round(abs(b.y - a.y), 6) AS error FROM o a JOIN o b ON a.series_id = b.series_id AND b.t > a.t AND b.t <= a.t + 4 WHERE a.t >= a.n - 18 AND a.t <= a.n - 4"""
    ),
)
def _(spark, d):
    packs = packed(series(spark, d, MAIN)).withColumn("origin", F.explode(F.sequence(F.col("n") - 18, F.col("n") - 4)))
    rows = packs.select("series_id", "origin", "ys", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("lead"))
    error = F.abs(F.get("ys", (F.col("origin") + F.col("lead") - 1).cast("int")) - F.get("ys", (F.col("origin") - 1).cast("int")))
    return rows.select("series_id", "origin", F.col("lead").cast("long").alias("lead"), r6(error).alias("error"))


def acf_sql(m: int) -> str:
    return f""", d AS (SELECT series_id, t, y - avg(y) {_B} AS e, count(*) {_B} AS n FROM obs), v AS (SELECT series_id, sum(e * e) AS s FROM d GROUP BY 1),
r AS (SELECT a.series_id, CAST(b.t - a.t AS BIGINT) AS lag, max(a.n) AS n, sum(a.e * b.e) / max(v.s) AS r FROM d a JOIN d b ON a.series_id = b.series_id AND b.t > a.t AND b.t <= a.t + {m} JOIN v ON v.series_id = a.series_id GROUP BY 1, 2)"""


@query("acf_r", _all(acf_sql(60) + " SELECT series_id, lag, round(r, 6) AS r FROM r WHERE lag <= floor(10 * log10(n))"))
def _(spark, d):
    return S.autocorrelations(packed(series(spark, d, MAIN))).select("series_id", "lag", r6("r").alias("r"))


def test_sql(m: int, squared: bool, critical: float = 1.645) -> str:
    first = "r * r" if squared else "r"
    fits = f"n >= {3 * m} AND floor(10 * log10(n)) >= {m} AND " if squared else ""
    return acf_sql(m) + f""", s AS (SELECT series_id, max(n) AS n, max(CASE WHEN lag = {m} THEN r END) AS r_m, coalesce(sum(CASE WHEN lag < {m} THEN CASE WHEN lag = 1 THEN {first} ELSE r * r END END), 0) AS s FROM r GROUP BY 1),
q AS (SELECT *, {critical} * sqrt(CASE WHEN 1 + 2 * s >= 0 THEN (1 + 2 * s) / n END) AS bound FROM s)
SELECT series_id, round(r_m, 6) AS r_m, round(bound, 6) AS bound, coalesce({fits}abs(r_m) > bound, false) AS is_seasonal FROM q"""


for _fixture in ("M_segment", "D_event", "H_event", "Q_nation"):
    for _kind, _squared, _crit in (("r", True, 1.645), ("py", False, 1.645), ("tcrit", True, 1.28)):
        query(f"seasonality_test_{_kind}_{_fixture.lower()}", _all(test_sql(SPECS[_fixture].m, _squared, _crit), _fixture))(
            lambda spark, d, f=_fixture, s=_squared, c=_crit: S.seasonality_test(packed(series(spark, d, f)), SPECS[f].m, c, s).select(
                "series_id", r6("r_m").alias("r_m"), r6("bound").alias("bound"), "is_seasonal"
            )
        )


def classical_sql(multiplicative: bool) -> str:
    op, norm = ("/ nullif(trend, 0)", "p / avg(p) OVER (PARTITION BY series_id)") if multiplicative else ("- trend", "p - avg(p) OVER (PARTITION BY series_id)")
    return f""", ma AS ({_ma(12)}), ph AS (SELECT series_id, (t - 1) % 12 AS phase, avg(y {op}) AS p FROM ma GROUP BY 1, 2),
ix AS (SELECT series_id, phase, {norm} AS ix FROM ph)
SELECT m.series_id, m.t, round(trend, 6) AS trend, round(ix, 6) AS index, round(y {'/' if multiplicative else '-'} ix, 6) AS adjusted FROM ma m JOIN ix ON ix.series_id = m.series_id AND ix.phase = (m.t - 1) % 12"""


for _suffix, _mult in (("mult", True), ("add", False)):
    query(f"decompose_classical_{_suffix}", _all(classical_sql(_mult)))(
        lambda spark, d, x=_mult: S.classical(series(spark, d, MAIN), 12, x).select("series_id", "t", r6("trend").alias("trend"), r6("index").alias("index"), r6("adjusted").alias("adjusted"))
    )

_TRIM = f""", ma AS ({_ma(12)}), le AS (SELECT series_id, (t - 1) % 12 AS phase, y / nullif(trend, 0) AS le FROM ma WHERE trend IS NOT NULL),
e AS (SELECT *, max(le) OVER (PARTITION BY series_id, phase) AS hi, min(le) OVER (PARTITION BY series_id, phase) AS lo, count(*) {_B} AS k FROM le),
p AS (SELECT series_id, phase, count(*) AS n, CASE WHEN max(k) >= 36 THEN coalesce(avg(CASE WHEN le < hi AND le > lo THEN le END), avg(le)) ELSE median(le) END AS p, var_pop(le) AS v0, avg(le) AS a0 FROM e GROUP BY 1, 2),
ix AS (SELECT *, (v0 + (a0 - ix) * (a0 - ix)) / nullif(n - 1, 0) AS spread FROM (SELECT *, p / avg(p) {_B} AS ix FROM p))"""


@query("decompose_trimmed", _all(_TRIM + " SELECT series_id, CAST(phase AS BIGINT) AS phase, CAST(n AS BIGINT) AS n_ratio, round(ix, 6) AS index FROM ix"))
def _(spark, d):
    return S.trimmed_indices(series(spark, d, MAIN), 12).select("series_id", "phase", "n_ratio", r6("index").alias("index"))


SHRUNK = _TRIM + f""", v AS (SELECT *, avg(spread) {_B} AS v FROM ix), a AS (SELECT *, greatest(sum((ix - 1) * (ix - 1)) {_B} / 11 - v, 0) AS a FROM v),
w AS (SELECT *, 9.0 / 11 * v / nullif(v + a, 0) AS w FROM a)"""


@query("shrink_james_stein", _all(SHRUNK + " SELECT series_id, CAST(phase AS BIGINT) AS phase, round(w, 6) AS w, round(w + (1 - w) * ix, 6) AS shrunk FROM w"))
def _(spark, d):
    return S.shrink(S.trimmed_indices(series(spark, d, MAIN), 12), 12).select("series_id", "phase", r6("w").alias("w"), r6("james_stein").alias("shrunk"))


@query(
    "shrink_lemon_krutchkoff",
    _all(SHRUNK + " SELECT x.series_id, CAST(x.phase AS BIGINT) AS phase, round(sum(exp(-(x.ix - z.ix) * (x.ix - z.ix) / (2 * x.v)) * z.ix) / sum(exp(-(x.ix - z.ix) * (x.ix - z.ix) / (2 * x.v))), 6) AS shrunk FROM w x JOIN w z ON x.series_id = z.series_id GROUP BY 1, 2"),
)
def _(spark, d):
    return S.shrink(S.trimmed_indices(series(spark, d, MAIN), 12), 12).select("series_id", "phase", r6("lemon_krutchkoff").alias("shrunk"))


@query("fourier_terms", _all("SELECT series_id, t" + "".join(f", round(sin(2 * pi() * {k} / 7 * t), 6) AS s{k}, round(cos(2 * pi() * {k} / 7 * t), 6) AS c{k}" for k in (1, 2, 3)) + " FROM obs", "D_event"))
def _(spark, d):
    return S.fourier(series(spark, d, "D_event"), 7, 3).select("series_id", "t", *[r6(f"{x}{k}").alias(f"{x}{k}") for k in (1, 2, 3) for x in "sc"])


@query("agg_phase_mean", _all("SELECT series_id, CAST((t - 1) % 12 AS BIGINT) AS phase, round(avg(y), 6) AS mean, count(*) AS n FROM obs GROUP BY 1, 2"))
def _(spark, d):
    return series(spark, d, MAIN).groupBy("series_id", ((F.col("t") - 1) % 12).alias("phase")).agg(r6(F.avg("y")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("agg_n_values", _all("SELECT series_id, count(nullif(value, 0)) AS n FROM obs GROUP BY 1"))
def _(spark, d):
    return series(spark, d, MAIN).groupBy("series_id").agg(F.count(F.nullif("value", F.lit(0.0))).alias("n"))


@query("agg_var_sd", _all("SELECT series_id, round(var_samp(y), 6) AS v, round(stddev_samp(y), 6) AS sd FROM obs GROUP BY 1"))
def _(spark, d):
    return series(spark, d, MAIN).groupBy("series_id").agg(r6(F.var_samp("y")).alias("v"), r6(F.stddev_samp("y")).alias("sd"))


@query("agg_row_quantile", _all("SELECT series_id, round(quantile_cont(y, 0.025), 6) AS lo, round(quantile_cont(y, 0.5), 6) AS mid, round(quantile_cont(y, 0.975), 6) AS hi FROM obs GROUP BY 1"))
def _(spark, d):
    return series(spark, d, MAIN).groupBy("series_id").agg(*[r6(F.percentile("y", F.lit(q))).alias(n) for q, n in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))])


@query("set_union_all", f"WITH a AS (SELECT * FROM ({_all('SELECT series_id, t, y FROM obs', 'Q_nation')})), b AS (SELECT * FROM ({_all('SELECT series_id, t, y FROM obs', 'Y_nation')})) SELECT 'Q' AS period, series_id, t, round(y, 6) AS y FROM a UNION ALL SELECT 'Y', series_id, t, round(y, 6) FROM b")
def _(spark, d):
    parts = [series(spark, d, n).select(F.lit(SPECS[n].letter).alias("period"), "series_id", "t", r6("y").alias("y")) for n in ("Q_nation", "Y_nation")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@query("join_lag_self", _all(f"SELECT series_id, t, round(y, 6) AS y, round(lag(y, 12) {_O}, 6) AS before FROM obs QUALIFY before IS NOT NULL"))
def _(spark, d):
    obs = series(spark, d, MAIN)
    return obs.withColumn("before", F.lag("y", 12).over(P.ordered())).where("before is not null").select("series_id", "t", r6("y").alias("y"), r6("before").alias("before"))


@query("reshape_pivot_calendar", _all("SELECT year(ds) AS year" + "".join(f", round(sum(CASE WHEN month(ds) = {k} THEN y END), 6) AS m{k}" for k in range(1, 13)) + ", series_id FROM obs GROUP BY series_id, year(ds)"))
def _(spark, d):
    obs = series(spark, d, MAIN).select("series_id", F.year("ds").cast("long").alias("year"), F.concat(F.lit("m"), F.month("ds")).alias("k"), "y")
    wide = obs.groupBy("series_id", "year").pivot("k", [f"m{k}" for k in range(1, 13)]).agg(F.sum("y"))
    return wide.select("series_id", "year", *[r6(f"m{k}").alias(f"m{k}") for k in range(1, 13)])


@query("join_anti_done", _all("SELECT series_id, t, round(y, 6) AS y FROM obs WHERE series_id NOT IN (SELECT series_id FROM obs WHERE t = 1 AND series_id < 'F')"))
def _(spark, d):
    obs = series(spark, d, MAIN)
    done = obs.where((F.col("t") == 1) & (F.col("series_id") < "F")).select("series_id")
    return obs.join(done, "series_id", "left_anti").select("series_id", "t", r6("y").alias("y"))


@query("semi_select_ids", _all("SELECT series_id, t, round(y, 6) AS y FROM obs WHERE series_id IN (SELECT series_id FROM obs WHERE t = 1 AND series_id < 'F')"))
def _(spark, d):
    obs = series(spark, d, MAIN)
    chosen = obs.where((F.col("t") == 1) & (F.col("series_id") < "F")).select("series_id")
    return obs.join(chosen, "series_id", "left_semi").select("series_id", "t", r6("y").alias("y"))
