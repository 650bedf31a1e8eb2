"""Queries on collections of several frequencies, whose rows go to models by their own season, horizon and length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import routing as G
from ..operators import theta as T
from ..registry import query
from ..sources.files import written
from ..sources.series import SPECS, obs_sql, packed, series
from .arma import theta_arma, theta_arma_sql
from .forecasting import _frame
from .thetas import _BEST, _ahead_sql, variants_sql

#: A collection of each frequency; weekly series count as without season.
SIX = ("Y_nation", "Q_nation", "M_segment", "W_plain", "D_event", "H_event")


def mixed(spark, d, names: tuple[str, ...]) -> DataFrame:
    """(period, series_id, m, h, ys) of several collections in one table."""
    parts = [packed(series(spark, d, n)).select(F.lit(SPECS[n].letter).alias("period"), "series_id", F.lit(SPECS[n].m).alias("m"), F.lit(SPECS[n].h).alias("h"), "ys") for n in names]
    return written(reduce(DataFrame.unionByName, parts), "mixed")


def four_thetas(rows: DataFrame) -> DataFrame:
    """(id, f) for rows (id, ys, m, h): four-theta forecasts with ARMA residuals, by the pairs of m and h that occur."""
    made = []
    for m, h in sorted((r.m, r.h) for r in rows.select("m", "h").distinct().collect()):  # one row a frequency
        own = rows.where((F.col("m") == m) & (F.col("h") == h))
        splits = own.select(F.col("id").alias("series_id"), F.size("ys").cast("long").alias("n"), F.col("ys").alias("train"), F.array().cast("array<double>").alias("test"))
        made.append(theta_arma(splits, m, h).select(F.col("series_id").alias("id"), "f"))
    return reduce(DataFrame.unionByName, made) if made else rows.select("id", F.col("ys").alias("f")).limit(0)


def _one_model(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("id", F.concat_ws("|", "period", "series_id"))
    made = four_thetas(keyed.select("id", "ys", "m", "h")).join(keyed.select("id", "period", "series_id"), "id")
    return made.select("period", "series_id", F.posexplode("f").alias("i", "mean")).select("period", "series_id", (F.col("i") + 1).alias("step"), "mean")


def selected(rows: DataFrame) -> DataFrame:
    """(period, series_id, step, mean, method): series of under 24 values by four-theta, others by the best three of seven."""
    short = F.size("ys") < 24
    few = _one_model(rows.where(short)).withColumn("method", F.lit("four theta"))
    return few.unionByName(G.by_selection(rows.where(~short), four_thetas).withColumn("method", F.lit("three of seven")))


def predilab(rows: DataFrame) -> DataFrame:
    """(period, series_id, step, mean, method) by the season of each row: 1 and 4 by four-theta with ARMA residuals, 24 by the
    seasonal naive forecast of a day or a week, others by `selected`."""
    lines = _one_model(rows.where(F.col("m").isin(1, 4))).withColumn("method", F.lit("theta and arma"))
    hours = rows.where(F.col("m") == 24).withColumn("s", G.hourly_season(rows))
    ahead = F.transform(F.sequence(F.lit(1), F.col("h")), lambda k: F.get("ys", F.size("ys") - F.col("s") + (k - 1) % F.col("s")))
    naive = hours.select("period", "series_id", F.concat(F.lit("season "), F.col("s")).alias("method"), F.posexplode(ahead).alias("i", "mean"))
    naive = naive.select("period", "series_id", (F.col("i") + 1).alias("step"), "mean", "method")
    return lines.unionByName(naive).unionByName(selected(rows.where(~F.col("m").isin(1, 4, 24))))


def _extended(name: str) -> str:
    """`obs_sql` with h values to come, which are null: what is held out is beyond the end then."""
    h = SPECS[name].h
    return obs_sql(name).replace("obs AS (SELECT *", "obs0 AS (SELECT *") + f", obs AS (SELECT series_id, t, y, unit FROM obs0 UNION ALL SELECT series_id, n + s, NULL, NULL FROM (SELECT series_id, max(t) AS n FROM obs0 GROUP BY 1), (SELECT CAST(unnest(range(1, {h + 1})) AS BIGINT) AS s))"


def _lengths(name: str) -> str:
    return f"(WITH {obs_sql(name)} SELECT series_id, count(*) AS size FROM obs GROUP BY 1)"


def _theta_part(name: str, method: str, where: str = "true") -> str:
    inner = theta_arma_sql(name).replace(obs_sql(name), _extended(name))
    return f"SELECT '{SPECS[name].letter}' AS period, f.series_id, f.step, f.mean, '{method}' AS method FROM ({inner}) f JOIN {_lengths(name)} z ON z.series_id = f.series_id WHERE {where}"


def _select_part(name: str) -> str:
    s = SPECS[name]
    four = variants_sql(name, T.THETAS) + _BEST + _ahead_sql("best").replace("round(greatest(", "(greatest(").replace(", 0), 6) AS mean", ", 0)) AS mean")
    models = tuple(m for m in G.SEVEN if m != "four theta")
    frame = lambda obs: f"WITH RECURSIVE {obs}{_frame(s.m, s.h)} SELECT f.series_id, f.model, CAST(f.step AS BIGINT) AS step, f.f, e.y FROM fc f JOIN te e ON e.series_id = f.series_id AND e.step = f.step WHERE f.model IN {models}"
    whole = lambda q: q.replace(obs_sql(name), _extended(name))
    held = f"(WITH RECURSIVE {obs_sql(name)}{_frame(s.m, s.h)} SELECT series_id, step, y FROM te)"
    order = "list_position([" + ", ".join(f"'{m}'" for m in G.SEVEN) + "], model)"
    return f"""SELECT '{s.letter}' AS period, a.series_id, a.step, round(avg(a.f), 6) AS mean, 'three of seven' AS method
FROM ({frame(_extended(name))} UNION ALL SELECT series_id, 'four theta', step, mean, NULL FROM ({whole(four)})) a
JOIN (SELECT * FROM (SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY round(e, 6), {order}) AS k FROM (SELECT series_id, model, avg(coalesce(200 * abs(y - f) / nullif(abs(y) + abs(f), 0), 0)) AS e FROM
  ({frame(obs_sql(name))} UNION ALL SELECT q.series_id, 'four theta', q.step, q.mean, t.y FROM ({four}) q JOIN {held} t ON t.series_id = q.series_id AND t.step = q.step) GROUP BY 1, 2)) WHERE k <= {G.MEMBERS}) b ON b.series_id = a.series_id AND b.model = a.model
JOIN {_lengths(name)} z ON z.series_id = a.series_id WHERE z.size >= 24 GROUP BY 1, 2, 3"""


def _hour_part(name: str) -> str:
    s = SPECS[name]
    return f"""SELECT '{s.letter}' AS period, series_id, CAST(step AS BIGINT) AS step, round(ys[n - s + 1 + (step - 1) % s], 6) AS mean, 'season ' || s AS method FROM (SELECT *, CASE WHEN n > {G.WEEK} + 1 AND vw < vd THEN {G.WEEK} ELSE 24 END AS s FROM
(WITH {obs_sql(name)} SELECT series_id, list(y ORDER BY t) AS ys, count(*) AS n, var_samp(w) AS vw, var_samp(CASE WHEN w IS NOT NULL THEN dd END) AS vd FROM (SELECT *, y - lag(y, {G.WEEK}) OVER v AS w, y - lag(y, 24) OVER v AS dd FROM obs WINDOW v AS (PARTITION BY series_id ORDER BY t)) GROUP BY 1)), (SELECT unnest(range(1, {s.h + 1})) AS step)"""


def _selected_sql(name: str) -> str:
    return _theta_part(name, "four theta", "z.size < 24") + " UNION ALL " + _select_part(name)


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("period", "series_id", F.col("step").cast("long").alias("step"), r6("mean").alias("mean"), "method")


query("predilab", " UNION ALL ".join([*(_theta_part(n, "theta and arma") for n in ("Y_nation", "Q_nation", "W_plain")), _hour_part("H_event"), _selected_sql("M_segment"), _selected_sql("D_event")]))(
    lambda spark, d: _out(predilab(mixed(spark, d, SIX)))
)
#: Yearly series are short, the others are not.
_BY_LENGTH = ("Y_nation", "M_segment", "D_event")
query("predilab_select", " UNION ALL ".join(map(_selected_sql, _BY_LENGTH)))(lambda spark, d: _out(selected(mixed(spark, d, _BY_LENGTH))))
