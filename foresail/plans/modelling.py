"""Queries on models with theta lines, on weights and mixtures, on fitted models, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import numeric
from ..registry import query
from ..sources import files
from ..sources.series import SPECS, obs_sql, packed, read_table, series, split
from ..streaming import events as streaming
from .forecasting import MAIN, benchmark, oracle

_B = "OVER (PARTITION BY series_id)"


@query(
    "combine_mlpol",
    oracle(
        """, lo AS (SELECT f.series_id, f.model, f.step, (e.y - f.f) * (e.y - f.f) AS loss FROM fc f JOIN te e ON e.series_id = f.series_id AND e.step = f.step WHERE f.model IN ('naive2', 'ses', 'theta')),
w(series_id, step, w1, w2, w3, r1, r2, r3, q1, q2, q3) AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT), CAST(1.0/3 AS DOUBLE), CAST(1.0/3 AS DOUBLE), CAST(1.0/3 AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM lo
UNION ALL SELECT series_id, step, CASE WHEN p > 0 THEN p1 / p ELSE 1.0/3 END, CASE WHEN p > 0 THEN p2 / p ELSE 1.0/3 END, CASE WHEN p > 0 THEN p3 / p ELSE 1.0/3 END, r1, r2, r3, q1, q2, q3 FROM
(SELECT *, p1 + p2 + p3 AS p FROM (SELECT *, greatest(r1, 0) / (1 + q1) AS p1, greatest(r2, 0) / (1 + q2) AS p2, greatest(r3, 0) / (1 + q3) AS p3 FROM
(SELECT w.series_id, w.step + 1 AS step, w.r1 + m - a.loss AS r1, w.r2 + m - b.loss AS r2, w.r3 + m - c.loss AS r3, w.q1 + (m - a.loss) * (m - a.loss) AS q1, w.q2 + (m - b.loss) * (m - b.loss) AS q2, w.q3 + (m - c.loss) * (m - c.loss) AS q3 FROM
w JOIN lo a ON a.series_id = w.series_id AND a.step = w.step + 1 AND a.model = 'naive2' JOIN lo b ON b.series_id = w.series_id AND b.step = w.step + 1 AND b.model = 'ses' JOIN lo c ON c.series_id = w.series_id AND c.step = w.step + 1 AND c.model = 'theta', LATERAL (SELECT w.w1 * a.loss + w.w2 * b.loss + w.w3 * c.loss AS m)))))
SELECT series_id, CAST(step + 1 AS BIGINT) AS step, round(w1, 6) AS w_naive2, round(w2, 6) AS w_ses, round(w3, 6) AS w_theta FROM w WHERE step < 18"""
    ),
)
def _(spark, d):
    """Polynomially weighted experts, with learning rates 1 / (1 + sum of squared regrets), before each step."""
    fc, _ = benchmark(spark, d, models=("naive2", "ses", "theta"))
    loss = fc.withColumn("loss", F.pow(F.col("actual") - F.col("mean"), 2))
    wide = loss.groupBy("series_id", "step").pivot("model", ["naive2", "ses", "theta"]).agg(F.max("loss"))
    rows = wide.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("step", "naive2", "ses", "theta"))).alias("ls"))
    third = F.lit(1.0) / 3
    names = ("naive2", "ses", "theta")
    start = F.struct(F.array(third, third, third).alias("w"), F.array(*[F.lit(0.0)] * 3).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("q"), F.array().cast("array<array<double>>").alias("out"))

    def step(s, x):
        mean = F.aggregate(F.zip_with(s["w"], F.array(*[x[n] for n in names]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        regret = F.transform(F.array(*[x[n] for n in names]), lambda v: mean - v)
        r = F.zip_with(s["r"], regret, lambda a, b: a + b)
        q = F.zip_with(s["q"], regret, lambda a, b: a + b * b)
        p = F.zip_with(r, q, lambda a, b: F.greatest(a, F.lit(0.0)) / (1 + b))
        total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
        w = F.when(total > 0, F.transform(p, lambda v: F.try_divide(v, total))).otherwise(F.array(third, third, third))
        return F.struct(w.alias("w"), r.alias("r"), q.alias("q"), F.concat(s["out"], F.array(s["w"])).alias("out"))  # as long as the horizon

    made = rows.select("series_id", F.posexplode(F.aggregate("ls", start, step)["out"]).alias("i", "w"))
    return made.select("series_id", (F.col("i") + 1).cast("long").alias("step"), *[r6(F.get("w", F.lit(k))).alias(f"w_{n}") for k, n in enumerate(names)])


@query(
    "msis_coverage",
    oracle(
        """, iv AS (SELECT series_id, step, min(f) AS lo, max(f) AS hi FROM fc GROUP BY 1, 2)
SELECT i.series_id, round(avg(hi - lo + CASE WHEN e.y < lo THEN 40 * (lo - e.y) ELSE 0 END + CASE WHEN e.y > hi THEN 40 * (e.y - hi) ELSE 0 END) / max(s.scale), 6) AS msis, round(avg(CASE WHEN e.y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM iv i JOIN te e ON e.series_id = i.series_id AND e.step = i.step JOIN sc s ON s.series_id = i.series_id GROUP BY 1"""
    ),
)
def _(spark, d):
    from ..functions.metrics import seasonal_scale

    fc, prepared = benchmark(spark, d)
    iv = fc.groupBy("series_id", "step").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.max("actual").alias("y"))
    scale = prepared.select("series_id", seasonal_scale(F.col("train"), 12).alias("scale"))
    cost = F.col("hi") - F.col("lo") + 40 * F.greatest(F.col("lo") - F.col("y"), F.lit(0.0)) + 40 * F.greatest(F.col("y") - F.col("hi"), F.lit(0.0))
    inside = F.when(F.col("y").between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0)
    return iv.join(scale, "series_id").groupBy("series_id").agg(r6(F.avg(cost) / F.max("scale")).alias("msis"), r6(F.avg(inside)).alias("coverage"))


for _name in numeric.MODELS:

    @query(_name)
    def _(spark, d, name=_name):
        s = SPECS[MAIN]
        made = numeric.fit_each(split(packed(series(spark, d, MAIN)), s.h), [name], s.m, s.h)
        return made.select("series_id", "model", "step", r6("mean").alias("mean"), "status")


@query("snk_src_wide_csv", f"WITH {obs_sql('Q_nation')} SELECT series_id, t, round(y, 6) AS value FROM obs")
def _(spark, d):
    path = files.scratch(spark, "wide-csv")
    files.write_wide(series(spark, d, "Q_nation").select("series_id", "t", r6("y").alias("y")), path)
    return files.read_wide(spark, path).select("series_id", "t", "value")


@query("src_in7_catalogue", "SELECT replace(n_name, ' ', '') AS series_id, CAST(1990 + n_nationkey % 5 AS BIGINT) AS start_year, CAST(1 AS BIGINT) AS start_period, CAST(4 AS BIGINT) AS freq FROM nation")
def _(spark, d):
    path = files.scratch(spark, "in7")
    lines = read_table(spark, d, "nation").select(F.concat(F.lit(">"), F.regexp_replace("n_name", " ", ""), F.lit(" "), 1990 + F.col("n_nationkey") % 5, F.lit(" 1 2015 4 4 0 x 01-01-2020 00:00:00")).alias("value"))
    lines.write.text(path)
    return files.read_catalogue(spark, path).select("series_id", "start_year", "start_period", "freq")


@query(
    "stream_hourly_series",
    "SELECT event_type AS series_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ds, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS n FROM events GROUP BY 1, 2",
)
def _(spark: SparkSession, d: str):
    table = read_table(spark, d, "events")
    stream = streaming.windowed_sums(streaming.event_stream(spark, f"{d}/events.parquet*", table.schema), late=None)
    name = f"hourly_{uuid.uuid4().hex}"
    rows = streaming.run_available(stream, name, files.scratch(spark, "stream"))
    return rows.select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"), "value", "n")
