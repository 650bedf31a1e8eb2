"""Series built from fact tables: one value for each series and period, gaps filled with zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import written


@dataclass(frozen=True)
class SeriesSpec:
    """Where a collection of series comes from, its period, seasonal length m and horizon h."""

    tables: tuple[str, ...]
    keys: tuple[tuple[str, str], ...]
    series: str
    at: str
    value: str
    unit: str
    m: int
    h: int
    letter: str


_ORDERS = (("orders", "customer", "nation"), (("o_custkey", "c_custkey"), ("c_nationkey", "n_nationkey")))

SPECS: dict[str, SeriesSpec] = {
    "M_segment": SeriesSpec(("orders", "customer"), (("o_custkey", "c_custkey"),), "c_mktsegment", "o_orderdate", "o_totalprice", "month", 12, 18, "M"),
    "M_nation": SeriesSpec(*_ORDERS, "n_name", "o_orderdate", "o_totalprice", "month", 12, 18, "M"),
    "Q_nation": SeriesSpec(*_ORDERS, "n_name", "o_orderdate", "o_totalprice", "quarter", 4, 8, "Q"),
    "Y_nation": SeriesSpec(*_ORDERS, "n_name", "o_orderdate", "o_totalprice", "year", 1, 2, "Y"),
    "M_brand": SeriesSpec(("lineitem", "part"), (("l_partkey", "p_partkey"),), "p_brand", "l_shipdate", "l_extendedprice", "month", 12, 18, "M"),
    "W_priority": SeriesSpec(("orders",), (), "o_orderpriority", "o_orderdate", "o_totalprice", "week", 52, 13, "W"),
    "W_plain": SeriesSpec(("orders",), (), "o_orderpriority", "o_orderdate", "o_totalprice", "week", 1, 13, "W"),
    "D_event": SeriesSpec(("events",), (), "event_type", "ts", "value", "day", 7, 7, "D"),
    "H_event": SeriesSpec(("events",), (), "event_type", "ts", "value", "hour", 24, 48, "H"),
}
_STEP = {"quarter": "3 months", "year": "1 year", "month": "1 month", "week": "7 days", "day": "1 day", "hour": "1 hour"}


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def facts(spark: SparkSession, sf_dir: str, spec: SeriesSpec) -> DataFrame:
    """(series_id, ds, value): exact decimal sums by period, aggregated before anything else moves."""
    df = read_table(spark, sf_dir, spec.tables[0])
    for table, (left, right) in zip(spec.tables[1:], spec.keys, strict=True):
        df = df.join(read_table(spark, sf_dir, table), F.col(left) == F.col(right))
    period = F.date_trunc(spec.unit, F.col(spec.at).cast("timestamp")).alias("ds")
    amount = F.sum(F.col(spec.value).cast("decimal(18,2)")).cast("double").alias("value")
    return df.groupBy(F.col(spec.series).cast("string").alias("series_id"), period).agg(amount).where(F.col("series_id").isNotNull() & F.col("ds").isNotNull())


def fill_gaps(sums: DataFrame, unit: str) -> DataFrame:
    """Adds the missing periods between the first and the last of all series, with value 0, and numbers them as t.

    Each series makes its own spine from two bounds, a single row that is joined to the ids.
    """
    bounds = sums.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    spine = sums.select("series_id").distinct().join(F.broadcast(bounds), F.lit(True)).select("series_id", F.explode(F.sequence("lo", "hi", F.expr(f"interval {_STEP[unit]}"))).alias("ds"))
    filled = spine.join(sums, ["series_id", "ds"], "left").select("series_id", "ds", F.coalesce("value", F.lit(0.0)).alias("value"))
    return filled.withColumn("t", F.row_number().over(W.partitionBy("series_id").orderBy("ds")).cast("long"))


def scaled(obs: DataFrame, h: int = 0) -> DataFrame:
    """obs with y, the value over the mean of its series without the last h values, and that mean as unit.

    A series of h values or fewer has no others: its unit is their mean.
    """
    w = W.partitionBy("series_id")
    first = F.avg(F.when(F.col("t") <= F.col("__n") - h, F.col("value"))).over(w)
    made = obs.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("unit", F.coalesce(first, F.avg("value").over(w))).drop("__n")
    return made.withColumn("y", F.try_divide("value", "unit"))


def series(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(series_id, ds, t, value, y, unit) of a named collection: y is the value over the unit of its series.

    The sums are written first, so that the facts are read once.
    """
    spec = SPECS[name]
    held = written(facts(spark, sf_dir, spec), "sums")
    return scaled(fill_gaps(held, spec.unit), spec.h).select("series_id", "ds", "t", "value", "y", "unit")


def packed(obs: DataFrame, value: str = "y") -> DataFrame:
    """(series_id, n, ys): each series as one array, oldest first, and its unit, if it has one.  The length of a series bounds the row."""
    unit = [F.max("unit").alias("unit")] if "unit" in obs.columns else []
    found = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("p"), *unit)
    return found.select("series_id", F.size("p").cast("long").alias("n"), F.transform("p", lambda x: x["v"]).alias("ys"), *(["unit"] if unit else []))


def split(packs: DataFrame, h: int) -> DataFrame:
    """(series_id, n, train, test): the last h values are the test; series of h values or fewer have no row."""
    return packs.where(F.col("n") > h).select(
        "series_id", (F.col("n") - h).alias("n"), F.slice("ys", 1, (F.col("n") - h).cast("int")).alias("train"), F.slice("ys", (F.col("n") - h + 1).cast("int"), h).alias("test"), *[c for c in packs.columns if c == "unit"]
    )


def obs_sql(name: str) -> str:
    """The same collection as common table expressions, the last of which is obs, for DuckDB."""
    s = SPECS[name]
    joins = "".join(f" JOIN {t} ON {a} = {b}" for t, (a, b) in zip(s.tables[1:], s.keys, strict=True))
    return f"""base AS (SELECT CAST({s.series} AS VARCHAR) AS series_id, CAST(date_trunc('{s.unit}', CAST({s.at} AS TIMESTAMP)) AS TIMESTAMP) AS ds,
  CAST(SUM(CAST({s.value} AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {s.tables[0]}{joins} GROUP BY 1, 2),
spine AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '{_STEP[s.unit]}')) AS ds FROM (SELECT DISTINCT series_id FROM base), (SELECT min(ds) lo, max(ds) hi FROM base)),
filled AS (SELECT p.series_id, p.ds, coalesce(b.value, 0.0) AS value, CAST(row_number() OVER (PARTITION BY p.series_id ORDER BY p.ds) AS BIGINT) AS t
  FROM spine p LEFT JOIN base b ON p.series_id = b.series_id AND p.ds = b.ds),
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS many FROM filled),
united AS (SELECT * EXCLUDE (many), coalesce(avg(CASE WHEN t <= many - {s.h} THEN value END) OVER (PARTITION BY series_id), avg(value) OVER (PARTITION BY series_id)) AS unit FROM sized),
obs AS (SELECT *, value / nullif(unit, 0) AS y FROM united)"""
