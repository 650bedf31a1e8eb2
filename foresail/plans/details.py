"""Queries on readers and writers of files, on lookups, and on small steps of preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import r6
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import preparation as P
from ..operators import seasonal as S
from ..registry import query
from ..sources import files
from ..sources.series import obs_sql, packed, read_table, series
from .combining import PERIODS
from .forecasting import MAIN, benchmark, oracle

_B = "OVER (PARTITION BY series_id)"
_NATION = "SELECT n_nationkey AS k, n_name FROM nation"


def _lines(spark, d, value: Column, name: str, header: str | None = None) -> str:
    """The path of a text file with a line for each nation."""
    path = files.scratch(spark, name)
    rows = read_table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    files.write_lines(rows.repartitionByRange(2, "k").sortWithinPartitions("k").select(value.alias("value")), header, path)
    return path


def _letter(letters: str) -> Column:
    return F.substring(F.lit(letters), (1 + F.col("n_nationkey") % len(letters)).cast("int"), F.lit(1))


_LETTER_SQL = "substr('YQMWDHX', 1 + CAST(k % 7 AS INTEGER), 1)"


@query(
    "src_csv_stream_rows",
    f"SELECT {_LETTER_SQL} || k AS series_id, CAST(t AS BIGINT) AS t, CAST(k * t AS DOUBLE) AS value, false AS bad FROM ({_NATION}), (SELECT unnest([1, 2, 4]) AS t) WHERE k % 7 < 6 "
    f"UNION ALL SELECT {_LETTER_SQL} || k || ',' || k || ',' || 2 * k || ',,' || 4 * k, NULL, NULL, true FROM ({_NATION}) WHERE k % 7 = 6",
)
def _(spark, d):
    """Rows of good ids, and the lines of bad ones."""
    k = F.col("k")
    path = _lines(spark, d, F.concat_ws(",", F.concat(_letter("YQMWDHX"), k), k, 2 * k, F.lit(""), 4 * k), "stream-rows")
    rows, bad = files.read_rows(spark, path)
    refused = bad.select(F.col("value").alias("series_id"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("bad"))
    return rows.withColumn("bad", F.lit(False)).unionByName(refused)


@query("src_quoted_csv", f"SELECT 'N, ' || k AS series_id, CAST(t AS BIGINT) AS t, CAST(k + t AS DOUBLE) AS value FROM ({_NATION}), (SELECT unnest([1, 2]) AS t)")
def _(spark, d):
    """Quotes go, and the first blank ends a series."""
    k, q = F.col("k"), F.lit('"')
    cells = [F.concat(q, x, q) for x in (F.concat(F.lit("N, "), k), (k + 1).cast("string"), (k + 2).cast("string"), F.lit(""), (k + 9).cast("string"))]
    path = _lines(spark, d, F.concat_ws(",", *cells), "quoted", "V1,V2,V3,V4,V5")
    return files.until_blank(files.read_wide(spark, path))


@query("src_headerless_csv", f"SELECT CAST(dense_rank() OVER (ORDER BY k) AS VARCHAR) AS series_id, CAST(t AS BIGINT) AS t, CAST(k * 10 + t AS DOUBLE) AS value FROM ({_NATION}), (SELECT unnest([1, 2, 3]) AS t)")
def _(spark, d):
    return files.read_matrix(spark, _lines(spark, d, F.concat_ws(",", *[F.col("k") * 10 + t for t in (1, 2, 3)]), "matrix"))


@query("src_matlab_table", f"SELECT n_name AS series_id, CAST(t AS BIGINT) AS t, k + t / 2.0 AS value FROM (SELECT CAST(n_nationkey AS DOUBLE) AS k, n_name FROM nation), (SELECT unnest([1, 2]) AS t)")
def _(spark, d):
    """A header, and numbers without quotes."""
    return files.read_wide(spark, _lines(spark, d, F.concat_ws(",", "n_name", F.col("k") + 0.5, F.col("k") + 1.0), "table", "V1,V2,V3"))


@query("src_forecastpro_import", "SELECT 'Q' || n_nationkey AS series_id, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS place, CAST(n_nationkey + 0.5 AS DOUBLE) AS f1, CAST(n_nationkey + 1.5 AS DOUBLE) AS f2 FROM nation")
def _(spark, d):
    """Forecasts from outside: ids are trimmed and put in natural order, the steps become a vector."""
    k = F.col("k")
    path = _lines(spark, d, F.concat_ws(",", F.concat(F.lit("  Q"), k, F.lit(" ")), k + 0.5, k + 1.5), "external", "id,F1,F2")
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    vectors = rows.select(F.trim("id").alias("series_id"), F.array(*[F.col(c).cast("double") for c in rows.columns[1:]]).alias("f"))
    keyed = vectors.withColumn("head", F.substring("series_id", 1, 1)).withColumn("number", F.expr("cast(substr(series_id, 2) as int)"))
    return files.placed(keyed, ["head", "number"], "external-order").select("series_id", "place", F.get("f", F.lit(0)).alias("f1"), F.get("f", F.lit(1)).alias("f2"))


@query("src_synthetic_linear")
def _(spark, d):
    """A hundred series of twenty points 2 + 0.15 t with normal noise."""
    rows = spark.range(100).select(F.concat(F.lit("S"), F.col("id")).alias("series_id"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("t"))
    return rows.select("series_id", F.col("t").cast("long").alias("t"), (2 + 0.15 * F.col("t") + F.randn(42)).alias("y"))


@query("src_synthetic_uniform")
def _(spark, d):
    """A hundred series of twenty points: 10 times the number of the series, and a whole number from 0 to 100."""
    rows = spark.range(100).select("id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("t"))
    return rows.select(F.concat(F.lit("S"), F.col("id")).alias("series_id"), F.col("t").cast("long").alias("t"), (10.0 * F.col("id") + F.floor(101 * F.rand(42))).alias("y"))


@query("snk_checkpoint_chunk", oracle("SELECT series_id, CAST(step AS BIGINT) AS step, round(f, 6) AS mean, series_id < 'F' AS first_run FROM fc WHERE model = 'ses'"))
def _(spark, d):
    """A first run that ended early has written some series; the second writes those that are missing, and nothing twice."""
    fc = benchmark(spark, d, models=("ses",))[0].select("series_id", "step", r6("mean").alias("mean"))
    path = files.scratch(spark, "chunks")
    fc.where("series_id < 'F'").write.parquet(f"{path}/run=1")
    done = spark.read.schema("series_id string").parquet(f"{path}/run=1").select("series_id").distinct()
    fc.join(done, "series_id", "left_anti").write.parquet(f"{path}/run=2")
    rows = spark.read.schema("series_id string, step long, mean double, run int").parquet(path)
    return rows.select("series_id", "step", "mean", (F.col("run") == 1).alias("first_run"))


@query("snk_per_series_file", oracle("SELECT series_id, count(*) AS n, round(sum(f), 6) AS total FROM fc WHERE model = 'ses' GROUP BY 1"))
def _(spark, d):
    """A folder for each series from one partitioned write, read back as one table."""
    fc = benchmark(spark, d, models=("ses",))[0].select("series_id", "step", "mean")
    path = files.scratch(spark, "per-series")
    fc.repartition("series_id").write.partitionBy("series_id").parquet(path)
    return spark.read.schema("step long, mean double, series_id string").parquet(path).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("mean")).alias("total"))


_DIRECT = f"WITH {obs_sql(MAIN)}, al AS (SELECT *, count(*) {_B} AS n FROM obs), pr AS (SELECT a.series_id, b.t - a.t AS step, a.y AS x, b.y AS v FROM al a JOIN al b ON b.series_id = a.series_id AND b.t > a.t AND b.t <= a.t + 6), fit AS (SELECT series_id, step, regr_intercept(v, x) AS a, regr_slope(v, x) AS b FROM pr GROUP BY 1, 2)"


def direct_lines(obs: DataFrame, h: int) -> DataFrame:
    """(series_id, step, a, b): for each step ahead a line from a value to that many later."""
    later = W.partitionBy("series_id").orderBy("t")
    pairs = obs.withColumn("v", F.array(*[F.lead("y", k).over(later) for k in range(1, h + 1)])).select("series_id", "y", F.posexplode("v").alias("i", "v"))
    return pairs.where("v is not null").groupBy("series_id", (F.col("i") + 1).cast("long").alias("step")).agg(F.regr_intercept("v", "y").alias("a"), F.regr_slope("v", "y").alias("b"))


@query("snk_model_store", _DIRECT + " SELECT 'M' AS period, CAST(n AS BIGINT) AS length, f.series_id, CAST(step AS BIGINT) AS step, round(a, 6) AS a, round(b, 6) AS b FROM fit f JOIN (SELECT DISTINCT series_id, n FROM al) z ON z.series_id = f.series_id")
def _(spark, d):
    """Fitted lines by period, length and step, written as a table and read again."""
    obs = series(spark, d, MAIN)
    fits = direct_lines(obs, 6).join(obs.groupBy("series_id").agg(F.count(F.lit(1)).alias("length")), "series_id")
    path = files.scratch(spark, "models")
    fits.withColumn("period", F.lit("M")).write.partitionBy("period", "step").parquet(path)
    kept = spark.read.schema("series_id string, a double, b double, length long, period string, step long").parquet(path)
    return kept.select("period", "length", "series_id", "step", r6("a").alias("a"), r6("b").alias("b"))


@query("direct_multistep", _DIRECT + " SELECT f.series_id, CAST(step AS BIGINT) AS step, round(a + b * y, 6) AS mean FROM fit f JOIN al l ON l.series_id = f.series_id AND l.t = l.n")
def _(spark, d):
    """A model of its own for each step: what a stored line makes of the last value."""
    obs = series(spark, d, MAIN)
    path = files.scratch(spark, "models")
    direct_lines(obs, 6).write.parquet(path)
    last = obs.groupBy("series_id").agg(F.max_by("y", "t").alias("y"))
    return spark.read.parquet(path).join(last, "series_id").select("series_id", "step", r6(F.col("a") + F.col("b") * F.col("y")).alias("mean"))


@query("src_model_store", _DIRECT + " SELECT CAST(step AS BIGINT) AS step, count(*) AS models, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM fit WHERE step <= 3 GROUP BY 1")
def _(spark, d):
    """Reads the stored models of some steps only: the others' folders are not opened."""
    path = files.scratch(spark, "models")
    direct_lines(series(spark, d, MAIN), 6).write.partitionBy("step").parquet(path)
    kept = spark.read.schema("series_id string, a double, b double, step long").parquet(path).where("step <= 3")
    return kept.groupBy("step").agg(F.count(F.lit(1)).alias("models"), r6(F.avg("a")).alias("a"), r6(F.avg("b")).alias("b"))


@query("recursive_multistep", f"WITH RECURSIVE {obs_sql(MAIN)}, pr AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS x FROM obs), fit AS (SELECT series_id, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, max_by(y, t) AS y FROM pr GROUP BY 1), rc(series_id, step, a, b, f) AS (SELECT series_id, 1, a, b, a + b * y FROM fit UNION ALL SELECT series_id, step + 1, a, b, a + b * f FROM rc WHERE step < 18) SELECT series_id, CAST(step AS BIGINT) AS step, round(f, 6) AS mean FROM rc")
def _(spark, d):
    """A line from a value to the next, fed with its own forecasts."""
    fit = direct_lines(series(spark, d, MAIN), 1).select("series_id", "a", "b").join(series(spark, d, MAIN).groupBy("series_id").agg(F.max_by("y", "t").alias("y")), "series_id")
    ahead = F.aggregate(F.sequence(F.lit(1), F.lit(18)), F.array("y"), lambda f, _: F.concat(f, F.array(F.col("a") + F.col("b") * F.element_at(f, -1))))  # as long as the horizon
    return fit.select("series_id", F.posexplode(F.slice(ahead, 2, 18)).alias("i", "f")).select("series_id", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


@query("prep_drop_na", f"WITH {obs_sql('D_event')} SELECT series_id, count(*) AS n, round(avg(y), 6) AS mean FROM obs WHERE y > 1 GROUP BY 1")
def _(spark, d):
    """Values of 1 or less count as missing here."""
    own = packed(series(spark, d, "D_event").withColumn("y", F.when(F.col("y") > 1, F.col("y")))).withColumn("ys", F.filter("ys", lambda y: y.isNotNull()))
    return own.select("series_id", F.size("ys").cast("long").alias("n"), r6(R.mean_of(F.col("ys"))).alias("mean"))


_LETTERED = f"SELECT substr('YQMWDH', 1 + CAST(n_nationkey % 6 AS INTEGER), 1) || n_nationkey AS series_id, n_name FROM nation"


def _lettered(spark, d) -> DataFrame:
    return read_table(spark, d, "nation").select(F.concat(_letter("YQMWDH"), F.col("n_nationkey").cast("string")).alias("series_id"), "n_name")


@query("prep_filter_period", f"SELECT series_id FROM ({_LETTERED}) WHERE substr(series_id, 1, 1) = 'M'")
def _(spark, d):
    return _lettered(spark, d).where(F.col("series_id").startswith("M")).select("series_id")


@query("agg_distinct", f"SELECT DISTINCT substr(series_id, 1, 1) AS period FROM ({_LETTERED})")
def _(spark, d):
    return _lettered(spark, d).select(F.substring("series_id", 1, 1).alias("period")).distinct()


@query("join_meta", f"SELECT series_id, n_name, CAST([6, 8, 18, 13, 14, 48][strpos('YQMWDH', substr(series_id, 1, 1))] AS BIGINT) AS h, CAST([1, 4, 12, 52, 7, 24][strpos('YQMWDH', substr(series_id, 1, 1))] AS BIGINT) AS m FROM ({_LETTERED})")
def _(spark, d):
    """The horizon and season of each id from a table of six rows."""
    info = spark.createDataFrame([(k, h, m) for k, (h, m) in PERIODS.items()], "letter string, h long, m long")
    ids = _lettered(spark, d).withColumn("letter", F.substring("series_id", 1, 1))
    return ids.join(F.broadcast(info), "letter").select("series_id", "n_name", "h", "m")


@query("join_id_lookup", f"WITH t AS (SELECT series_id, row_number() OVER (ORDER BY series_id) AS place FROM ({_LETTERED})) SELECT i.name AS series_id, CAST(t.place AS BIGINT) AS place FROM (SELECT unnest(['M2', 'Q1', 'Y0', 'Z9']) AS name) i LEFT JOIN t ON t.series_id = i.name")
def _(spark, d):
    """The place of each wanted id in a sorted list, null where it isn't there."""
    wanted = spark.createDataFrame([(x,) for x in ("M2", "Q1", "Y0", "Z9")], "series_id string")
    return wanted.join(files.placed(_lettered(spark, d).select("series_id"), ["series_id"], "ids"), "series_id", "left").select("series_id", "place")


@query("join_horizon_extend", f"WITH {obs_sql(MAIN)}, la AS (SELECT series_id, max_by(y, t) AS level FROM obs GROUP BY 1) SELECT series_id, CAST(step AS BIGINT) AS step, round(level, 6) AS mean FROM la, (SELECT unnest(range(1, 19)) AS step)")
def _(spark, d):
    last = series(spark, d, MAIN).groupBy("series_id").agg(F.max_by("y", "t").alias("level"))
    return last.withColumn("step", F.explode(M.steps_of(18))).select("series_id", F.col("step").cast("long").alias("step"), r6("level").alias("mean"))


@query("join_phase", f"WITH {obs_sql('D_event')}, ph AS (SELECT series_id, (t - 1) % 7 AS phase, avg(y) AS p FROM obs GROUP BY 1, 2) SELECT o.series_id, o.t, round(p.p, 6) AS p FROM obs o JOIN ph p ON p.series_id = o.series_id AND p.phase = (o.t - 1) % 7")
def _(spark, d):
    """The mean of its phase beside each value; both sides are dealt by series and phase once."""
    obs = series(spark, d, "D_event").withColumn("phase", (F.col("t") - 1) % 7)
    return obs.select("series_id", "t", r6(F.avg("y").over(W.partitionBy("series_id", "phase"))).alias("p"))


@query("agg_count_by_cluster", oracle(", b AS (SELECT series_id, model AS cluster, row_number() OVER (PARTITION BY series_id ORDER BY smape, model) AS k FROM er) SELECT cluster, count(*) AS n FROM b WHERE k = 1 GROUP BY 1", "M_nation"))
def _(spark, d):
    """Series by the model that fits them best."""
    fc, prepared = benchmark(spark, d, "M_nation")
    return E.best_models(E.scores(fc, prepared, 12), 1).groupBy(F.col("model").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("limit_head_tail", f"WITH {obs_sql(MAIN)}, al AS (SELECT *, count(*) {_B} AS n FROM obs) SELECT series_id, round(avg(CASE WHEN t <= 3 THEN y END), 6) AS head, round(avg(CASE WHEN t > n - 3 THEN y END), 6) AS tail FROM al GROUP BY 1")
def _(spark, d):
    own = packed(series(spark, d, MAIN))
    return own.select("series_id", r6(R.mean_of(F.slice("ys", 1, 3))).alias("head"), r6(R.mean_of(F.slice("ys", -3, 3))).alias("tail"))


@query("order_by_sum_desc_top3", oracle(", z AS (SELECT series_id, model, row_number() OVER (PARTITION BY series_id ORDER BY round(smape + mase, 9) DESC, model) AS k FROM er WHERE model NOT IN ('naive', 'snaive')) SELECT series_id, model, CAST(k AS BIGINT) AS place FROM z WHERE k <= 3"))
def _(spark, d):
    """The three with the largest sum of two figures, among those that are not kept anyway."""
    fc, prepared = benchmark(spark, d)
    s = E.scores(fc, prepared, 12).where(~F.col("model").isin("naive", "snaive"))
    place = F.row_number().over(W.partitionBy("series_id").orderBy(F.round(F.col("smape") + F.col("mase"), 9).desc(), "model"))
    return s.withColumn("place", place.cast("long")).where("place <= 3").select("series_id", "model", "place")


#: Columns that a table may have at most.
TRANSPOSED = 5000


@query("reshape_transpose", f"WITH {obs_sql('D_event')}, i AS (SELECT t, " + ", ".join(f"round(max(CASE WHEN k = {k} THEN y END), 6) AS s{k}" for k in range(1, 6)) + " FROM (SELECT *, dense_rank() OVER (ORDER BY series_id) AS k FROM obs) GROUP BY 1) SELECT * FROM i")
def _(spark, d):
    """Points in time as rows and all series as columns; more than TRANSPOSED series are an error, not left out."""
    obs = series(spark, d, "D_event")
    ids = files.placed(obs.select("series_id").distinct(), ["series_id"], "columns")
    n = ids.count()
    if n > TRANSPOSED:
        raise ValueError(f"{n} series are too many for columns")
    places = range(1, n + 1)
    wide = obs.join(ids, "series_id").groupBy("t").pivot("place", list(places)).agg(F.max("y"))
    return wide.select("t", *[r6(F.col(f"`{k}`")).alias(f"s{k}") for k in places])


@query("prep_shuffle")
def _(spark, d):
    """Rows in the order of a seeded hash: the same on every run and every cluster."""
    rows = series(spark, d, "D_event").select("series_id", "t", "y")
    return files.placed(rows.withColumn("h", F.xxhash64(F.lit(42), "series_id", "t")), ["h", "series_id", "t"], "shuffled").select("series_id", "t", "y", "place")


@query("sample_rows")
def _(spark, d):
    """A tenth of the rows in the mean, each with the same chance."""
    return series(spark, d, "D_event").select("series_id", "t", "y").sample(0.1, 42)


@query("prep_round4", oracle("SELECT series_id, CAST(step AS BIGINT) AS step, round(f, 4) AS mean FROM fc WHERE model = 'theta'"))
def _(spark, d):
    return benchmark(spark, d, models=("theta",))[0].select("series_id", "step", F.round("mean", 4).alias("mean"))


_POWERS = [round(0.05 * k, 2) for k in range(21)]


def guerrero(ys: Column, m: int, powers: list[float] = _POWERS) -> Column:
    """The power of the grid that varies sd / mean ** (1 - power) least over stretches of m values that end with the last one."""
    first = F.size(ys) % m
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(ys) / m).cast("int") - 1), lambda i: F.slice(ys, first + i * m + 1, m))

    def facts(b: Column) -> Column:
        return R.let(R.mean_of(b), lambda mean: F.struct(mean.alias("mean"), F.sqrt(F.aggregate(b, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (m - 1)).alias("sd")))

    def variation(r: Column) -> Column:
        return R.let(R.mean_of(r), lambda mean: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (F.size(r) - 1)) / mean)

    def best(known: Column) -> Column:
        at = lambda p: variation(F.transform(known, lambda f: f["sd"] / F.pow(f["mean"], 1 - p)))
        return F.array_min(F.transform(F.array(*map(F.lit, powers)), lambda p: F.struct(F.round(at(p), 9).alias("v"), p.alias("p"))))["p"]

    return F.when((F.size(ys) >= 2 * m) & F.forall(ys, lambda y: y > 0), R.let(F.transform(blocks, facts), best))


_GRID_SQL = f"(SELECT CAST(unnest({_POWERS}) AS DOUBLE) AS p)"


@query(
    "prep_boxcox_lambda_guerrero",
    f"WITH {obs_sql('Q_nation')}, al AS (SELECT *, count(*) {_B} AS n FROM obs), ok AS (SELECT series_id FROM al GROUP BY 1 HAVING min(y) > 0), bl AS (SELECT series_id, CAST(floor((t - 1 - n % 4) / 4) AS BIGINT) AS b, avg(y) AS mean, stddev_samp(y) AS sd FROM al WHERE t > n % 4 GROUP BY 1, 2), "
    f"r AS (SELECT b.series_id, g.p, sd / pow(mean, 1 - g.p) AS r FROM bl b, {_GRID_SQL} g), v AS (SELECT series_id, p, round(stddev_samp(r) / avg(r), 9) AS v FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v, p) AS k FROM v) SELECT o.series_id, CASE WHEN o2.series_id IS NOT NULL THEN p END AS power FROM k o LEFT JOIN ok o2 ON o2.series_id = o.series_id WHERE k = 1",
)
def _(spark, d):
    return packed(series(spark, d, "Q_nation")).select("series_id", guerrero(F.col("ys"), 4).alias("power"))


@query(
    "prep_boxcox_lambda_loglik",
    f"WITH {obs_sql('Q_nation')}, ok AS (SELECT series_id FROM obs GROUP BY 1 HAVING min(y) > 0), x AS (SELECT o.series_id, g.p, CASE WHEN g.p = 0 THEN ln(y) ELSE (pow(y, g.p) - 1) / CASE WHEN g.p = 0 THEN 1 ELSE g.p END END AS x, ln(y) AS l FROM obs o JOIN ok ON ok.series_id = o.series_id, {_GRID_SQL} g), "
    "v AS (SELECT series_id, p, round(count(*) / 2.0 * ln(var_pop(x)) - (p - 1) * sum(l), 9) AS v FROM x GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v, p) AS k FROM v) SELECT series_id, p AS power FROM k WHERE k = 1",
)
def _(spark, d):
    """The power of the grid with the largest profile likelihood of values about their mean."""
    rows = series(spark, d, "Q_nation").withColumn("low", F.min("y").over(P.by_series())).where("low > 0")
    kinds = [F.struct(F.lit(p).alias("p"), P.box_cox(F.col("y"), p).alias("x")) for p in _POWERS]
    made = rows.select("series_id", F.ln("y").alias("l"), F.explode(F.array(*kinds)).alias("k")).select("series_id", "l", "k.p", "k.x")
    cost = F.round(F.count(F.lit(1)) / 2 * F.ln(F.var_pop("x")) - (F.first("p") - 1) * F.sum("l"), 9)
    return made.groupBy("series_id", "p").agg(cost.alias("v")).groupBy("series_id").agg(F.min(F.struct("v", "p"))["p"].alias("power"))


@query(
    "prep_log_retry_if_negative",
    f"WITH {obs_sql('D_event')}, l AS (SELECT series_id, count(*) AS n, min(y) AS low, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_slope(ln(CASE WHEN y > 0 THEN y END), t) AS lb, regr_intercept(ln(CASE WHEN y > 0 THEN y END), t) AS la FROM obs GROUP BY 1), f AS (SELECT *, a + b * (n + step) AS f, exp(la + lb * (n + step)) AS e FROM l, (SELECT unnest(range(1, 201)) AS step)), "
    "w AS (SELECT *, min(f) OVER (PARTITION BY series_id) < 0 AND low > 0 AS again FROM f) SELECT series_id, CAST(step AS BIGINT) AS step, again, round(CASE WHEN again THEN e ELSE f END, 6) AS mean FROM w",
)
def _(spark, d):
    """Lines far ahead: where one falls below zero, a line of the logarithms is taken in its place."""
    ahead = lambda ys: R.let(M.line_of(ys), lambda x: F.transform(M.steps_of(200), lambda s: x["intercept"] + x["slope"] * (F.size(ys) + s)))
    own = packed(series(spark, d, "D_event")).withColumn("f", ahead(F.col("ys"))).withColumn("logs", F.when(F.forall("ys", lambda y: y > 0), F.transform("ys", lambda y: F.ln(F.when(y > 0, y)))))
    again = F.exists("f", lambda x: x < 0) & F.col("logs").isNotNull()
    made = own.withColumn("again", again).withColumn("f", F.when(F.col("again"), F.transform(ahead(F.col("logs")), F.exp)).otherwise(F.col("f")))
    return made.select("series_id", "again", F.posexplode("f").alias("i", "f")).select("series_id", (F.col("i") + 1).cast("long").alias("step"), "again", r6("f").alias("mean"))


#: Random walks of orders 0, 1 and 2 of (series_id, ys): that whose differences vary least, with its upper bounds.
_WALKS = """d AS (SELECT *, z - lag(z) OVER w AS d1 FROM zs WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY series_id, kind ORDER BY t) AS d2 FROM d), s AS (SELECT series_id, kind, avg(z) AS m, stddev_samp(z) AS s0, sqrt(avg(d1 * d1)) AS s1, sqrt(avg(d2 * d2)) AS s2, max_by(z, t) AS last, max_by(d1, t) AS slope FROM e GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN s2 < least(s0, s1) THEN 2 WHEN s1 < s0 THEN 1 ELSE 0 END AS k FROM s, (SELECT unnest(range(1, 19)) AS step)), v AS (SELECT *, CASE k WHEN 0 THEN m + 1.96 * s0 WHEN 1 THEN last + 1.96 * s1 * sqrt(step) ELSE last + step * slope + 1.96 * s2 * sqrt(step * (step + 1) * (2 * step + 1) / 6.0) END AS up FROM u),
g AS (SELECT *, max(CASE WHEN step = 1 THEN up END) OVER w AS u1, max(CASE WHEN step = 2 THEN up END) OVER w AS u2, max(CASE WHEN step = 18 THEN up END) OVER w AS u18 FROM v WINDOW w AS (PARTITION BY series_id, kind))"""


@query(
    "prep_explosive_upper_fix",
    f"WITH {obs_sql(MAIN)}, c1 AS (SELECT series_id, t, y, sum(y - 1) OVER (PARTITION BY series_id ORDER BY t) AS c FROM obs), zs AS (SELECT series_id, 'values' AS kind, t, y AS z FROM c1 UNION ALL SELECT series_id, 'twice summed', t, sum(c) OVER (PARTITION BY series_id ORDER BY t) FROM c1), {_WALKS} "
    "SELECT series_id, kind, CAST(k AS BIGINT) AS differences, CAST(step AS BIGINT) AS step, round(CASE WHEN k > 1 AND u18 / nullif(u1, 0) > 10 THEN (u1 + u2) / 2 * (1 + 0.025 * (step - 1)) ELSE up END, 6) AS upper FROM g",
)
def _(spark, d):
    """Upper bounds of random walks of the order whose differences vary least; those of two differences that explode grow by a fortieth a step.

    The series, and twice summed what they are above their unit, which takes two differences.
    """
    own = packed(series(spark, d, MAIN)).select("series_id", "ys")
    sums = lambda xs: F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, 1, i + 1), F.lit(0.0), lambda a, x: a + x))
    twice = R.let(R.let(F.transform("ys", lambda y: y - 1), sums), sums)
    kinds = F.array(F.struct(F.lit("values").alias("kind"), F.col("ys").alias("z")), F.struct(F.lit("twice summed").alias("kind"), twice.alias("z")))
    rows = own.select("series_id", F.explode(kinds).alias("x")).select("series_id", "x.kind", "x.z")
    gaps = lambda xs: R.let(xs, lambda x: F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda a, b: a - b))
    root = lambda xs: F.sqrt(R.mean_of(F.transform(xs, lambda x: x * x)))
    rows = rows.withColumn("d1", gaps(F.col("z"))).withColumn("d2", gaps(F.col("d1"))).withColumn("m", R.mean_of(F.col("z")))
    rows = rows.withColumn("s0", root(R.deviations(F.col("z"))) * F.sqrt(F.size("z") / (F.size("z") - 1))).withColumn("s1", root(F.col("d1"))).withColumn("s2", root(F.col("d2")))
    rows = rows.withColumn("k", F.when(F.col("s2") < F.least("s0", "s1"), 2).when(F.col("s1") < F.col("s0"), 1).otherwise(0))
    last, slope = F.element_at("z", -1), F.element_at("d1", -1)
    at = lambda s: F.when(F.col("k") == 0, F.col("m") + 1.96 * F.col("s0")).when(F.col("k") == 1, last + 1.96 * F.col("s1") * F.sqrt(s)).otherwise(last + s * slope + 1.96 * F.col("s2") * F.sqrt(s * (s + 1) * (2 * s + 1) / 6))
    made = rows.withColumn("up", F.transform(M.steps_of(18), at)).select("series_id", "kind", "k", F.posexplode(tame_upper(F.col("up"), F.col("k"))).alias("i", "u"))
    return made.select("series_id", "kind", F.col("k").cast("long").alias("differences"), (F.col("i") + 1).cast("long").alias("step"), r6("u").alias("upper"))


def tame_upper(upper: Column, differences: Column) -> Column:
    """Bounds whose last is over ten times the first, where the model differences more than once: the mean of the first two, growing by 0.025 of it a step."""
    start = (F.get(upper, F.lit(0)) + F.get(upper, F.lit(1))) / 2
    wild = (differences > 1) & (F.try_divide(F.element_at(upper, -1), F.get(upper, F.lit(0))) > 10)
    return F.when(wild, F.transform(upper, lambda u, i: start * (1 + 0.025 * i))).otherwise(upper)


@query(
    "win_ma_python_parity",
    f"WITH {obs_sql('D_event')}, al AS (SELECT *, count(*) {_B} AS n FROM obs), w AS (SELECT *, avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS odd, (avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)) / 2 AS two FROM al) "
    "SELECT series_id, t, CASE WHEN t > 3 AND t <= n - 3 THEN round(odd, 6) END AS corrected, CASE WHEN n % 2 = 0 AND t > 4 AND t <= n - 3 THEN round(two, 6) WHEN n % 2 = 1 AND t > 3 AND t <= n - 3 THEN round(odd, 6) END AS legacy FROM w",
)
def _(spark, d):
    """A centred average of seven; `legacy` averages two of them where the series, not the window, has an even length."""
    obs, w = series(spark, d, "D_event").withColumn("n", F.count(F.lit(1)).over(P.by_series())), P.ordered()
    odd = F.avg("y").over(w.rowsBetween(-3, 3))
    two = (odd + F.avg("y").over(w.rowsBetween(-4, 2))) / 2
    inside = lambda a: (F.col("t") > a) & (F.col("t") <= F.col("n") - 3)
    legacy = F.when((F.col("n") % 2 == 0) & inside(4), two).when((F.col("n") % 2 == 1) & inside(3), odd)
    return obs.select("series_id", "t", r6(F.when(inside(3), odd)).alias("corrected"), r6(legacy).alias("legacy"))


@query(
    "deseasonalize_py",
    f"WITH {obs_sql('D_event')}, al AS (SELECT *, count(*) {_B} AS n FROM obs), w AS (SELECT *, CASE WHEN t > 3 AND t <= n - 3 THEN 100 * y / avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS le FROM al), "
    "p AS (SELECT series_id, (t - 1) % 7 AS phase, avg(le) AS p FROM w GROUP BY 1, 2) SELECT series_id, CAST(phase AS BIGINT) AS phase, round(p / (sum(p) OVER (PARTITION BY series_id) / 700), 6) AS percent FROM p",
)
def _(spark, d):
    """Seasonal indices in percent, that sum to 100 times their number."""
    made = S.centered_average(series(spark, d, "D_event"), 7).withColumn("phase", (F.col("t") - 1) % 7)
    means = made.groupBy("series_id", "phase").agg(F.avg(F.try_divide(100 * F.col("y"), F.col("trend"))).alias("p"))
    return means.select("series_id", "phase", r6(F.col("p") / (F.sum("p").over(W.partitionBy("series_id")) / 700)).alias("percent"))


@query("rec_039_h", f"WITH {obs_sql('H_event')}, al AS (SELECT *, count(*) {_B} AS n, lag(y, 24) OVER w AS a, lag(y, 168) OVER w AS b FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY t)), v AS (SELECT series_id, max(n) AS n, CASE WHEN var_samp(CASE WHEN b IS NOT NULL THEN y - b END) < var_samp(CASE WHEN b IS NOT NULL THEN y - a END) THEN 168 ELSE 24 END AS m FROM al GROUP BY 1), s AS (SELECT unnest(range(1, 49)) AS step) SELECT v.series_id, CAST(v.m AS BIGINT) AS m, CAST(s.step AS BIGINT) AS step, round(o.y, 6) AS mean FROM v, s, obs o WHERE o.series_id = v.series_id AND o.t = v.n - v.m + 1 + (s.step - 1) % v.m")
def _(spark, d):
    """Seasonal naive by day or week: the season whose differences, over the same points, vary less."""
    obs, w = series(spark, d, "H_event"), P.ordered()
    far = obs.withColumn("a", F.lag("y", 24).over(w)).withColumn("b", F.lag("y", 168).over(w))
    spread = lambda c: F.var_samp(F.when(F.col("b").isNotNull(), F.col("y") - F.col(c)))
    chosen = far.groupBy("series_id").agg(F.when(spread("b") < spread("a"), 168).otherwise(24).alias("m"), F.array_sort(F.collect_list(F.struct("t", "y"))).alias("p"))
    at = lambda s: F.get("p", F.size("p") - F.col("m") + (s - 1) % F.col("m"))["y"]
    made = chosen.select("series_id", "m", F.posexplode(F.transform(M.steps_of(48), at)).alias("i", "f"))
    return made.select("series_id", F.col("m").cast("long").alias("m"), (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))
