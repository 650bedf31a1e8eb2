"""Every query against its SQL on the smallest tables, hand-made series, and the independence of the optional package."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail import registry
from foresail.functions import recursions as R
from foresail.operators import evaluation as E
from foresail.operators import models as M
from foresail.operators import numeric, preparation, resampling, seasonal, smoothing
from foresail.operators import theta as T
from foresail.plans import combining, details, selecting, structure
from foresail.sources import files
from foresail.sources.series import fill_gaps, packed, scaled, split

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _clean(v):
    return (None if math.isnan(v) else v + 0.0) if isinstance(v, float) else v


def _rows(rows, names):
    return sorted((tuple(_clean(r[n]) for n in names) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    expected = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    places = [expected.columns.index(n) for n in names]
    assert _rows(found.collect(), names) == _rows([dict(zip(names, (r[p] for p in places), strict=True)) for r in expected.fetchall()], names)


FITTED = {*numeric.MODELS, *combining.RECIPES}


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_models_give_whole_horizons(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == 5 * 18 and all(math.isfinite(r["mean"]) for r in rows)
    assert {r.status for r in rows} == {"ok"}


def obs(spark, **values):
    rows = [(k, t, float(v)) for k, ys in values.items() for t, v in enumerate(ys, 1)]
    return spark.createDataFrame(rows, "series_id string, t long, y double")


def forecast(spark, values, model, m=1, h=4):
    df = packed(obs(spark, a=values)).select(F.col("ys").alias("train"), "ys").select(model(F.col("train"), h).alias("f"))
    return df.head().f


def test_constant_series(spark):
    five = [5] * 24
    for model in (M.naive, lambda y, h: M.ses(y, 0.3, h), lambda y, h: M.holt(y, 0.3, 0.1, h), lambda y, h: M.theta(y, 0.3, h), M.bunch_line):
        assert forecast(spark, five, model) == pytest.approx([5] * 4)


def test_line_is_exact(spark):
    line = [2 + 3 * t for t in range(1, 21)]
    ahead = [2 + 3 * t for t in range(21, 25)]
    assert forecast(spark, line, lambda y, h: M.holt(y, 0.3, 0.1, h)) == pytest.approx(ahead)
    assert forecast(spark, line, M.bunch_line) == pytest.approx(ahead)
    found = packed(obs(spark, a=line)).select(M.line_of(F.col("ys")).alias("l")).head().l
    assert (found.intercept, found.slope) == pytest.approx((2, 3))
    assert numeric.theta_optimised(np.full(20, 5.0), 4) == pytest.approx([5] * 4)
    assert numeric.ar_forecast(np.array(line, float), 4, 2) == pytest.approx(ahead)


def test_pure_season(spark):
    ys = [1, 2, 3, 4] * 10
    table = obs(spark, a=ys)
    assert seasonal.seasonality_test(packed(table), 4).head().is_seasonal
    index = {r.phase: r["index"] for r in seasonal.classical(table, 4).select("phase", "index").distinct().collect()}
    assert sum(index.values()) == pytest.approx(4)
    assert forecast(spark, ys, lambda y, h: M.seasonal_naive(y, 4, h)) == [1, 2, 3, 4]
    assert numeric.temporal_hierarchy(np.array(ys, float), 4, 8) == pytest.approx([1, 2, 3, 4] * 2)
    assert numeric.stl_forecast(np.array(ys, float), 4, 4) == pytest.approx([1, 2, 3, 4], abs=0.2)


def test_short_series_have_no_season(spark):
    assert not seasonal.seasonality_test(packed(obs(spark, a=[1, 2, 3, 4] * 2)), 4).head().is_seasonal
    assert split(packed(obs(spark, a=[1, 2])), 2).count() == 0


def test_forecasts_scale_with_the_data(spark):
    ys = [float(x) for x in np.random.default_rng(5).uniform(1, 9, 30)]
    for model in (M.naive, lambda y, h: M.ses(y, 0.3, h), lambda y, h: M.holt(y, 0.3, 0.1, h, 0.9), lambda y, h: M.theta(y, 0.3, h), M.bunch_line):
        assert [7 * x for x in forecast(spark, ys, model)] == pytest.approx(forecast(spark, [7 * y for y in ys], model))


def test_columns_equal_numpy(spark):
    ys = np.random.default_rng(6).uniform(1, 9, 40)
    level = ys[0]
    for y in ys[1:]:
        level = 0.3 * y + 0.7 * level
    assert packed(obs(spark, a=ys)).select(R.ses_level(F.col("ys"), 0.3).alias("l")).head().l == pytest.approx(level)
    dev = ys - ys.mean()
    r = packed(obs(spark, a=ys)).select(R.acf(R.deviations(F.col("ys")), F.lit(3)).alias("r")).head().r
    assert r == pytest.approx((dev[:-3] * dev[3:]).sum() / (dev * dev).sum())


def test_zero_errors_and_zero_scales_are_null(spark):
    prepared = M.prepare(obs(spark, a=[0.0] * 30), 1, 4)
    rows = E.scores(M.forecasts(prepared, {"naive": M.naive(F.col("train"), 4)}), prepared, 1).head()
    assert rows.smape is None and rows.mase is None


def test_queries_without_sql_are_few_and_give_rows(spark):
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) - FITTED == {"src_synthetic_linear", "src_synthetic_uniform", "prep_shuffle", "sample_rows", "hybrid_theta_seasonal"}
    line = registry.QUERIES["src_synthetic_linear"](spark, SF).toPandas()
    assert len(line) == 2000 and abs((line.y - 2 - 0.15 * line.t).mean()) < 0.1
    uniform = registry.QUERIES["src_synthetic_uniform"](spark, SF).toPandas()
    rest = uniform.y - 10 * uniform.series_id.str[1:].astype(int)
    assert len(uniform) == 2000 and rest.between(0, 100).all() and (rest % 1 == 0).all()
    shuffled = registry.QUERIES["prep_shuffle"](spark, SF).toPandas()
    assert sorted(shuffled.place) == list(range(1, len(shuffled) + 1)) and not shuffled.sort_values("place").t.is_monotonic_increasing
    assert registry.QUERIES["sample_rows"](spark, SF).count() < len(shuffled) / 3
    rows = registry.QUERIES["hybrid_theta_seasonal"](spark, SF).collect()
    assert len(rows) == 90 and all(math.isfinite(r["mean"]) for r in rows)


def value_of(spark, ys, column):
    return packed(obs(spark, a=ys)).withColumn("train", F.col("ys")).select(column.alias("x")).head().x


def test_prepared_series_are_those_of_the_decomposition(spark):
    ys = [x * (1 + 0.02 * k) for k, x in enumerate([1.0, 2.0, 3.0, 4.0, 2.0, 6.0, 1.5] * 8)]
    table = obs(spark, a=ys, b=ys[:30])
    train = table.where("series_id = 'a' and t <= 49 or series_id = 'b' and t <= 23")
    index = {(r.series_id, r.phase): r["index"] for r in seasonal.classical(train, 7).select("series_id", "phase", "index").distinct().collect()}
    flags = {r.series_id: r.is_seasonal for r in seasonal.seasonality_test(packed(train), 7).collect()}
    for r in M.prepare(table, 7, 7).collect():
        assert r.is_seasonal == flags[r.series_id]
        if r.is_seasonal:
            assert r.out == pytest.approx([index[r.series_id, (r.n + k) % 7] for k in range(7)])
            assert r.des == pytest.approx([y / index[r.series_id, t % 7] for t, y in enumerate(r.train)])
    assert flags["a"]


def test_theta_variants_on_lines_and_curves(spark):
    splits = lambda ys: split(packed(obs(spark, a=ys)), 4)
    straight, bent = [2 + 3.0 * t for t in range(1, 25)], [1.1**t for t in range(1, 25)]
    for ys, curve in ((straight, "Lrl"), (bent, "Exp")):
        best = T.four_theta(splits(ys), 1, 4).head()
        assert best.curve == curve and best.theta == 3.0  # of its theta line a third counts, the rest is the curve, which is exact
        assert best.f == pytest.approx(ys[-4:], rel=0.15)
    flat = T.four_theta(splits([5.0] * 24), 1, 4).head()
    assert flat.f == pytest.approx([5] * 4) and flat.mae == pytest.approx(0, abs=1e-9)
    negative = T.four_theta(splits([-y for y in straight]), 1, 4).head()
    assert negative.f == [0.0] * 4 and negative.curve == "Lrl"
    assert T.four_theta(splits([1.0, 2.0, 1.0]), 1, 4).count() == 0


def test_ata_and_dynamic_theta(spark):
    five = [5.0] * 12
    for product in (False, True):
        for fixed in (False, True):
            model = T.ata(F.col("ys"), (0.8, 1.0), product, fixed)
            assert value_of(spark, five, T.ata_ahead(model, 3, product)) == pytest.approx([5] * 3)
    assert value_of(spark, [1.0, -1.0, 2.0], T.ata_ahead(T.ata(F.col("ys"), (1.0,), True), 3, True)) is None
    assert value_of(spark, five, T.dynamic_run(F.col("ys"), 3, F.lit(2.0), F.lit(0.3))["f"]) == pytest.approx([5] * 3)


def test_loess_settling_and_lags(spark):
    line = [2 + 3.0 * t for t in range(20)]
    assert value_of(spark, line, smoothing.loess(F.col("ys"), 0.4)) == pytest.approx(line)
    mixed = [float(x) for x in np.random.default_rng(3).uniform(1, 9, 25)]
    assert value_of(spark, mixed, smoothing.loess(F.col("ys"), 0.4)) == pytest.approx(numeric.loess(np.array(mixed), 0.4))
    rough = [100.0, 100.0, 130.0, 100.0, 100.0]
    rows = spark.createDataFrame([(rough,), ([100.0] * 5,), ([1.0, 90.0, 3.0, 70.0, 2.0],)], "ys array<double>")
    found = smoothing.settle(rows, F.col("ys"), F.lit(100.0), F.lit(100.0), "s", moves=4)
    assert found.count() == 3
    calm = next(r.s for r in found.collect() if r.ys == rough)
    for r in found.collect():
        around = [100.0, *r.s, 100.0]
        assert all(abs(300 * (around[i + 1] + around[i - 1] - 2 * around[i]) / (around[i - 1] + around[i] + around[i + 1])) < 1 + 1e-6 for i in range(1, 6))
    assert smoothing.settle(rows, F.col("ys"), F.lit(100.0), F.lit(100.0), "s", moves=1, most=2).where("s is null").count() == 2
    x = [100.0, *calm, 100.0]
    assert all(abs(300 * (x[i + 1] + x[i - 1] - 2 * x[i]) / (x[i - 1] + x[i] + x[i + 1])) < 1 for i in range(1, 6))
    ys = [1.0, 2.0, 4.0]
    for _ in range(20):
        ys.append(0.5 + 0.4 * ys[-1] - 0.3 * ys[-2] + 0.2 * ys[-3])
    a = value_of(spark, ys, smoothing.linear_lags(F.col("ys")))
    assert (a.c, a.a1, a.a2, a.a3) == pytest.approx((0.5, 0.4, -0.3, 0.2), rel=1e-6)
    assert value_of(spark, ys[:3], smoothing.fed_back(F.col("ys"), smoothing.linear_lags(F.col("ys")), 4)) is None
    assert value_of(spark, [3.0] * 9, smoothing.complex_run(F.col("ys"), 2, F.lit(1.0), F.lit(1.0))["f"]) == pytest.approx([3, 3])


def test_copies_clusters_and_tails(spark):
    ys = [float(x) for x in np.random.default_rng(4).uniform(1, 9, 30)]
    copies = value_of(spark, ys, resampling.block_copies(F.col("ys"), 7, 6))
    t = np.arange(1, 31)
    line = np.polyval(np.polyfit(t, ys, 1), t)
    rest = np.array(ys) - line
    assert len({tuple(c) for c in copies}) > 3
    for c in copies:
        own = np.array(c) - line
        assert all(min(abs(rest - e)) < 1e-9 for e in own)
    two = [[0.0, 0.0]] * 3 + [[9.0, 9.0]] * 3
    groups = spark.createDataFrame([(two,)], "c array<array<double>>").withColumn("d", resampling.distances(F.col("c"))).withColumn("b", resampling.best_medoids(F.col("d"), 2, 6))
    r = groups.withColumn("own", resampling.nearest(F.col("d"), F.col("b.set"))).select("own", resampling.silhouette(F.col("d"), F.col("own")).alias("w")).head()
    assert len(set(r.own[:3])) == len(set(r.own[3:])) == 1 and r.w == pytest.approx(1)
    tail = lambda x, k: spark.range(1).select(resampling.chi_square_tail(F.lit(x), F.lit(k), 10).alias("p")).head().p
    assert (tail(3.841459, 1), tail(5.991465, 2), tail(18.307038, 10)) == pytest.approx((0.05,) * 3, abs=1e-6)


def test_hierarchies_bounds_and_lookups(spark):
    ys = [1.0, 2.0, 3.0, 4.0] * 10
    assert value_of(spark, ys, structure.thief(F.col("ys"), 4, 6, "snaive")) == pytest.approx([1, 2, 3, 4, 1, 2])
    assert value_of(spark, [5.0] * 40, structure.thief(F.col("ys"), 4, 6, "ses")) == pytest.approx([5] * 6)
    up = value_of(spark, [1.0, 3.0, 9.0, 27.0], details.tame_upper(F.col("ys"), F.lit(2)))
    assert up == pytest.approx([2, 2.05, 2.1, 2.15])
    assert value_of(spark, [1.0, 3.0, 9.0, 27.0], details.tame_upper(F.col("ys"), F.lit(1))) == [1, 3, 9, 27]
    for v, q in ((5, 2.5706), (10, 2.2281), (28, 2.0484), (100, 1.984)):
        assert spark.range(1).select(selecting.t_quantile(F.lit(float(v))).alias("q")).head().q == pytest.approx(q, abs=2e-3)
    origins = lambda n, h: spark.range(1).select(selecting.block_origins(F.lit(n).cast("long"), h).alias("o")).head().o
    assert origins(200, 10) == list(range(100, 200, 10)) and origins(60, 6) == list(range(48, 55))


def test_places_need_no_single_task(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    rows = files.placed(df, ["k"], "places").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 1001)) and [r.k for r in rows] == sorted(r.k for r in rows)
    assert files.placed(df.limit(0), ["k"], "places").count() == 0


def test_the_order_of_rows_does_not_matter(spark):
    table = obs(spark, a=range(1, 40), b=[3, 1, 2] * 13)
    mixed = table.orderBy(F.rand(1)).repartition(3)
    assert _rows(packed(table).collect(), ["series_id", "ys"]) == _rows(packed(mixed).collect(), ["series_id", "ys"])


def test_gaps_are_filled(spark):
    sums = spark.sql("select * from values ('a', timestamp'2024-01-01', 1.0d), ('a', timestamp'2024-04-01', 2.0d), ('b', timestamp'2024-02-01', 0.0d) as x(series_id, ds, value)")
    rows = fill_gaps(sums, "month").orderBy("series_id", "t").collect()
    assert [(r.series_id, r.t, r.value) for r in rows] == [("a", 1, 1), ("a", 2, 0), ("a", 3, 0), ("a", 4, 2), *[("b", k, 0) for k in (1, 2, 3, 4)]]
    assert scaled(fill_gaps(sums, "month")).where("series_id = 'b' and y is not null").count() == 0


def test_undifference_inverts(spark):
    rows = preparation.undifference(preparation.difference(obs(spark, a=[3, 1, 4, 1, 5]))).orderBy("t").collect()
    assert [r.back for r in rows] == pytest.approx([3, 1, 4, 1, 5])


def test_wide_files_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('"V1","V2","V3","V4"\n"Y1","1.5","2","0"\n"Y2","7",,\n,,,\n')
    rows = files.read_wide(spark, str(tmp_path / "in.csv")).orderBy("series_id", "t").collect()
    assert [(r.series_id, r.t, r.value) for r in rows] == [("Y1", 1, 1.5), ("Y1", 2, 2.0), ("Y1", 3, 0.0), ("Y2", 1, 7.0)]


def test_entry_works_without_the_optional_package():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('foresail.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'owa' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_stream_of_unordered_files_gives_each_window_once(spark, tmp_path):
    from foresail.streaming import events

    rows = [("a", f"2024-01-{day:02d} 0{hour}:{minute}:00", float(day + hour)) for day in (9, 1, 5) for hour in (3, 1) for minute in (10, 40)]
    table = lambda part: spark.createDataFrame(part, "event_type string, ts string, value double").selectExpr("event_type", "cast(ts as timestamp) ts", "value")
    for i, row in enumerate(rows[::2] + rows[1::2]):  # both halves of an hour come in batches far apart
        table([row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/f{i}.parquet")
    schema = table(rows[:1]).schema
    stream = events.windowed_sums(events.event_stream(spark, f"{tmp_path}/in/*.parquet", schema, files_per_trigger=1), late=None)
    found = events.run_available(stream, "unordered", f"{tmp_path}/state").collect()
    assert sorted((r.ds.day, r.ds.hour, r.value, r.n) for r in found) == sorted((d, h, 2.0 * (d + h), 2) for d in (9, 1, 5) for h in (3, 1))
