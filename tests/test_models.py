"""Regressions, ARMA, states, tests between phases, selection and dispatch on hand-made series with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail import registry
from foresail.operators import arma as A
from foresail.operators import resampling, routing, selection
from foresail.operators import states as S
from foresail.plans import routing as routes
from foresail.sources.series import split

SF = "/root/testdata/sf0.001"


def packs(spark, **values):
    return spark.createDataFrame([(k, len(v), [float(x) for x in v]) for k, v in values.items()], "series_id string, n long, ys array<double>")


def one(df, column):
    return df.select(column.alias("x")).head().x


@pytest.mark.parametrize("k", [1, 3, 8])
def test_regressions_equal_least_squares(spark, k):
    rng = np.random.default_rng(k)
    x, y = rng.normal(size=(40, k)), rng.normal(size=40)
    rows = [[float(v) for v in (*a, b)] for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([(rows,)], "rows array<array<double>>")
    assert one(df, A.regress(F.col("rows"))) == pytest.approx(list(np.linalg.lstsq(x, y, rcond=None)[0]))
    assert one(spark.createDataFrame([([[1.0, 2.0, 3.0]] * 9,)], "rows array<array<double>>"), A.regress(F.col("rows"))) is None


@pytest.mark.parametrize("ar, dies", [([], True), ([0.5], True), ([1.0], False), ([1.2, -0.4], True), ([0.5, 0.6], False), ([0.2, 0.3, 0.4], True), ([-1.1], False)])
def test_stationary_autoregressions(spark, ar, dies):
    assert one(spark.createDataFrame([(ar,)], "a array<double>"), A.is_stationary(F.col("a"))) is dies


def test_arma_of_a_known_process(spark):
    rng = np.random.default_rng(1)
    e, xs = rng.normal(size=3000), [0.0]
    for t in range(1, 3000):
        xs.append(0.7 * xs[-1] + e[t] + 0.4 * e[t - 1])
    rows = spark.createDataFrame([("a", [float(x) for x in xs])], "series_id string, xs array<double>")
    fits = {(r.p, r.q): r for r in A.fit_orders(rows, A.menu_of([(0, 0), (1, 0), (1, 1)]), 1, 12).collect()}
    assert fits[1, 1].a == pytest.approx([0.7, 0.4], abs=0.06)
    assert fits[1, 1].aicc < fits[1, 0].aicc < fits[0, 0].aicc
    ahead = A.fit_orders(rows, A.menu_of([(1, 1)]), 1, 12).withColumn("f", A.forecast(3)).head().f
    assert ahead[1] == pytest.approx(fits[1, 1].a[0] * ahead[0]) and ahead[2] == pytest.approx(fits[1, 1].a[0] * ahead[1])


@pytest.mark.parametrize("q, df, p", [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (2.558212, 10, 0.99), (0.0, 4, 1.0), (50, 10, 2.669083e-07), (400, 10, 0.0), (1000, 10, 0.0), (5000, 9, 0.0)])
def test_tails_of_chi_square(spark, q, df, p):
    row = spark.createDataFrame([(float(q), df)], "q double, d int")
    assert one(row, resampling.chi_square_tail(F.col("q"), F.col("d"), 10)) == pytest.approx(p, abs=1e-6, rel=1e-4)


@pytest.mark.parametrize("t, df, p", [(1.0, 1.0, 0.5), (12.7062, 1.0, 0.05), (2.228139, 10.0, 0.05), (-2.228139, 10.0, 0.05), (0.0, 3.5, 1.0), (3.169273, 10.0, 0.01), (1.959964, 1e6, 0.05), (0.01, 20.0, 0.992120)])
def test_tails_of_students_t(spark, t, df, p):
    row = spark.createDataFrame([(t, df)], "t double, d double")
    assert one(row, S.t_tail(F.col("t"), F.col("d"))) == pytest.approx(p, abs=1e-6)


def test_seasons_found_by_phase(spark):
    noise = np.random.default_rng(2).normal(size=60)
    found = {r.series_id: r.season for r in S.detect_season(packs(spark, three=[10 * (t % 3 == 0) + x for t, x in enumerate(noise)], none=noise, short=[1, 2, 3], flat=[4] * 30), 6).collect()}
    assert found == {"three": 3, "none": 0, "short": 0, "flat": 0}


def test_states_continue_what_they_model(spark):
    wave = [10 + 3 * math.sin(2 * math.pi * t / 7) for t in range(1, 71)]
    got = S.tbats(split(packs(spark, a=wave), 7), 7, 7).head()
    assert got.k >= 1 and got.f == pytest.approx(wave[63:], abs=1e-6)
    day, week = [1.0, 2.0, 0.5], [1, 1, 1, 3, 3, 3, 2, 2, 2]
    both = [day[t % 3] * week[t % 9] for t in range(90)]
    got = S.dshw(split(packs(spark, a=both, zero=[0, *both[1:]]), 9), 3, 9, 9).collect()
    assert [r.series_id for r in got] == ["a"] and got[0].f == pytest.approx(both[81:], abs=1e-6)
    line = S.structural(split(packs(spark, a=[2.0 + 3 * t for t in range(30)]), 3), 3).head()
    assert line.f == pytest.approx([2 + 3 * t for t in range(27, 30)], abs=1e-3)


def test_selection_by_gate_folds_and_length(spark):
    rng = np.random.default_rng(4)
    rows = packs(spark, still=[7] * 40, wild=rng.uniform(1, 100, 40), few=[1, 50, 2, 60, 3, 70, 4], two=[1, 2])
    got = {r.series_id: (r.stage, r.place) for r in selection.choose(rows, 2, 12).collect()}
    assert {k: v[0] for k, v in got.items()} == {"still": "holdout", "wild": "folds", "few": "too short"}
    fc = selection.select_and_forecast(rows, 2, 12)
    assert [(r.mean, r.lower, r.upper) for r in fc.where("series_id = 'still'").collect()] == [(7, 7, 7)] * 2
    assert fc.where("series_id = 'wild' and lower < mean and mean < upper").count() == 2
    assert selection.choose(rows.limit(0), 2, 12).count() == 0


def test_candidates_with_a_member_that_failed_have_no_rows(spark):
    base = spark.createDataFrame([("a", "ets", [1.0], [1.0]), ("a", "theta", [3.0], [1.0])], "series_id string, model string, f array<double>, w array<double>")
    got = selection.candidates(base, ["series_id"], {1: ("ets", "theta"), 2: ("ets", "tbats"), 3: ("tbats",), 4: ("ets", "ets", "theta")})
    assert {r.place: r["mean"] for r in got.collect()} == {1: 2.0, 4: pytest.approx(5 / 3)}


def test_rows_go_to_models_by_their_own_season(spark):
    daily, weekly = [t % 24 for t in range(400)], [t % 168 for t in range(400)]
    noise = np.random.default_rng(3).normal(size=60)
    rows = [("H", "d", 24, 5, daily), ("H", "w", 24, 5, weekly), ("Y", "y", 1, 2, range(1, 12)), ("Q", "q", 4, 3, [5 + t % 4 for t in range(24)]), ("D", "s", 7, 3, range(1, 20)), ("D", "l", 7, 3, 20 + noise)]
    df = spark.createDataFrame([(p, s, m, h, [float(y) for y in ys]) for p, s, m, h, ys in rows], "period string, series_id string, m int, h int, ys array<double>")
    got = routes.predilab(df)
    assert {(r.period, r.series_id): (r.method, r["count"]) for r in got.groupBy("period", "series_id", "method").count().collect()} == {
        ("H", "d"): ("season 24", 5), ("H", "w"): ("season 168", 5), ("Y", "y"): ("theta and arma", 2), ("Q", "q"): ("theta and arma", 3), ("D", "s"): ("four theta", 3), ("D", "l"): ("three of seven", 3),
    }
    assert [r["mean"] for r in got.where("series_id = 'w'").orderBy("step").collect()] == [(400 + k) % 168 for k in range(5)]
    test = one(df.where("series_id = 'q'"), routing.seasonal_by_test(F.col("ys"), F.col("m")))
    assert test is True


@pytest.mark.parametrize("name", ["owa", "owa_m_brand", "agg_grouping_sets"])
def test_reports_read_the_facts_once(spark, name):
    """The sums are written first: the plan of a report reads them, and no table of facts."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sums-" in plan and not any(f"{t}.parquet" in plan for t in ("orders", "lineitem", "customer", "events"))
