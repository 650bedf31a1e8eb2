"""Nets: derivatives, the closed form of a linear net, repeated seeds, falling losses, unusual tables."""

from __future__ import annotations

import numpy as np
import pytest

from foresail.operators import nets as N


def rows_of(spark, x, y):
    return spark.createDataFrame([(str(i), a.tolist(), b.tolist(), 0.0, 1.0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "series_id string, x array<double>, y array<double>, mean double, sd double")


@pytest.mark.parametrize("shape", [N.Shape(6, 1, 1, (5, 4)), N.Shape(12, 4, 1, (5, 4)), N.Shape(12, 4, 1, ())])
def test_gradients_equal_differences(shape):
    rng = np.random.default_rng(0)
    like, x, y = shape.start(1), rng.normal(size=(7, shape.length)), rng.normal(size=7)
    weights = N._flat(like) + rng.normal(scale=0.1, size=N._flat(like).size)  # a bias of zero could sit on a bend
    nets = N._shaped(weights, like)
    found = N._flat([shape.gradient(nets[0], x, y)[1]])
    for i in range(len(weights)):
        sides = []
        for step in (1e-6, -1e-6):
            moved = weights.copy()
            moved[i] += step
            e = shape.predict(N._shaped(moved, nets)[0], x) - y
            sides.append(e @ e)
        assert found[i] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5)


def test_a_linear_net_tends_to_its_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    y = np.column_stack([x @ [1.0, -0.5, 0.2] + 0.3, x @ [0.1, 0.4, -0.9]])
    shape = N.Shape(3, 1, 2, ())
    nets, losses = N.train(rows_of(spark, x, y), shape, rounds=120, rate=0.1)
    exact = np.linalg.lstsq(np.column_stack([x, np.ones(50)]), y, rcond=None)[0]
    assert losses[-1] < 1e-3 < losses[0]
    for k in range(2):
        assert [*nets[k][0][0][:, 0], nets[k][0][1][0]] == pytest.approx(list(exact[:, k]), abs=0.05)
    got = {r.series_id: r.f for r in N.forecast(rows_of(spark, x, y), nets, shape).collect()}
    assert got["7"] == pytest.approx(list(y[7]), abs=0.1)


def test_losses_fall_and_seeds_repeat(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8))
    y = np.tanh(x[:, :2])
    shape = N.Shape(8, 4, 2, (6,))
    first, losses = N.train(rows_of(spark, x, y), shape, rounds=25, seed=3)
    again, _ = N.train(rows_of(spark, x, y), shape, rounds=25, seed=3)
    other, _ = N.train(rows_of(spark, x, y), shape, rounds=2, seed=4)
    assert losses[-1] < 0.5 * losses[0]
    assert N._flat(first) == pytest.approx(N._flat(again))
    assert not np.allclose(N._flat(first), N._flat(other))


def test_windows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0, 9.0]), ("short", [1.0, 2.0]), ("flat", [3.0] * 9)], "series_id string, ys array<double>")
    row = N.windows(df, 4, 2).collect()
    assert [r.series_id for r in row] == ["a"]
    assert row[0].mean == 2.5 and row[0].y == pytest.approx([(5 - 2.5) / row[0].sd, (9 - 2.5) / row[0].sd])
    assert [round(r.mean, 6) for r in N.windows(df, 4, 2, ahead=True).collect()] == [5.25]
    shape = N.Shape(4, 1, 2, (3,))
    nets, losses = N.train(N.windows(df.limit(0), 4, 2), shape, rounds=3)
    assert losses == [] and N._flat(nets) == pytest.approx(N._flat(shape.start(0)))
    both = N.blended([N.forecast(N.windows(df, n, 2, ahead=True), N.Shape(n, 1, 2, ()).start(0), N.Shape(n, 1, 2, ())) for n in (2, 5)])
    assert {r.series_id: r.lengths for r in both.collect()} == {"a": 2, "short": 1}
