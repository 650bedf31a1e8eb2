"""Linear regressions of any width and ARMA models on the row of a series.

An ARMA model is fitted by two regressions (Hannan and Rissanen 1982): a long autoregression, whose errors stand for the
shocks, and one of the values on their lags and on those of the shocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..sources.files import written


def _none() -> Column:
    return F.array().cast("array<double>")


def _upto(first: Column | int, last: Column) -> Column:
    """first .. last, empty if last is before first."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= start, F.sequence(start.cast("int"), F.greatest(last, start).cast("int"))).otherwise(F.array().cast("array<int>"))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def solve(m: Column) -> Column:
    """The solution of k linear equations, given as k rows of k + 1 values; of singular ones it is null."""

    def eliminate(m: Column, p: Column) -> Column:
        def with_top(top: Column) -> Column:
            less = lambda r: R.let(F.get(r, p), lambda c: F.zip_with(r, top, lambda a, b: a - c * b))
            return F.transform(m, lambda r, i: F.when(i == p, top).otherwise(less(r)))

        pivot = lambda d: F.transform(F.get(m, p), lambda v: v / F.when(F.abs(d) > 1e-12, d))
        return R.let(R.let(F.get(F.get(m, p), p), pivot), with_top)

    done = F.aggregate(_upto(0, F.size(m) - 1), m, eliminate)
    found = F.transform(done, lambda r: F.element_at(r, -1))
    return R.let(found, lambda x: F.when(F.forall(x, lambda v: v.isNotNull()), x))


def normal_equations(rows: Column) -> Column:
    """Of rows of k regressors and a target: the k equations of the least squares."""
    width = F.size(F.get(rows, F.lit(0)))
    entry = lambda i, j: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(r, i) * F.get(r, j))
    return F.transform(_upto(0, width - 2), lambda i: F.transform(_upto(0, width - 1), lambda j: entry(i, j)))


def regress(rows: Column) -> Column:
    """The coefficients of the least-squares fit of the last value of each row by the others; null if there is none."""
    return R.let(rows, lambda x: F.when(F.size(x) >= F.size(F.get(x, F.lit(0))), R.let(normal_equations(x), solve)))


def lags(xs: Column, t: Column, k: Column) -> Column:
    """The k values before place t, from 0, the last first."""
    return F.transform(_upto(1, k), lambda j: F.get(xs, t - j))


def long_errors(xs: Column, order: Column) -> Column:
    """The errors of an autoregression of `order` on centred values; zeros for the first `order` places."""
    rows = F.transform(_upto(order, F.size(xs) - 1), lambda t: F.concat(lags(xs, t, order), F.array(F.get(xs, t))))
    error = lambda a: F.transform(xs, lambda x, t: F.when(t >= order, x - _dot(a, lags(xs, t, order))).otherwise(F.lit(0.0)))
    return R.let(regress(rows), lambda a: F.when(a.isNotNull(), error(a)))


def arma_coefficients(xs: Column, shocks: Column, p: Column, q: Column, first: Column) -> Column:
    """p weights of values and q weights of shocks, from the places from `first` on."""
    row = lambda t: F.concat(lags(xs, t, p), lags(shocks, t, q), F.array(F.get(xs, t)))
    return F.when(p + q > 0, regress(F.transform(_upto(first, F.size(xs) - 1), row))).otherwise(_none())


def arma_errors(xs: Column, a: Column, p: Column, q: Column) -> Column:
    """One-step errors, with values and errors before the first taken as zero."""
    ar, ma = F.slice(a, 1, p), F.slice(a, p + 1, q)
    known = lambda ys, t, k: F.transform(_upto(1, k), lambda j: F.when(t >= j, F.get(ys, t - j)).otherwise(F.lit(0.0)))
    step = lambda e, t: F.concat(e, F.array(F.get(xs, t) - _dot(ar, known(xs, t, p)) - _dot(ma, known(e, t, q))))
    return F.when(a.isNotNull(), F.aggregate(_upto(0, F.size(xs) - 1), _none(), step))


def arma_ahead(xs: Column, e: Column, a: Column, p: Column, q: Column, h: Column | int) -> Column:
    """h forecasts of centred values; shocks to come are zero."""
    ar, ma = F.slice(a, 1, p), F.slice(a, p + 1, q)
    steps = F.lit(h) if isinstance(h, int) else h

    def step(s: Column, _: Column) -> Column:
        n = F.size(s["x"])
        known = lambda ys, k: F.transform(_upto(1, k), lambda j: F.when(n >= j, F.get(ys, n - j)).otherwise(F.lit(0.0)))
        seen = _dot(ar, known(s["x"], p)) + _dot(ma, known(s["e"], q))
        return F.struct(F.concat(s["x"], F.array(seen)).alias("x"), F.concat(s["e"], F.array(F.lit(0.0))).alias("e"))

    done = F.aggregate(_upto(1, steps), F.struct(xs.alias("x"), e.alias("e")), step)
    return F.when(a.isNotNull(), F.slice(done["x"], F.size(xs) + 1, steps))


def is_stationary(ar: Column) -> Column:
    """Whether an autoregression dies away: all its partial autocorrelations, found by stepping down, are within one."""

    def down(s: Column, _: Column) -> Column:
        r = F.element_at(s["a"], -1)
        rest = F.slice(s["a"], 1, F.size(s["a"]) - 1)
        shorter = F.transform(rest, lambda x, i: (x + r * F.get(rest, F.size(rest) - 1 - i)) / F.when(F.abs(r) < 1, 1 - r * r))
        return F.struct(shorter.alias("a"), (s["ok"] & (F.abs(r) < 1)).alias("ok"))

    return F.coalesce(F.aggregate(ar, F.struct(ar.alias("a"), F.lit(True).alias("ok")), down)["ok"], F.lit(False))


def menu_of(orders: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in orders])


def fit_orders(rows: DataFrame, menu: Column, lead: int, most: int) -> DataFrame:
    """Each row with its centred values xs once for each order of its menu: p, q, a, the weights, sse and aicc.

    All orders are measured on the same places, those behind the long autoregression (of `most` terms, or a quarter of
    the values) and `lead`, the largest lag.  A row's fits are one array, which is written before it is filtered or exploded: an expression of this size is not to be worked out
    for every use of a part of it.
    """
    xs = F.col("xs")
    long = F.least(F.lit(most), F.floor(F.size(xs) / 4).cast("int"))

    def one(o: Column, shocks: Column, first: Column) -> Column:
        def measured(a: Column, e: Column) -> Column:
            late = F.slice(e, first + 1, F.greatest(F.size(e) - first, F.lit(0)))
            n, k = F.size(xs) - first, o["p"] + o["q"] + 1

            def row(sse: Column) -> Column:
                aicc = F.when(n > k + 1, n * F.ln(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1))
                parts = [o["p"].alias("p"), o["q"].alias("q"), a.alias("a"), sse.alias("sse"), aicc.alias("aicc")]
                return F.struct(*parts)

            return R.let(_dot(late, late), row)

        return R.let(arma_coefficients(xs, shocks, o["p"], o["q"], first), lambda a: R.let(arma_errors(xs, a, o["p"], o["q"]), lambda e: measured(a, e)))

    fits = R.let(long, lambda k: R.let(long_errors(xs, k), lambda s: F.transform(menu, lambda o: one(o, s, k + lead))))
    made = written(rows.withColumn("__fits", fits), "fits")
    return made.select(*rows.columns, F.explode("__fits").alias("__f")).select(*rows.columns, "__f.*")


def forecast(h: Column | int) -> Column:
    """h forecasts of the fit in a row of `fit_orders`, of the centred values."""
    xs, a, p, q = map(F.col, ("xs", "a", "p", "q"))
    return R.let(arma_errors(xs, a, p, q), lambda e: arma_ahead(xs, e, a, p, q, h))


def harmonics(t: Column, m: float, k: Column) -> Column:
    """Sines and cosines of the first k harmonics of the period m at place t."""
    angle = lambda j: F.lit(2 * math.pi / m) * j * t
    return F.flatten(F.transform(_upto(1, k), lambda j: F.array(F.sin(angle(j)), F.cos(angle(j)))))
