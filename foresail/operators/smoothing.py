"""Loess, local smoothing, complex smoothing and linear recursions on the row of a series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..sources.files import scratch


def loess(ys: Column, span: float) -> Column:
    """A local line with tricube weights at every point, through the ceil(span * n) nearest points, at least three."""
    q = F.least(F.greatest(F.ceil(span * F.size(ys)).cast("int"), F.lit(3)), F.size(ys))

    def at(i: Column, y: Column, reach: Column) -> Column:
        n = F.size(y)
        first, last = F.greatest(i - q, F.lit(0)), F.least(i + q, n - 1)
        near = F.sequence(first, last)
        weight = lambda j: F.pow(F.greatest(1 - F.pow(F.abs(j - i) / reach, F.lit(3.0)), F.lit(0.0)), F.lit(3.0))
        zero = F.lit(0.0)
        start = F.struct(*[zero.alias(k) for k in ("w", "x", "xx", "y", "xy")])

        def add(s: Column, j: Column) -> Column:
            def sums(w: Column) -> Column:
                x, v = (j - i).cast("double"), F.get(y, j)
                return F.struct((s["w"] + w).alias("w"), (s["x"] + w * x).alias("x"), (s["xx"] + w * x * x).alias("xx"), (s["y"] + w * v).alias("y"), (s["xy"] + w * x * v).alias("xy"))

            return R.let(weight(j), sums)

        def fit(s: Column) -> Column:
            # the line's value at the point itself, where x is 0
            spread = s["w"] * s["xx"] - s["x"] * s["x"]
            return F.when(spread > 1e-12, (s["xx"] * s["y"] - s["x"] * s["xy"]) / spread).otherwise(s["y"] / s["w"])

        return R.let(F.aggregate(near, start, add), fit)

    def reach(i: Column, n: Column) -> Column:
        """The distance of the q-th nearest point, a little more so that it counts."""
        side = F.floor((q - 1) / 2)
        short = F.least(i, n - 1 - i)
        far = F.when(short >= side, F.ceil((q - 1) / 2)).otherwise(q - 1 - short)
        return F.greatest(far.cast("double"), F.lit(1.0)) * (1 + 1e-9)

    return R.let(ys, lambda y: F.transform(y, lambda _, i: R.let(reach(i, F.size(y)), lambda r: at(i, y, r))))


def local_variation(x: Column) -> Column:
    """How far each inner value is from its neighbours, as 300 times the second difference over the sum of the three."""
    return F.transform(F.sequence(F.lit(1), F.size(x) - 2), lambda i: R.let(F.get(x, i + 1) + F.get(x, i - 1), lambda around: F.coalesce(F.abs(F.try_divide(300 * (around - 2 * F.get(x, i)), around + F.get(x, i))), F.lit(0.0))))


def settle(rows: DataFrame, ys: Column, back: Column, ahead: Column, name: str, limit: float = 1.0, moves: int = 256, most: int = 400) -> DataFrame:
    """rows with `name`: the series with its roughest point moved half way to the mean of its neighbours, until none varies by `limit`.

    `back` and `ahead` stand before and behind the series.  Of equals the first point moves.  Values that are not
    positive become 1.  Rows are written after each `moves`, and only those with a point over the limit go on; what is
    rough after `most` times as many moves does not settle and is null.
    """
    todo, done = rows.withColumn(name, F.concat(F.array(back), ys, F.array(ahead))), []
    for _ in range(most):
        made, path = todo.withColumn(name, _moved(F.col(name), limit, moves)), scratch(rows.sparkSession, "settling")
        made.withColumn("__rough", F.array_max(_variation(F.col(name))) >= limit).write.parquet(path)
        held = rows.sparkSession.read.parquet(path)
        done.append(held.where("not coalesce(__rough, false)").drop("__rough"))
        todo = held.where("__rough").drop("__rough")
        if todo.isEmpty():
            break
    else:
        done.append(todo.withColumn(name, F.lit(None).cast("array<double>")))
    settled = reduce(DataFrame.unionByName, done)
    positive = R.let(F.col(name), lambda x: F.transform(F.slice(x, 2, F.size(x) - 2), lambda y: F.when(y <= 0, 1.0).otherwise(y)))
    return settled.withColumn(name, F.when(F.col(name).isNotNull(), positive))


def _variation(x: Column) -> Column:
    return F.transform(local_variation(x), lambda v: F.round(v, 9))


def _moved(xs: Column, limit: float, moves: int) -> Column:
    def move(x: Column, _: Column) -> Column:
        def worst(v: Column) -> Column:
            top = F.array_max(v)
            i = F.array_position(v, top).cast("int")  # from 1: the place in x, whose first value is `back`
            half = F.transform(x, lambda y, k: F.when(k == i, (y + (F.get(x, i - 1) + F.get(x, i + 1)) / 2) / 2).otherwise(y))
            return F.when(top >= limit, half).otherwise(x)

        return R.let(_variation(x), worst)

    return F.aggregate(F.sequence(F.lit(1), F.lit(moves)), xs, move)


def complex_run(ys: Column, h: int, a: Column, b: Column) -> Column:
    """struct(sse, f) of complex exponential smoothing without season, with the parameter a + i b; it starts at the first value."""
    n = F.size(ys)

    def step(s: Column, t: Column) -> Column:
        e = F.when(t <= n, F.get(ys, t - 1) - s["level"]).otherwise(F.lit(0.0))

        def moved(e: Column) -> Column:
            return F.struct(
                (s["level"] - (1 - b) * s["potential"] + (a - b) * e).alias("level"), (s["level"] + (1 - a) * s["potential"] + (a + b) * e).alias("potential"),
                (s["sse"] + e * e).alias("sse"), F.when(t > n, F.concat(s["f"], F.array(s["level"]))).otherwise(s["f"]).alias("f"),  # as long as the horizon
            )

        return R.let(e, moved)

    first = F.get(ys, F.lit(0))
    start = F.struct(first.alias("level"), first.alias("potential"), F.lit(0.0).alias("sse"), F.array().cast("array<double>").alias("f"))
    return F.aggregate(F.sequence(F.lit(1), n + h), start, step)


def solve3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """The solution of three linear equations by determinants; null where they have none."""
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    with_column = lambda k: [[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return [F.try_divide(det(with_column(k)), det(m)) for k in range(3)]


def linear_lags(ys: Column) -> Column:
    """struct(c, a1, a2, a3): the least-squares forecast of a value from the three before it."""
    return R.let(ys, _lag_fit)


def _lag_fit(ys: Column) -> Column:
    n = F.size(ys) - 3
    at = lambda k: (lambda i: F.get(ys, i + 3 - k))  # noqa: E731  value k places before
    total = lambda f: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + f(i))
    sums = [total(at(k)).alias(f"m{k}") for k in range(4)] + [total(lambda i, j=j, k=k: at(j)(i) * at(k)(i)).alias(f"m{j}{k}") for j in range(4) for k in range(j, 4)]

    def spread(s: Column) -> Column:
        cov = lambda j, k: (s[f"m{j}{k}"] - s[f"m{j}"] * s[f"m{k}"] / n).alias(f"c{j}{k}")
        return F.struct(*[cov(j, k) for j in range(4) for k in range(max(j, 1), 4)], *[s[f"m{k}"].alias(f"m{k}") for k in range(4)])

    def fit(c: Column) -> Column:
        at = lambda j, k: c[f"c{min(j, k)}{max(j, k)}"]
        found = solve3([[at(j, k) for k in (1, 2, 3)] for j in (1, 2, 3)], [at(0, k) for k in (1, 2, 3)])
        return R.let(F.struct(*[x.alias(f"a{k}") for k, x in enumerate(found, 1)]), lambda a: F.struct(((c["m0"] - a["a1"] * c["m1"] - a["a2"] * c["m2"] - a["a3"] * c["m3"]) / n).alias("c"), a["a1"].alias("a1"), a["a2"].alias("a2"), a["a3"].alias("a3")))

    return F.when(n > 4, R.let(R.let(F.struct(*sums), spread), fit))


def fed_back(ys: Column, lags: Column, h: int) -> Column:
    """Forecasts of `linear_lags` that take their own forecasts as values."""
    def run(a: Column) -> Column:
        step = lambda x, _: F.concat(x, F.array(a["c"] + a["a1"] * F.element_at(x, -1) + a["a2"] * F.element_at(x, -2) + a["a3"] * F.element_at(x, -3)))  # noqa: E731  as long as the horizon
        return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.slice(ys, -3, 3), step), 4, h)

    return R.let(lags, lambda a: F.when(a.isNotNull(), run(a)))
