"""Theta models with chosen lines and seasons, and the ATA recursion with chosen weights, fitted on the row of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from .models import line_of, seasonal_by_test, seasonal_index, steps_of

#: Parameters that a fit may take.
THETAS = tuple(1 + 0.25 * k for k in range(9))
ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)


def variants(splits: DataFrame, m: int, h: int, critical: float = 1.645) -> DataFrame:
    """Each series once for every season and curve: season N, or M and A where the test finds one, and curve Lrl and Exp.

    Adds des, the values without season, l0, the curve at 1 .. n + h, s, the index at the same places, and plus, whether
    the model can be multiplicative: where values and curve are positive.  Where a value is not, the line is straight.
    """
    rows = splits
    if m > 1:
        rows = rows.withColumn("si", F.when(seasonal_by_test(F.col("train"), m, critical), seasonal_index(F.col("train"), m)))
        rows = rows.withColumn("sa", F.when(F.col("si").isNotNull(), seasonal_index(F.col("train"), m, False)))
    else:
        rows = rows.withColumn("si", F.lit(None).cast("array<double>")).withColumn("sa", F.lit(None).cast("array<double>"))
    option = lambda k, index: F.struct(F.lit(k).alias("season"), index.alias("index"))
    none = option("N", F.lit(None).cast("array<double>"))
    rows = rows.withColumn("o", F.explode(F.when(F.col("si").isNull(), F.array(none)).otherwise(F.array(option("M", F.col("si")), option("A", F.col("sa"))))))
    rows = rows.select("series_id", "n", "train", "o.season", "o.index")
    at = lambda i: F.get("index", (i % m).cast("int"))
    des = F.when(F.col("season") == "M", F.transform("train", lambda y, i: F.try_divide(y, at(i)))).when(F.col("season") == "A", F.transform("train", lambda y, i: y - at(i))).otherwise(F.col("train"))
    places = F.sequence(F.lit(1).cast("long"), F.col("n") + h)
    s = F.when(F.col("season") == "N", F.array_repeat(F.lit(0.0), (F.col("n") + h).cast("int"))).otherwise(F.transform(places, lambda t: at(t - 1)))
    rows = rows.withColumn("des", des).withColumn("s", s).withColumn("positive", F.forall("des", lambda y: y > 0))
    rows = rows.withColumn("curve", F.explode(F.array(F.lit("Lrl"), F.lit("Exp")))).withColumn("bent", (F.col("curve") == "Exp") & F.col("positive"))
    logs = F.transform("des", lambda y: F.when(y > 0, F.ln(F.when(y > 0, y))))
    line = line_of(F.when(F.col("bent"), logs).otherwise(F.col("des")))
    l0 = R.let(line, lambda x: F.transform(places, lambda t: x["intercept"] + x["slope"] * t))
    rows = rows.withColumn("l0", F.when(F.col("bent"), F.transform(l0, F.exp)).otherwise(l0))
    return rows.withColumn("plus", F.col("positive") & F.forall("l0", lambda x: x > 0)).drop("index", "bent", "positive")


def _power(x: Column, w: Column) -> Column:
    return F.exp(w * F.ln(F.when(x > 0, x)))


def joined(product: Column, level: Column, line: Column, theta: Column) -> Column:
    """The theta lines put together again: 1 / theta of the smoothed one, the rest of the curve, as a sum or a product."""
    return F.when(product, _power(level, 1 / theta) * _power(line, 1 - 1 / theta)).otherwise(level / theta + (1 - 1 / theta) * line)


def seasoned(f: Column, s: Column) -> Column:
    return F.when(F.col("season") == "M", f * s).when(F.col("season") == "A", f + s).otherwise(f)


def theta_fit(points: Column, product: Column, theta: Column, alpha: Column) -> Column:
    """struct(sse, mae, level) of smoothing the theta line of a variant: errors on that line, and on the series.

    A point has d, the value without season, y, the value, l, the curve, and s, the seasonal index.
    """

    def step(a: Column, x: Column) -> Column:
        z = F.when(product, _power(x["d"], theta) * _power(x["l"], 1 - theta)).otherwise(theta * x["d"] + (1 - theta) * x["l"])

        def moved(z: Column) -> Column:
            level = F.coalesce(a["level"], z)
            error = x["y"] - seasoned(joined(product, level, x["l"], theta), x["s"])
            return F.struct((alpha * z + (1 - alpha) * level).alias("level"), (a["sse"] + (z - level) * (z - level)).alias("sse"), (a["ae"] + F.abs(error)).alias("ae"))

        return R.let(z, moved)

    start = F.struct(F.lit(None).cast("double").alias("level"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("ae"))
    return R.let(F.aggregate(points, start, step), lambda a: F.struct(F.round(a["sse"], 9).alias("sse"), F.round(a["ae"] / F.col("n"), 9).alias("mae"), a["level"].alias("level")))


def fitted(rows: DataFrame, thetas: tuple[float, ...], alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Variants with, for each model (M, A) and theta, the smoothing that fits its line best: model, theta, alpha, mae, level."""
    first = lambda c: F.slice(c, 1, F.col("n").cast("int"))
    values = F.zip_with("des", "train", lambda d, y: F.struct(d.alias("d"), y.alias("y")))
    curves = F.zip_with(first("l0"), first("s"), lambda a, b: F.struct(a.alias("l"), b.alias("s")))
    points = F.zip_with(values, curves, lambda v, c: F.struct(v["d"].alias("d"), v["y"].alias("y"), c["l"].alias("l"), c["s"].alias("s")))
    menu = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(t).alias("theta")) for k in ("M", "A") for t in thetas])

    def best(points: Column, g: Column) -> Column:
        def one(alpha: Column) -> Column:
            fit = theta_fit(points, (g["model"] == "M") & F.col("plus"), g["theta"], alpha)
            return R.let(fit, lambda f: F.struct(f["sse"].alias("sse"), alpha.alias("alpha"), f["mae"].alias("mae"), f["level"].alias("level")))

        found = F.array_min(F.transform(F.array(*map(F.lit, alphas)), one))
        return R.let(found, lambda x: F.struct(g["model"].alias("model"), g["theta"].alias("theta"), x["alpha"].alias("alpha"), x["mae"].alias("mae"), x["level"].alias("level")))

    made = rows.withColumn("fit", F.explode(R.let(points, lambda x: F.transform(menu, lambda g: best(x, g)))))
    return made.select(*rows.columns, "fit.*")


def ahead_of(h: int) -> Column:
    """The forecasts of a fitted variant, none below zero."""
    product = (F.col("model") == "M") & F.col("plus")

    def at(k: Column) -> Column:
        i = (F.col("n") + k - 1).cast("int")
        return F.greatest(seasoned(joined(product, F.col("level"), F.get("l0", i), F.col("theta")), F.get("s", i)), F.lit(0.0))

    return F.transform(steps_of(h), at)


def four_theta(splits: DataFrame, m: int, h: int, critical: float = 1.645, thetas: tuple[float, ...] = THETAS) -> DataFrame:
    """(series_id, season, curve, model, theta, mae, f): the variant of a series with the least absolute error.

    Two models, two curves, and two seasons where the test finds one; theta is the best of a grid from 1 to 3.  Of
    equals the first counts, in the order season M before A, model M before A, curve Lrl before Exp.  Values may have
    any scale, which no choice depends on.
    """
    return four_theta_fit(splits, m, h, critical, thetas).select("series_id", "season", "curve", "model", "theta", "mae", "f")


def four_theta_fit(splits: DataFrame, m: int, h: int, critical: float = 1.645, thetas: tuple[float, ...] = THETAS) -> DataFrame:
    """`four_theta` with n and e, the one-step errors of the variant on the values."""
    order = F.struct(F.col("mae"), (F.col("season") == "A").alias("s"), (F.col("model") == "A").alias("k"), (F.col("curve") == "Exp").alias("c"), "theta")
    rows = fitted(variants(splits, m, h, critical), thetas).withColumn("order", order)
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy("order"))).where("k = 1")
    return best.withColumn("f", ahead_of(h)).withColumn("e", errors_of()).select("series_id", "n", "season", "curve", "model", "theta", "mae", "f", "e")


def errors_of() -> Column:
    """The one-step errors of a fitted variant, whose level starts at the first value of its theta line."""
    product, theta, alpha = (F.col("model") == "M") & F.col("plus"), F.col("theta"), F.col("alpha")

    def step(a: Column, i: Column) -> Column:
        d, line = F.get("des", i), F.get("l0", i)
        z = F.when(product, _power(d, theta) * _power(line, 1 - theta)).otherwise(theta * d + (1 - theta) * line)

        def moved(z: Column) -> Column:
            level = F.coalesce(a["level"], z)
            error = F.get("train", i) - seasoned(joined(product, level, line, theta), F.get("s", i))
            return F.struct((alpha * z + (1 - alpha) * level).alias("level"), F.concat(a["e"], F.array(error)).alias("e"))

        return R.let(z, moved)

    start = F.struct(F.lit(None).cast("double").alias("level"), F.array().cast("array<double>").alias("e"))
    return F.aggregate(F.sequence(F.lit(0), F.size("train") - 1), start, step)["e"]


def ata_run(ys: Column, p: Column, q: float, phi: Column, product: bool) -> Column:
    """struct(ae, level, trend) of the ATA recursion with weights p / t and q / t: the summed absolute one-step errors.

    The trend is added, or, with `product`, multiplied; it starts at 0 or 1.  With q = 0 there is none.
    """
    move = (lambda level, trend: level * F.pow(trend, phi)) if product else (lambda level, trend: level + phi * trend)

    def step(s: Column, y: Column) -> Column:
        t = s["t"] + 1
        seen = move(s["level"], s["trend"])
        a = F.when(t > p, p / t).otherwise(F.lit(1.0))
        level = a * y + (1 - a) * seen
        b = F.when(t > q, q / t).otherwise(F.lit(1.0))
        change = F.try_divide(level, s["level"]) if product else level - s["level"]
        held = F.pow(s["trend"], phi) if product else phi * s["trend"]
        trend = b * change + (1 - b) * held if q else s["trend"]
        return F.struct(t.alias("t"), level.alias("level"), trend.alias("trend"), (s["ae"] + F.abs(y - seen)).alias("ae"))

    start = F.struct(F.lit(1.0).alias("t"), F.get(ys, F.lit(0)).alias("level"), F.lit(1.0 if product else 0.0).alias("trend"), F.lit(0.0).alias("ae"))
    return F.aggregate(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), start, step)


def ata(ys: Column, phis: tuple[float, ...], product: bool = False, fixed: bool = False) -> Column:
    """struct(ae, p, phi, level, trend) of the ATA model with the least absolute one-step error: p from 1 to n, phi from a grid, q = 1.

    With `fixed` the level weight p is that of the model without a trend.  Null where a product meets a value that
    is not positive.
    """
    ps = F.transform(F.sequence(F.lit(1), F.size(ys)), lambda p: p.cast("double"))
    alone = F.array_min(F.transform(ps, lambda p: F.struct(F.round(ata_run(ys, p, 0, F.lit(1.0), product)["ae"], 9).alias("ae"), p.alias("p"))))["p"]

    def with_phi(p: Column) -> Column:
        def one(phi: float) -> Column:
            return R.let(ata_run(ys, p, 1, F.lit(phi), product), lambda s: F.struct(F.round(s["ae"], 9).alias("ae"), p.alias("p"), F.lit(phi).alias("phi"), s["level"].alias("level"), s["trend"].alias("trend")))

        return F.array_min(F.array(*[one(phi) for phi in phis]))

    found = R.let(alone, with_phi) if fixed else F.array_min(F.transform(ps, with_phi))
    return F.when((F.size(ys) > 1) & (F.forall(ys, lambda y: y > 0) if product else F.lit(True)), found)


def ata_ahead(model: Column, h: int, product: bool = False) -> Column:
    """Forecasts of a fitted ATA model; none is below zero, and there are none where there is no model."""
    def at(x: Column, s: Column) -> Column:
        far = F.aggregate(F.sequence(F.lit(1), s), F.lit(0.0), lambda a, k: a + F.pow(x["phi"], k))
        return F.greatest(x["level"] * F.pow(x["trend"], far) if product else x["level"] + far * x["trend"], F.lit(0.0))

    return R.let(model, lambda x: F.when(x.isNotNull(), F.transform(steps_of(h), lambda s: at(x, s))))


def dynamic_run(ys: Column, h: int, theta: Column, alpha: Column) -> Column:
    """struct(sse, f) of the dynamic theta model (Fiorucci et al. 2016): squared one-step errors from the third value on, and h forecasts.

    The level starts at the first value over theta, which keeps a constant series; beyond the last value each forecast
    stands for the value.
    """
    n = F.size(ys)

    def step(s: Column, t: Column) -> Column:
        mu = s["level"] + (1 - 1 / theta) * (F.pow(1 - alpha, t - 1) * s["a"] + (1 - F.pow(1 - alpha, t)) / alpha * s["b"])
        return R.let(mu, lambda f: R.let(F.coalesce(F.when(t <= n, F.get(ys, t - 1)), f), lambda y: moved(s, t, f, y)))

    def moved(s: Column, t: Column, f: Column, y: Column) -> Column:
        b = F.when(t > 1, ((t - 2) * s["b"] + 6.0 / t * (y - s["mean"])) / (t + 1)).otherwise(F.lit(0.0))
        mean = ((t - 1) * s["mean"] + y) / t
        error = F.when((t >= 3) & (t <= n), (y - f) * (y - f)).otherwise(F.lit(0.0))
        return F.struct(
            (alpha * y + (1 - alpha) * s["level"]).alias("level"), (mean - (t + 1) / 2 * b).alias("a"), b.alias("b"), mean.alias("mean"), (s["sse"] + error).alias("sse"),
            F.when(t > n, F.concat(s["f"], F.array(f))).otherwise(s["f"]).alias("f"),  # as long as the horizon
        )

    zero = F.lit(0.0)
    start = F.struct((F.get(ys, F.lit(0)) / theta).alias("level"), zero.alias("a"), zero.alias("b"), zero.alias("mean"), zero.alias("sse"), F.array().cast("array<double>").alias("f"))
    return F.aggregate(F.sequence(F.lit(1), n + h), start, step)
