"""State space models run as folds over the row of a series: harmonic states, two seasons, a Kalman filter; and seasons found by phase."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..sources.files import written
from . import arma as A

#: Box-Cox powers, dampings of a trend (0 for none), and level and season weights of harmonic models.
TBATS = [(w, phi, k, a, g) for w in (1.0, 0.0) for phi in (0.0, 0.9) for k in (0, 1, 2, 3) for a in (0.1, 0.3) for g in (0.001, 0.05) if k or g == 0.001]
TREND = 0.01
#: Level, first and second season weights, and the share of an error that stays, of models with two seasons.
DSHW = [(a, g, o, f) for a in (0.05, 0.2) for g in (0.1, 0.3) for o in (0.1, 0.3) for f in (0.0, 0.5, 0.9)]
SLOPE = 0.01
#: Variances of level and slope shocks over that of the noise.
STRUCTURAL = [(q, r) for q in (0.0, 0.01, 0.1, 1.0, 10.0) for r in (0.0, 0.001, 0.01, 0.1)]
DIFFUSE = 1e6


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _grid(names: tuple[str, ...], rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])


def _best(rows: DataFrame, by: str, *order: str) -> DataFrame:
    w = W.partitionBy("series_id").orderBy(F.round(by, 6), *order)
    return rows.where(F.col(by).isNotNull() & ~F.isnan(by)).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


# ---- harmonic states ----------------------------------------------------------------------------------------------


def box_cox(y: Column, w: Column) -> Column:
    return F.when(w == 0, F.ln(F.when(y > 0, y))).otherwise(y - 1)


def back_cox(x: Column, w: Column) -> Column:
    return F.when(w == 0, F.exp(x)).otherwise(x + 1)


def _turned(c: Column, m: int) -> tuple[Column, Column]:
    """Cosine and sine states one place on: each pair turns by its frequency."""
    angle = lambda j: F.lit(2 * math.pi / m) * (j + 1)
    s = F.transform(c["s"], lambda v, j: v * F.cos(angle(j)) + F.get(c["z"], j) * F.sin(angle(j)))
    z = F.transform(c["z"], lambda v, j: v * F.cos(angle(j)) - F.get(c["s"], j) * F.sin(angle(j)))
    return s, z


def tbats_start(splits: DataFrame, m: int) -> DataFrame:
    """Each series for each power and number of harmonics: xs, the transformed values, and c, the regression on line and harmonics."""
    pairs = sorted({(w, k) for w, _, k, _, _ in TBATS})
    rows = splits.withColumn("o", F.explode(_grid(("w", "k"), pairs))).select("series_id", "n", "train", "o.w", "o.k")
    rows = rows.withColumn("xs", F.transform("train", lambda y: box_cox(y, F.col("w")))).where(F.forall("xs", lambda x: x.isNotNull()) & (F.col("n") > 2 * F.col("k") + 4))
    line = lambda t: F.array(F.lit(1.0), t.cast("double"))
    design = F.transform("xs", lambda x, i: F.concat(line(i + 1), A.harmonics(i + 1, m, F.col("k")), F.array(x)))
    return written(rows.withColumn("c", A.regress(design)), "tbats-starts").where("c is not null")


def tbats(splits: DataFrame, m: int, h: int) -> DataFrame:
    """(series_id, w, phi, k, a, g, aic, f): level, damped trend and k turning pairs of harmonics, errors added to each state.

    Box-Cox power, trend, pairs and weights are those of least aic, ties by parameters; the states start at a regression.
    """
    menu = _grid(("w", "phi", "k", "a", "g"), TBATS)
    rows = tbats_start(splits, m).withColumn("p", F.explode(F.filter(menu, lambda p: (p["w"] == F.col("w")) & (p["k"] == F.col("k")))))
    a, g, phi, k = (F.col(f"p.{c}") for c in ("a", "g", "phi", "k"))
    beta = F.when(phi > 0, TREND).otherwise(0.0)
    at = lambda i: F.get("c", F.lit(2) + 2 * i)  # noqa: E731  sines, then cosines
    start = F.struct(
        F.get("c", F.lit(0)).alias("l"), F.when(phi > 0, F.get("c", F.lit(1))).otherwise(F.lit(0.0)).alias("b"),
        F.transform(A._upto(0, k - 1), lambda j: F.get("c", 3 + 2 * j)).alias("s"), F.transform(A._upto(0, k - 1), lambda j: at(j)).alias("z"), F.lit(0.0).alias("sse"),
    )

    def step(c: Column, x: Column) -> Column:
        def with_turned(t: Column) -> Column:
            def moved(e: Column) -> Column:
                bump = lambda v: v + g * e
                return F.struct(
                    (c["l"] + phi * c["b"] + a * e).alias("l"), (phi * c["b"] + beta * e).alias("b"), F.transform(t["s"], bump).alias("s"), F.transform(t["z"], bump).alias("z"), (c["sse"] + e * e).alias("sse"),
                )

            return R.let(x - c["l"] - phi * c["b"] - _sum(t["s"]), moved)

        s, z = _turned(c, m)
        return R.let(F.struct(s.alias("s"), z.alias("z")), with_turned)

    runs = written(rows.withColumn("r", F.aggregate("xs", start, step)).select("series_id", "n", "train", "p.*", "r"), "tbats-runs")
    logs = F.when(F.col("w") == 0, _sum(F.transform("train", lambda y: F.ln(F.when(y > 0, y))))).otherwise(F.lit(0.0))
    size = 3 + 2 * F.col("k") + F.when(F.col("phi") > 0, 3).otherwise(0)
    best = _best(runs.withColumn("aic", F.col("n") * F.ln(F.col("r.sse") / F.col("n")) + 2 * logs + 2 * size), "aic", "w", "phi", "k", "a", "g")
    angle = lambda j, s: F.lit(2 * math.pi / m) * (j + 1) * s
    season = lambda s: _sum(F.transform("r.s", lambda v, j: v * F.cos(angle(j, s)) + F.get("r.z", j) * F.sin(angle(j, s))))
    trend = lambda s: F.aggregate(F.sequence(F.lit(1), s), F.lit(0.0), lambda t, i: t + F.pow(F.col("phi"), i)) * F.col("r.b")
    f = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda s: back_cox(F.col("r.l") + trend(s) + season(s), F.col("w")))
    return best.select("series_id", "w", "phi", "k", "a", "g", "aic", f.alias("f"))


# ---- two seasons --------------------------------------------------------------------------------------------------


def dshw(splits: DataFrame, short: int, long: int, h: int) -> DataFrame:
    """(series_id, a, g, o, f1, mse, f): multiplicative smoothing with two seasons, of which the short one divides the long one.

    An error stays with a share in the next forecast (Taylor 2003).  Level and seasons start at the first long season,
    the trend at the difference of the first two.  Values must be positive, and there must be two long seasons.
    """
    rows = splits.where((F.col("n") >= 2 * long) & F.forall("train", lambda y: y > 0))
    first, second = R.mean_of(F.slice("train", 1, long)), R.mean_of(F.slice("train", long + 1, long))
    rows = rows.withColumn("l0", first).withColumn("b0", (second - F.col("l0")) / long)
    own = F.transform(F.sequence(F.lit(0), F.lit(short - 1)), lambda p: R.mean_of(F.transform(F.sequence(p, F.lit(long - 1), F.lit(short)), lambda i: F.get("train", i) / F.col("l0"))))
    rows = written(rows.withColumn("s0", own), "two-seasons")
    rows = rows.withColumn("z0", F.transform(F.slice("train", 1, long), lambda y, i: y / F.col("l0") / F.get("s0", i % short)))
    rows = written(rows.withColumn("p", F.explode(_grid(("a", "g", "o", "f1"), DSHW))).select("series_id", "train", "l0", "b0", "s0", "z0", "p.*"), "two-season-grid")
    a, g, o, stay = (F.col(c) for c in ("a", "g", "o", "f1"))
    start = F.struct(F.col("l0").alias("l"), F.col("b0").alias("b"), F.col("s0").alias("s"), F.col("z0").alias("z"), F.lit(0.0).alias("e"), F.lit(0.0).alias("sse"))
    pushed = lambda ring, v: F.concat(F.slice(ring, 2, F.size(ring) - 1), F.array(v))

    def step(c: Column, y: Column) -> Column:
        s, z = F.get(c["s"], F.lit(0)), F.get(c["z"], F.lit(0))

        def moved(level: Column) -> Column:
            plain = (c["l"] + c["b"]) * s * z
            miss = y - plain - stay * c["e"]
            return F.struct(
                level.alias("l"), (SLOPE * (level - c["l"]) + (1 - SLOPE) * c["b"]).alias("b"), pushed(c["s"], g * y / (level * z) + (1 - g) * s).alias("s"),
                pushed(c["z"], o * y / (level * s) + (1 - o) * z).alias("z"), (y - plain).alias("e"), (c["sse"] + miss * miss).alias("sse"),
            )

        return R.let(a * y / (s * z) + (1 - a) * (c["l"] + c["b"]), moved)

    runs = written(rows.withColumn("r", F.aggregate("train", start, step)).select("series_id", "a", "g", "o", "f1", F.size("train").alias("n"), "r"), "two-season-runs")
    best = _best(runs.withColumn("mse", F.col("r.sse") / F.col("n")), "mse", "a", "g", "o", "f1")
    ring = lambda name, k, size: F.get(name, (k - 1) % size)
    f = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: (F.col("r.l") + k * F.col("r.b")) * ring("r.s", k, short) * ring("r.z", k, long) + F.pow(F.col("f1"), k) * F.col("r.e"))
    return best.select("series_id", "a", "g", "o", "f1", "mse", f.alias("f"))


# ---- a Kalman filter ----------------------------------------------------------------------------------------------


def structural(splits: DataFrame, h: int) -> DataFrame:
    """(series_id, q, r, likelihood, f): a local linear trend by a Kalman filter, with the shock variances of the largest likelihood.

    The state starts at the first value with a large variance; the noise variance is concentrated out, and the first
    two errors, which that start makes, don't count.
    """
    rows = splits.where(F.col("n") > 4).withColumn("p", F.explode(_grid(("q", "r"), STRUCTURAL))).select("series_id", "n", "train", "p.q", "p.r")
    q, r = F.col("q"), F.col("r")
    start = F.struct(F.get("train", F.lit(0)).alias("l"), F.lit(0.0).alias("b"), F.lit(DIFFUSE).alias("p"), F.lit(0.0).alias("c"), F.lit(DIFFUSE).alias("d"), F.lit(0.0).alias("logs"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("t"))

    def step(s: Column, y: Column) -> Column:
        # the state is predicted first, then corrected by the error of its prediction
        seen = F.struct((s["l"] + s["b"]).alias("l"), (s["p"] + 2 * s["c"] + s["d"] + q).alias("p"), (s["c"] + s["d"]).alias("c"), (s["d"] + r).alias("d"))

        def corrected(x: Column) -> Column:
            v, f = y - x["l"], x["p"] + 1
            counts = F.when(s["t"] >= 2, 1.0).otherwise(0.0)
            return F.struct(
                (x["l"] + x["p"] / f * v).alias("l"), (s["b"] + x["c"] / f * v).alias("b"), (x["p"] - x["p"] * x["p"] / f).alias("p"), (x["c"] - x["p"] * x["c"] / f).alias("c"), (x["d"] - x["c"] * x["c"] / f).alias("d"),
                (s["logs"] + counts * F.ln(f)).alias("logs"), (s["ss"] + counts * v * v / f).alias("ss"), (s["t"] + 1).alias("t"),
            )

        return R.let(seen, corrected)

    runs = written(rows.withColumn("s", F.aggregate("train", start, step)).select("series_id", "n", "q", "r", "s"), "filters")
    m = F.col("n") - 2
    runs = runs.withColumn("likelihood", -(m * F.ln(F.col("s.ss") / m) + F.col("s.logs")) / 2).withColumn("cost", -F.col("likelihood"))
    best = _best(runs, "cost", "q", "r")
    return best.select("series_id", "q", "r", "likelihood", F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.col("s.l") + k * F.col("s.b")).alias("f"))


# ---- seasons found by phase ---------------------------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series seven places on, and the product before."""
    z = x + 7
    series = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    product = x
    for k in range(1, 7):
        product = product * (x + k)
    return series - F.ln(product)


def t_tail(t: Column, df: Column, steps: int = 120) -> Column:
    """The chance that Student's t is further from 0 than t: the incomplete beta function by its continued fraction, from the far end.

    The fraction is taken on the side where it converges, in about sqrt(df) steps.
    """
    x = df / (df + t * t)
    a, b = df / 2, F.lit(0.5)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        def term(f: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + even / (1 + odd / f)

        inner = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(steps))), F.lit(1.0), term)
        return 1 / (1 - (a + b) * x / (a + 1) / inner)

    front = lambda x, a, b: F.exp(a * F.ln(x) + b * F.ln(1 - x) + log_gamma(df / 2 + 0.5) - log_gamma(df / 2) - 0.5 * math.log(math.pi)) / a
    near = front(x, a, b) * fraction(x, a, b)
    far = 1 - front(1 - x, b, a) * fraction(1 - x, b, a)
    return F.when(t == 0, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def phase_tests(rows: DataFrame, most: int) -> DataFrame:
    """(series_id, kind, s, p) for rows (series_id, kind, ys): for each season s from 2 to `most` the median p value of Welch's
    test between any two phases.

    A cycle that is not whole is filled with the first values of the series.  Phases of one value, or without any
    variation, have no test.
    """
    n = F.size("ys")
    seasons = rows.where(n >= 4).withColumn("s", F.explode(F.sequence(F.lit(2), F.lit(most))))
    seasons = seasons.withColumn("phase", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    cycles = F.ceil(n / F.col("s")).cast("int")
    values = F.transform(F.sequence(F.lit(0), cycles - 1), lambda j: F.get("ys", (F.col("phase") + j * F.col("s")) % n))
    mean = seasons.select("series_id", "kind", "s", "phase", values.alias("v")).withColumn("mean", R.mean_of(F.col("v")))
    variance = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.size("v") - 1, F.lit(0))
    phases = mean.select("series_id", "kind", "s", "phase", "mean", (variance / F.size("v")).alias("e"), F.size("v").alias("c"))
    # the phases of a season are no more than `most`: their pairs are made on one row
    packed = phases.groupBy("series_id", "kind", "s").agg(F.array_sort(F.collect_list(F.struct("phase", "mean", "e", "c"))).alias("x"))
    left = packed.select("series_id", "kind", "s", "x", F.posexplode("x").alias("i", "a"))
    pairs = left.select("series_id", "kind", "s", "a", F.explode(F.slice("x", F.col("i") + 2, F.greatest(F.size("x") - F.col("i") - 1, F.lit(0)))).alias("b"))
    both = F.col("a.e") + F.col("b.e")
    df = both * both / (F.col("a.e") * F.col("a.e") / (F.col("a.c") - 1) + F.col("b.e") * F.col("b.e") / (F.col("b.c") - 1))
    tested = pairs.where(both > 0).select("series_id", "kind", "s", ((F.col("a.mean") - F.col("b.mean")) / F.sqrt(both)).alias("t"), df.alias("df"))
    return tested.groupBy("series_id", "kind", "s").agg(F.median(t_tail(F.col("t"), F.col("df"))).alias("p"))


def detect_season(packs: DataFrame, most: int = 10, level: float = 0.05, raw: bool = False) -> DataFrame:
    """(series_id, season, kind, p): the season of least p value of the values less their line or, if that is not under `level`,
    of the values over their line; 0 where neither is.  With `raw` the values are taken as they are."""
    from .models import line_of

    at = lambda f: R.let(line_of(F.col("ys")), lambda ab: F.transform("ys", lambda y, i: f(y, ab["intercept"] + ab["slope"] * (i + 1))))
    kinds = {"raw": F.col("ys")} if raw else {"less the line": at(lambda y, x: y - x), "over the line": at(lambda y, x: F.try_divide(y, x))}
    menu = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(k).alias("kind"), v.alias("ys")) for i, (k, v) in enumerate(kinds.items())])
    rows = packs.select("series_id", F.explode(menu).alias("x")).select("series_id", "x.o", "x.kind", "x.ys")
    tests = written(phase_tests(rows.where(F.forall("ys", lambda y: y.isNotNull())), most), "phase-tests").where(F.col("p") < level)
    order = [F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.round("p", 9), F.col("s")]
    best = tests.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy(*order))).where("k = 1").select("series_id", "s", "kind", "p")
    return packs.select("series_id").join(best, "series_id", "left").select("series_id", F.coalesce("s", F.lit(0)).alias("season"), "kind", "p")
