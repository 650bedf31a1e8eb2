"""Choice among many candidates: by a holdout, and behind a gate by folds.

A candidate is the mean of one or more base models.  Base models are worked out once for each series or fold and
exploded; candidates, scores and choices are joins and groups over these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..functions.metrics import smape
from ..sources.files import written
from . import arma as A
from .models import line_of, steps_of
from .smoothing import loess

#: Grids of level weight, trend weight and damping, by kind; and the number of parameters that each kind has.
GRIDS = {
    "ses": [(a, 0.0, 1.0) for a in (0.1, 0.3, 0.5, 0.7, 0.9)],
    "holt": [(a, b, 1.0) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.1, 0.3, 0.5)],
    "damped": [(a, b, 0.9) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.1, 0.3, 0.5)],
}
SIZES = {"ses": 2, "holt": 4, "damped": 5}
#: Orders of the differences of an arima model, and terms of its long autoregression.
ORDERS, LONG = [(p, q) for p in range(3) for q in range(2)], 4
SPAN = 0.75
#: 97.5 % normal quantile.
Z = 1.959964
SIMPLE = ("theta", "avg", "naive", "ses.3", "ses.1", "ses", "holt", "damped")
#: The candidates by place, and their members.  A member that no model gives (tbats, loess-arima) is one that failed.
CANDIDATES = (
    ("tbats",), ("arima",), ("ets",), ("ets",), ("tbats", "arima", "ets"), ("theta",), ("avg",), ("naive",), ("ses.3",), ("ses.1",), ("ses",), ("holt",), ("damped",), SIMPLE,
    ("arima", "ets", "ets", "theta"), ("arima", "theta"), ("ets", "theta"), ("theta", "ses.3"), ("ses.3", "ses.1"), ("ses.3", "ses.1", "ses"), ("loess-ets",), ("loess-theta",), ("loess-arima",),
)
#: The same for series with a season, which are adjusted before some models; nnetar failed too.
SEASONAL = (
    ("tbats",), ("arima",), ("ets",), ("tbats", "arima", "ets"), ("stl-theta",), ("stl-ets",), ("nnetar",), ("theta",), ("avg",), ("naive",), ("ses.3",), ("ses.1",), ("ses",), ("holt",), ("damped",), SIMPLE,
    ("arima", "ets", "theta"), ("arima", "theta"), ("ets", "theta"), ("theta", "ses.3"), ("ses.3", "ses.1"), ("arima", "ets"), ("snaive",), ("stl-theta", "stl-ets"), ("arima", "ets", "theta", "stl-theta", "stl-ets"),
)
SEASONAL_FOLDED = (("ets",), ("holt",), ("theta",), ("naive",), ("damped",), ("arima",), ("tbats",), ("snaive",), ("stl-theta",), ("stl-ets",))
#: What is fitted to the whole series for a candidate, where it isn't its own members.
FINAL = {15: ("arima", "ets", "theta"), 18: ("theta", "ses.1")}
#: The models that folds choose among, by place.
FOLDED = (("ets",), ("holt",), ("theta",), ("naive",), ("damped",), ("arima",), ("tbats",))


def trend_run(ys: Column, a: Column, b: Column, phi: Column, trended: Column) -> Column:
    """struct(l, b, sse) of exponential smoothing in its error form, with a trend that starts at y2 - y1, or without."""
    start = F.struct(F.get(ys, F.lit(0)).alias("l"), F.when(trended, F.get(ys, F.lit(1)) - F.get(ys, F.lit(0))).otherwise(F.lit(0.0)).alias("b"), F.lit(0.0).alias("sse"))

    def step(s: Column, y: Column) -> Column:
        moved = lambda e: F.struct((s["l"] + phi * s["b"] + a * e).alias("l"), (phi * s["b"] + a * b * e).alias("b"), (s["sse"] + e * e).alias("sse"))
        return R.let(y - s["l"] - phi * s["b"], moved)

    return F.aggregate(F.slice(ys, 2, F.size(ys) - 1), start, step)


def fit_kind(ys: Column, kind: str) -> Column:
    """struct(key, a, b, phi, l, slope, sse, aicc): the member of a grid with the least squared errors, ties by parameters."""
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("phi")) for a, b, p in GRIDS[kind]])
    n, k = F.size(ys), SIZES[kind]

    def one(c: Column) -> Column:
        run = trend_run(ys, c["a"], c["b"], c["phi"], F.lit(kind != "ses"))
        return R.let(run, lambda s: F.struct(F.round(s["sse"], 9).alias("key"), c["a"].alias("a"), c["b"].alias("b"), c["phi"].alias("phi"), s["l"].alias("l"), s["b"].alias("slope"), s["sse"].alias("sse"),
                                             F.when((n > k + 1) & (s["sse"] > 0), n * F.ln(s["sse"] / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)).alias("aicc")))

    return F.array_min(F.transform(grid, one))


def _of(fit: Column, n: Column, h: Column) -> Column:
    """struct(f, w): forecasts of a fit and the standard deviations of their errors."""
    steps = F.sequence(F.lit(1), h)
    share = lambda j: fit["a"] + fit["a"] * fit["b"] * R.damped_sum(fit["phi"], j)
    spread = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda s, j: s + F.when(j < k, share(j) * share(j)).otherwise(F.lit(0.0)))
    f = F.transform(steps, lambda k: fit["l"] + fit["slope"] * R.damped_sum(fit["phi"], k))
    return F.struct(f.alias("f"), F.transform(steps, lambda k: F.sqrt(fit["sse"] / (n - 1) * spread(k))).alias("w"))


def _theta(ys: Column, fit: Column, h: Column) -> Column:
    """Level smoothing with half the slope of the line as drift (Hyndman and Billah 2003), with the errors of the smoothing."""
    n = F.size(ys)
    drift = lambda line, k: line["slope"] / 2 * (k - 1 + (1 - F.pow(1 - fit["a"], n)) / fit["a"])
    made = R.let(line_of(ys), lambda line: F.transform(F.sequence(F.lit(1), h), lambda k: fit["l"] + drift(line, k)))
    return F.struct(made.alias("f"), _of(fit, n, h)["w"].alias("w"))


def _season(m: int) -> Column:
    """The means by phase of what a local line leaves, less their mean."""
    rest = F.zip_with("ys", "lo", lambda a, b: a - b)
    means = R.let(rest, lambda r: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: R.mean_of(F.filter(r, lambda _, j: j % m == p))))
    return R.let(means, lambda x: R.let(R.mean_of(x), lambda level: F.transform(x, lambda v: v - level)))


def base_models(rows: DataFrame, m: int = 1) -> DataFrame:
    """(keys, h, model, f, w) for rows of (keys, ys, h, window): forecasts of every base model, and standard deviations of their errors.

    With a season m there are seasonal naive forecasts, and models of the values without the season that a local line
    leaves, for series of two seasons or more.  A series of fewer than five values, or a model that can't be fitted,
    has no row or a null.
    """
    keys = [c for c in rows.columns if c not in ("ys", "h", "window")]
    ys, h, n = F.col("ys"), F.col("h").cast("int"), F.size("ys")
    fits = rows.where(n > 4).withColumn("lo", loess(ys, SPAN))
    for kind in GRIDS:
        fits = fits.withColumn(kind, fit_kind(ys, kind)).withColumn(f"lo_{kind}", fit_kind(F.col("lo"), kind))
    fits = written(fits, "smoothings")
    if m > 1:
        fits = fits.withColumn("season", F.when(n >= 2 * m, _season(m)))
        fits = written(fits.withColumn("sa", F.when(F.col("season").isNotNull(), F.transform("ys", lambda y, i: y - F.get("season", i % m)))), "seasons")
        for kind in GRIDS:
            fits = fits.withColumn(f"sa_{kind}", F.when(F.col("sa").isNotNull(), fit_kind(F.col("sa"), kind)))
        fits = written(fits, "adjusted")
    best = lambda at: R.let(F.array_min(F.array(*[F.struct(F.round(F.coalesce(F.col(f"{at}{k}.aicc"), F.lit(float("inf"))), 6).alias("x"), F.lit(i).alias("i"), F.col(f"{at}{k}").alias("fit")) for i, k in enumerate(GRIDS)])), lambda x: x["fit"])
    rms = F.sqrt(R.mean_of(F.zip_with(F.slice("ys", 2, n - 1), F.slice("ys", 1, n - 1), lambda a, b: (a - b) * (a - b))))
    naive = R.let(rms, lambda s: F.struct(F.array_repeat(F.element_at(ys, -1), h).alias("f"), F.transform(F.sequence(F.lit(1), h), lambda k: s * F.sqrt(k)).alias("w")))
    given = lambda a: R.let(trend_run(ys, F.lit(a), F.lit(0.0), F.lit(1.0), F.lit(False)), lambda s: _of(F.struct(F.lit(a).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("phi"), s["l"].alias("l"), F.lit(0.0).alias("slope"), s["sse"].alias("sse")), n, h))
    flat = R.mean_of(F.slice("ys", F.greatest(n - F.col("window") + 1, F.lit(1)).cast("int"), F.col("window").cast("int")))
    models = {
        "ets": R.let(best(""), lambda x: _of(x, n, h)), "theta": _theta(ys, F.col("ses"), h), "naive": naive, "ses.3": given(0.3), "ses.1": given(0.1),
        "avg": R.let(naive, lambda x: F.struct(F.array_repeat(flat, h).alias("f"), x["w"].alias("w"))), "ses": _of(F.col("ses"), n, h), "holt": _of(F.col("holt"), n, h), "damped": _of(F.col("damped"), n, h),
        "loess-ets": R.let(best("lo_"), lambda x: _of(x, n, h)), "loess-theta": _theta(F.col("lo"), F.col("lo_ses"), h),
    }
    if m > 1:
        apart = F.zip_with(F.slice("ys", m + 1, F.greatest(n - m, F.lit(0))), F.slice("ys", 1, F.greatest(n - m, F.lit(0))), lambda a, b: (a - b) * (a - b))
        again = R.let(F.sqrt(R.mean_of(apart)), lambda s: F.struct(F.transform(F.sequence(F.lit(1), h), lambda k: F.get(ys, n - m + (k - 1) % m)).alias("f"), F.transform(F.sequence(F.lit(1), h), lambda k: s * F.sqrt(F.floor((k - 1) / m) + 1)).alias("w")))
        back = lambda x: F.struct(F.transform(x["f"], lambda f, i: f + F.get("season", (n + i) % m)).alias("f"), x["w"].alias("w"))
        seasonal = F.col("season").isNotNull()
        models |= {"snaive": F.when(n > m, again), "stl-ets": F.when(seasonal, R.let(R.let(best("sa_"), lambda x: _of(x, n, h)), back)), "stl-theta": F.when(seasonal, R.let(_theta(F.col("sa"), F.col("sa_ses"), h), back))}
    menu = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("m")) for k, v in models.items()])
    simple = fits.select(*keys, "h", F.explode(menu).alias("x")).select(*keys, "h", "x.model", "x.m.f", "x.m.w")
    return simple.unionByName(_arima(rows, keys))


def _arima(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The arima model of first differences with a drift, of least aicc among those whose values and shocks die away."""
    n = F.size("ys")
    made = rows.where(n > 8).withColumn("ds", F.zip_with(F.slice("ys", 2, n - 1), F.slice("ys", 1, n - 1), lambda a, b: a - b))
    made = made.withColumn("drift", R.mean_of(F.col("ds"))).withColumn("last", F.element_at("ys", -1))
    made = made.select(*keys, "h", "last", "drift", F.transform("ds", lambda v: v - F.col("drift")).alias("xs"))
    fits = A.fit_orders(made, A.menu_of(ORDERS), 2, LONG)
    shocks = F.transform(F.slice("a", F.col("p") + 1, F.col("q")), lambda x: -x)
    fits = fits.where(F.col("aicc").isNotNull() & A.is_stationary(F.slice("a", 1, F.col("p"))) & A.is_stationary(shocks))
    best = fits.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(F.round("aicc", 6), "p", "q"))).where("k = 1")
    best = written(best.select(*keys, "h", "last", "drift", "p", "q", "a", "sse", F.size("xs").alias("n"), A.forecast(F.col("h").cast("int")).alias("g")), "arima")
    f = R.let(F.col("g"), lambda g: F.transform(g, lambda _, i: F.col("last") + (i + 1) * F.col("drift") + F.aggregate(F.slice(g, 1, i + 1), F.lit(0.0), lambda s, x: s + x)))
    # weights of past shocks in the sums of values: the spread grows with their squares
    def weights(s: Column, _: Column) -> Column:
        k = F.size(s)
        lagged = F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.lit(0.0), lambda t, j: t + F.when((j <= k) & (j <= F.col("p")), F.get(F.col("a"), j - 1) * F.get(s, k - j)).otherwise(F.lit(0.0)))
        return F.concat(s, F.array(lagged + F.when((F.col("q") >= k) & (k > 0), F.get(F.col("a"), F.col("p") + k - 1)).otherwise(F.lit(0.0))))

    psi = F.aggregate(F.sequence(F.lit(2), F.greatest(F.col("h").cast("int"), F.lit(2))), F.array(F.lit(1.0)), weights)
    sums = lambda x: F.transform(x, lambda _, i: F.aggregate(F.slice(x, 1, i + 1), F.lit(0.0), lambda s, v: s + v))
    var = F.col("sse") / (F.col("n") - F.least(F.lit(LONG), F.floor(F.col("n") / 4).cast("int")) - 2)
    w = R.let(R.let(psi, sums), lambda c: F.transform(c, lambda _, i: F.sqrt(var * F.aggregate(F.slice(c, 1, i + 1), F.lit(0.0), lambda s, v: s + v * v))))
    return best.select(*keys, "h", F.lit("arima").alias("model"), f.alias("f"), F.slice(w, 1, F.col("h").cast("int")).alias("w"))


def candidates(base: DataFrame, keys: list[str], named: dict[int, tuple[str, ...]]) -> DataFrame:
    """(keys, place, step, mean, wide): the means of the members of each candidate; one with a member that failed has no rows."""
    member = {m: [p for p, ms in named.items() for x in ms if x == m] for m in {x for ms in named.values() for x in ms}}
    places = F.create_map(*[x for m, ps in member.items() for x in (F.lit(m), F.array(*map(F.lit, ps)))])
    rows = base.where(F.col("f").isNotNull()).withColumn("place", F.explode(F.try_element_at(places, F.col("model"))))
    rows = rows.select(*keys, "place", F.posexplode(F.arrays_zip("f", "w")).alias("i", "x"))
    size = F.create_map(*[x for p, ms in named.items() for x in (F.lit(p), F.lit(len(ms)))])
    made = rows.groupBy(*keys, "place", "i").agg(F.avg("x.f").alias("mean"), F.avg("x.w").alias("wide"), F.count("x.f").alias("n"))
    return made.where(F.col("n") == size[F.col("place")]).select(*keys, "place", (F.col("i") + 1).alias("step"), "mean", "wide")


def first_best(scored: DataFrame, by: str) -> DataFrame:
    """(series_id, place, score): the candidate of the least score; of equals the first, a missing or failed one is never the best."""
    w = W.partitionBy("series_id").orderBy(F.round(by, 6).asc_nulls_last(), "place")
    return scored.withColumn("k", F.row_number().over(w)).where((F.col("k") == 1) & F.col(by).isNotNull()).select("series_id", "place", F.col(by).alias("score"))


def _menus(m: int) -> tuple[tuple, tuple, dict]:
    """Candidates of the holdout and of the folds by place, and what is fitted to the whole series in place of some."""
    return (CANDIDATES, FOLDED, FINAL) if m == 1 else (SEASONAL, SEASONAL_FOLDED, {})


def fold_scores(packs: DataFrame, m: int = 1) -> DataFrame:
    """(series_id, place, error): the mean absolute error of the models that folds choose among, for each series.

    Folds are every origin from 12 before the end on (6 in series of up to 24 values) that has a value 4 (3) ahead.
    """
    n, (_, folded_menu, _) = F.size("ys"), _menus(m)
    lead, origins = F.when(n > 24, 4).otherwise(3), F.when(n > 24, 12).otherwise(6)
    rows = packs.withColumn("h", lead).withColumn("start", n - origins).where(F.col("start") > 4)
    folds = rows.select("series_id", "ys", "h", F.explode(F.sequence("start", n - F.col("h"))).alias("origin"))
    parts = folds.select("series_id", "origin", F.slice("ys", 1, F.col("origin")).alias("ys"), "h", (F.col("h") + 1).alias("window"))
    fc = candidates(base_models(parts, m), ["series_id", "origin"], dict(enumerate(folded_menu, 1)))
    actual = folds.select("series_id", "origin", F.col("h").alias("step"), F.get("ys", F.col("origin") + F.col("h") - 1).alias("actual"))
    return fc.join(actual, ["series_id", "origin", "step"]).groupBy("series_id", "place").agg(F.avg(F.abs(F.col("actual") - F.col("mean"))).alias("error"))


def choose(packs: DataFrame, h: int, holdout: int, gate: float = 3.0, m: int = 1) -> DataFrame:
    """(series_id, stage, place, score): the candidate whose holdout error is within the gate, else the model that folds choose.

    Series of over 24 values are held against their last `holdout` values, shorter ones against the last h.  The folds
    of those that fail the gate are every origin from 12 before the end on (6 in short series) that has a value 4 (3)
    ahead; the score is the mean absolute error there.  Only series that fail are copied to folds.  One that is too
    short for folds keeps the best of its holdout.
    """
    n, (menu, _, _) = F.size("ys"), _menus(m)
    held = F.when(n > 24, F.lit(holdout)).otherwise(F.lit(h))
    rows = packs.select("series_id", "ys").withColumn("h", held).where(n > F.col("h") + 4)
    first = rows.select("series_id", F.slice("ys", 1, (n - F.col("h")).cast("int")).alias("ys"), "h", (F.col("h") + 1).alias("window"))
    fc = candidates(base_models(first, m), ["series_id"], dict(enumerate(menu, 1)))
    tests = rows.select("series_id", F.posexplode(F.slice("ys", (n - F.col("h") + 1).cast("int"), F.col("h").cast("int"))).alias("i", "actual")).withColumn("step", F.col("i") + 1)
    errors = fc.join(tests, ["series_id", "step"]).groupBy("series_id", "place").agg(F.avg(F.coalesce(smape(F.col("actual"), F.col("mean")), F.lit(0.0))).alias("smape"))
    best = written(first_best(errors, "smape"), "holdout")
    passed = best.where(F.col("score") <= gate).select("series_id", F.lit("holdout").alias("stage"), "place", "score")
    failing = packs.join(best.where(F.col("score") <= gate).select("series_id"), "series_id", "left_anti")
    scored = fold_scores(failing, m)
    folded = written(first_best(scored, "error").select("series_id", F.lit("folds").alias("stage"), "place", "score"), "folded")
    left = best.where(F.col("score") > gate).join(folded.select("series_id"), "series_id", "left_anti")
    return passed.unionByName(folded).unionByName(left.select("series_id", F.lit("too short").alias("stage"), "place", "score"))


def select_and_forecast(packs: DataFrame, h: int, holdout: int, gate: float = 3.0, m: int = 1) -> DataFrame:
    """(series_id, stage, place, step, mean, lower, upper): the chosen candidate of each series, fitted to all of it."""
    chosen = written(choose(packs, h, holdout, gate, m), "chosen")
    base = base_models(packs.select("series_id", "ys", F.lit(h).alias("h"), F.lit(h + 1).alias("window")), m)
    menu, folded_menu, other = _menus(m)
    final = {p: other.get(p, ms) for p, ms in enumerate(menu, 1)} | {100 + p: ms for p, ms in enumerate(folded_menu, 1)}
    made = candidates(written(base, "finals"), ["series_id"], final)
    code = F.when(F.col("stage") != "folds", F.col("place")).otherwise(F.col("place") + 100)
    rows = made.join(chosen.select("series_id", "stage", "score", code.alias("place")), ["series_id", "place"])
    return rows.select("series_id", "stage", (F.col("place") % 100).alias("place"), "score", "step", "mean", (F.col("mean") - Z * F.col("wide")).alias("lower"), (F.col("mean") + Z * F.col("wide")).alias("upper"))
