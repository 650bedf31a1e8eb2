"""Models that need optimisation: one series a group, numpy inside, the same forecast schema outside."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FORECAST = "series_id string, model string, step long, mean double, status string"


def golden(f: Callable[[float], float], low: float, high: float, steps: int = 60) -> float:
    """The place of the least value of f between two bounds, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, size: float = 0.2, steps: int = 200) -> np.ndarray:
    """A minimum of f by the simplex method."""
    n = len(start)
    points = [start] + [start + size * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-10:
            break
        center = np.mean(points[:-1], axis=0)
        away = center + (center - points[-1])
        v = f(away)
        if v < values[0]:
            further = center + 2 * (center - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            inner = center + 0.5 * (points[-1] - center)
            w = f(inner)
            if w < values[-1]:
                points[-1], values[-1] = inner, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def _unit(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def smooth(y: np.ndarray, m: int, trend: str, season: str, x: np.ndarray, h: int) -> tuple[float, np.ndarray]:
    """(squared error, forecasts) of exponential smoothing with logistic parameters x: level, trend, season, damping."""
    a, b, g = _unit(x[0]), _unit(x[1]), _unit(x[2])
    phi = 0.8 + 0.18 * _unit(x[3]) if trend == "Ad" else 1.0
    n = len(y)
    if season != "N":
        first = y[: 2 * m].mean()
        s = [float(y[i :: m][:2].mean() / first if season == "M" else y[i :: m][:2].mean() - first) for i in range(m)]
    else:
        s = []
    level = float(y[:m].mean() if s else y[0])
    slope = float((y[m : 2 * m].mean() - y[:m].mean()) / m if s else y[1] - y[0]) if trend != "N" else 0.0
    error = 0.0
    for t in range(n):
        base = level + phi * slope
        si = s[t % m] if s else 0.0
        seen = base * si if season == "M" else base + si
        e = float(y[t]) - seen
        error += e * e
        clear = float(y[t]) / si if season == "M" and abs(si) > 1e-9 else float(y[t]) - (si if season == "A" else 0.0)
        new = a * clear + (1 - a) * base
        slope = b * (new - level) + (1 - b) * phi * slope if trend != "N" else 0.0
        level = new
        if s:
            s[t % m] = g * (float(y[t]) / base if season == "M" and abs(base) > 1e-9 else float(y[t]) - base) + (1 - g) * si
    out, damp, total = [], 1.0, 0.0
    for k in range(h):
        damp *= phi
        total += damp
        base = level + total * slope
        si = s[(n + k) % m] if s else 0.0
        out.append(base * si if season == "M" else base + si)
    return error, np.array(out)


def ets_auto(y: np.ndarray, m: int, h: int) -> np.ndarray:
    """Exponential smoothing with the trend and season of the least corrected information criterion."""
    n = len(y)
    best: tuple[float, np.ndarray] | None = None
    seasons = ["N"] + (["A"] + (["M"] if (y > 0).all() else []) if 1 < m <= 24 and n >= 3 * m else [])
    for trend in ("N", "A", "Ad"):
        for season in seasons:
            k = 2 + 2 * (trend != "N") + (trend == "Ad") + (m if season != "N" else 0)
            if n - k - 1 <= 0:
                continue
            x = nelder_mead(lambda x: smooth(y, m, trend, season, x, 0)[0], np.array([-0.8, -2.2, -2.2, 1.0]), 0.6, 80)  # noqa: B023
            sse, fc = smooth(y, m, trend, season, x, h)
            score = n * math.log(max(sse, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
            if best is None or score < best[0]:
                best = (score, fc)
    return best[1] if best else np.repeat(y[-1], h)


def ar_forecast(y: np.ndarray, h: int, most: int = 6) -> np.ndarray:
    """An autoregression with a constant, its order by the information criterion, fed back step by step."""
    best = None
    for p in range(1, min(most, len(y) // 4) + 1):
        x = np.column_stack([np.ones(len(y) - most), *[y[most - i : len(y) - i] for i in range(1, p + 1)]])
        beta, *_ = np.linalg.lstsq(x, y[most:], rcond=None)
        sse = float(((y[most:] - x @ beta) ** 2).sum())
        score = len(x) * math.log(max(sse, 1e-300) / len(x)) + 2 * (p + 1)
        if best is None or score < best[0]:
            best = (score, beta)
    if best is None:
        return np.repeat(y[-1], h)
    beta, held = best[1], list(y)
    for _ in range(h):
        held.append(float(beta[0] + sum(b * held[-i] for i, b in enumerate(beta[1:], 1))))
    return np.array(held[-h:])


def theta_optimised(y: np.ndarray, h: int) -> np.ndarray:
    """The theta method with the level parameter and theta that fit the past best."""
    n = len(y)
    t = np.arange(1, n + 1)
    b, a = np.polyfit(t, y, 1)

    def run(theta: float, alpha: float) -> tuple[float, float]:
        z = theta * y + (1 - theta) * (a + b * t)
        level, error = z[0], 0.0
        for k in range(1, n):
            e = y[k] - (level / theta + (1 - 1 / theta) * (a + b * t[k]))
            error += e * e
            level = alpha * z[k] + (1 - alpha) * level
        return error, level

    x = nelder_mead(lambda x: run(1 + 2 * _unit(x[0]), 0.01 + 0.98 * _unit(x[1]))[0], np.array([0.0, -1.0]), 0.5, 80)
    theta, alpha = 1 + 2 * _unit(x[0]), 0.01 + 0.98 * _unit(x[1])
    level = run(theta, alpha)[1]
    return level / theta + (1 - 1 / theta) * (a + b * np.arange(n + 1, n + h + 1))


def ses_optimised(y: np.ndarray, h: int) -> np.ndarray:
    def run(alpha: float) -> tuple[float, float]:
        level, error = y[0], 0.0
        for v in y[1:]:
            error += (v - level) ** 2
            level = alpha * v + (1 - alpha) * level
        return error, level

    return np.repeat(run(golden(lambda a: run(a)[0], 0.0, 1.0))[1], h)


def loess(y: np.ndarray, span: float = 0.75) -> np.ndarray:
    """A local linear fit with tricube weights at every point."""
    n = len(y)
    q = max(3, min(n, int(math.ceil(span * n))))
    t = np.arange(n, dtype=float)
    out = np.empty(n)
    for i in range(n):
        d = np.abs(t - i)
        reach = max(np.partition(d, q - 1)[q - 1], 1.0) * (1 + 1e-9)
        w = np.clip(1 - (d / reach) ** 3, 0, None) ** 3
        sw, st, sy = w.sum(), (w * t).sum(), (w * y).sum()
        den = sw * (w * t * t).sum() - st * st
        slope = (sw * (w * t * y).sum() - st * sy) / den if den > 1e-12 else 0.0
        out[i] = (sy - slope * st) / sw + slope * i
    return out


def stl_forecast(y: np.ndarray, m: int, h: int) -> np.ndarray:
    """A periodic season and a local trend are taken out, the rest is smoothed on, and the season put back."""
    season = np.zeros(len(y))
    if m > 1 and len(y) >= 2 * m:
        for _ in range(2):
            rest = y - loess(y - season, max(0.2, 1.5 * m / len(y)))
            phase = np.array([rest[i::m].mean() for i in range(m)])
            phase -= phase.mean()
            season = np.resize(phase, len(y))
    ahead = np.array([season[(len(y) + k) % m] if m > 1 and len(y) >= 2 * m else 0.0 for k in range(h)])
    return ets_auto(y - season, 1, h) + ahead


def moving_block(y: np.ndarray, m: int, random: np.random.Generator) -> np.ndarray:
    """A moving-block bootstrap of a remainder: blocks of 2 m values (8 without season) from random places."""
    n, b = len(y), min(len(y), 2 * m if m > 1 else 8)
    blocks = [y[i : i + b] for i in random.integers(0, n - b + 1, n // b + 2)]
    joined = np.concatenate(blocks)
    first = int(random.integers(0, b))
    return joined[first : first + n]


def bagged(y: np.ndarray, m: int, h: int, seed: int, copies: int = 10) -> np.ndarray:
    """The median of optimised theta forecasts over bootstrapped copies."""
    random = np.random.default_rng(seed)
    trend = loess(y, 0.4)
    return np.median([theta_optimised(trend + moving_block(y - trend, m, random), h) for _ in range(copies)], axis=0)


def temporal_hierarchy(y: np.ndarray, m: int, h: int) -> np.ndarray:
    """Seasonal-naive forecasts of every aggregation level that divides m, reconciled by structural weights."""
    levels = [k for k in range(1, m + 1) if m % k == 0]
    cycles = -(-h // m)
    bottom = np.zeros(cycles * m)
    rows, targets, weights = [], [], []
    for k in levels:
        tail = y[len(y) % k :].reshape(-1, k).sum(1)
        per = m // k
        base = np.resize(tail[-per:], cycles * per)
        for i, v in enumerate(base):
            row = np.zeros(cycles * m)
            row[i * k : (i + 1) * k] = 1
            rows.append(row)
            targets.append(v)
            weights.append(1 / math.sqrt(k))
    s, z, w = np.array(rows), np.array(targets), np.array(weights)
    bottom = np.linalg.lstsq(s * w[:, None], z * w, rcond=None)[0]
    return bottom[:h]


MODELS: dict[str, Callable[[np.ndarray, int, int, int], np.ndarray]] = {
    "ses_optimised": lambda y, m, h, seed: ses_optimised(y, h),
    "theta_optimised": lambda y, m, h, seed: theta_optimised(y, h),
    "ets_auto": lambda y, m, h, seed: ets_auto(y, m, h),
    "ar": lambda y, m, h, seed: ar_forecast(y, h),
    "stl_ets": lambda y, m, h, seed: stl_forecast(y, m, h),
    "bagged_theta": lambda y, m, h, seed: bagged(y, m, h, seed),
    "temporal_hierarchy": lambda y, m, h, seed: temporal_hierarchy(y, m, h),
}


def fit_each(splits: DataFrame, names: list[str], m: int, h: int) -> DataFrame:
    """Forecasts of each named model for each series of (series_id, train).

    A series is one row, so no group is gathered: batches of rows go to numpy where they lie.  A model that fails on
    a series gives seasonal naive forecasts and the error's name as its status.
    """

    def run(batches):
        import zlib

        for pdf in batches:
            out = []
            for sid, train in zip(pdf.series_id, pdf.train, strict=True):
                y = np.asarray(train, float)
                for name in names:
                    status = "ok"
                    try:
                        fc = MODELS[name](y, m, h, zlib.crc32(str(sid).encode()))
                        if not np.isfinite(fc).all():
                            raise ValueError("not finite")
                    except (ValueError, IndexError, ZeroDivisionError, OverflowError, np.linalg.LinAlgError) as e:
                        status = type(e).__name__
                        fc = np.resize(y[-m:], h) if len(y) else np.full(h, np.nan)
                    out += [(sid, name, k + 1, float(v), status) for k, v in enumerate(fc)]
            yield pd.DataFrame(out, columns=["series_id", "model", "step", "mean", "status"])

    return splits.select("series_id", "train").mapInPandas(run, FORECAST)
