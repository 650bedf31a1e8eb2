"""Copies of a series from blocks of its residuals, their distances and clusters, and the tail of the chi-square distribution."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import recursions as R
from .models import line_of


def lot(copy: Column, draw: Column) -> Column:
    """A whole number below 32768 drawn by a linear congruential step: the same in every engine, on every run."""
    return F.floor((F.lit(1103515245) * (copy.cast("long") * 1000 + draw) + 12345) % 2147483648 / 65536).cast("long")


def lot_sql(copy: str, draw: str) -> str:
    return f"((1103515245::BIGINT * ({copy} * 1000 + {draw}) + 12345) % 2147483648 // 65536)"


def block_copies(ys: Column, m: int, copies: int) -> Column:
    """Copies of a series: its line, and on it residuals in blocks of 2 m values (8 without season) from drawn places.

    A copy begins inside its first block.  The draws depend on the number of the copy alone.
    """
    def made(x: Column) -> Column:
        n = F.size(x["e"])
        width = F.least(n, F.lit(2 * m if m > 1 else 8))

        def one(copy: Column) -> Column:
            def at(i: Column) -> Column:
                j = i + lot(copy, F.lit(99)) % width
                place = lot(copy, F.floor(j / width)) % (n - width + 1) + j % width
                return x["line"]["intercept"] + x["line"]["slope"] * (i + 1) + F.get(x["e"], place.cast("int"))

            return F.transform(F.sequence(F.lit(0), n - 1), at)

        return F.transform(F.sequence(F.lit(1), F.lit(copies)), one)

    def apart(line: Column) -> Column:
        return F.struct(line.alias("line"), F.transform(ys, lambda y, i: y - (line["intercept"] + line["slope"] * (i + 1))).alias("e"))

    return R.let(R.let(line_of(ys), apart), made)


def distances(copies: Column) -> Column:
    """The Euclidean distances between arrays of equal length, as an array of rows."""
    between = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return R.let(copies, lambda all_of: F.transform(all_of, lambda a: F.transform(all_of, lambda b: between(a, b))))


def best_medoids(d: Column, k: int, copies: int) -> Column:
    """struct(cost, set): the k members with the least sum of distances of all to the nearest of them; of equals the first set."""
    sets = F.array(*[F.array(*map(F.lit, own)) for own in combinations(range(copies), k)])
    cost = lambda own: F.aggregate(d, F.lit(0.0), lambda a, row: a + F.array_min(F.transform(own, lambda j: F.get(row, j))))
    return F.array_min(F.transform(sets, lambda own: F.struct(F.round(cost(own), 9).alias("cost"), own.alias("set"))))


def nearest(d: Column, own: Column) -> Column:
    """For each member the nearest of the medoids `own`; of equals the first."""
    return F.transform(d, lambda row: F.array_min(F.transform(own, lambda j: F.struct(F.get(row, j).alias("d"), j.alias("j"))))["j"])


def silhouette(d: Column, own: Column) -> Column:
    """The mean silhouette of a clustering, given the medoid of each member; members alone in their cluster count as 0."""
    def width(row: Column, i: Column) -> Column:
        pairs = F.zip_with(row, own, lambda x, c: F.struct(x.alias("x"), c.alias("c")))
        mine = F.get(own, i)
        total = lambda c: F.aggregate(F.filter(pairs, lambda p: p["c"] == c), F.lit(0.0), lambda a, p: a + p["x"])
        count = lambda c: F.size(F.filter(own, lambda o: o == c))
        a = F.try_divide(total(mine), F.nullif(count(mine) - 1, F.lit(0)))
        b = F.array_min(F.transform(F.filter(F.array_distinct(own), lambda c: c != mine), lambda c: total(c) / count(c)))
        return F.coalesce(F.when(a.isNotNull(), F.try_divide(b - a, F.nullif(F.greatest(a, b), F.lit(0.0)))), F.lit(0.0))

    return R.mean_of(F.transform(d, width))


def chi_square_tail(x: Column, degrees: Column, most: int) -> Column:
    """The chance that a chi-square value with `degrees`, at most `most`, is over x.

    One less the series of the incomplete gamma function where x is small, where all its terms fall; the continued
    fraction of the upper one, from its far end, where x is large.  Both need some sqrt(degrees) steps.
    """
    half, a = x / 2, degrees / 2.0
    log_gammas = F.array(*[F.lit(math.lgamma(k / 2)) for k in range(1, most + 1)])
    steps = F.sequence(F.lit(1), F.lit(60 + 8 * math.isqrt(most)))

    def term(s: Column, k: Column) -> Column:
        return R.let(s["term"] * half / (a + k), lambda v: F.struct(v.alias("term"), (s["sum"] + v).alias("sum")))

    def whole(front: Column) -> Column:
        series = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), term)["sum"]
        last = F.size(steps)
        fraction = F.aggregate(F.reverse(steps), half + 2 * last + 1 - a, lambda f, k: half + 2 * k - 1 - a - k * (k - a) / f)
        return F.when(x <= 0, 1.0).when(half < a + 1, 1 - front * series / a).otherwise(front / fraction)

    return R.let(F.exp(a * F.ln(F.when(x > 0, half)) - half - F.get(log_gammas, degrees - 1)), whole)
