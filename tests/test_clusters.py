"""Medoids against exhaustive search, and draws from clusters."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail.operators import clusters as C


@pytest.mark.parametrize("k", [1, 2, 3])
def test_medoids_equal_exhaustive_search(spark, k):
    rows = []
    for seed in range(6):
        centres = np.random.default_rng(seed).normal(scale=20, size=(3, 2))
        points = np.concatenate([c + np.random.default_rng(seed + 10).normal(size=(4, 2)) for c in centres])
        rows.append((seed, np.linalg.norm(points[:, None] - points[None], axis=2).tolist()))
    df = spark.createDataFrame(rows, "seed int, d array<array<double>>")
    for r in df.select("seed", "d", C.pam(F.col("d"), F.lit(k)).alias("p")).collect():
        d = np.array(r.d)
        best = min(round(float(d[:, list(own)].min(1).sum()), 9) for own in combinations(range(12), k))
        assert r.p.cost == pytest.approx(best) and r.p.cost == pytest.approx(d[:, r.p.set].min(1).sum())


def test_clusters_and_their_members(spark):
    rng = np.random.default_rng(3)
    copies = [(base + rng.normal(scale=0.1, size=5)).tolist() for base in (0, 0, 0, 0, 50, 50, 50, 90, 90)]
    got = C.clustered(spark.createDataFrame([("a", copies)], "series_id string, copies array<array<double>>"), 5).head()
    assert got.k == 3 and got.width > 0.9
    assert [len({*got.own[a:b]}) for a, b in ((0, 4), (4, 7), (7, 9))] == [1, 1, 1] and len({*got.own}) == 3


def test_bags_of_copies(spark):
    ys = [10 + 0.5 * t + (t * 7919 % 13) / 13 for t in range(40)]
    df = spark.createDataFrame([("a", 40, ys, [1.0, 1.0, 2.0])], "series_id string, n long, des array<double>, out array<double>")
    got = C.bagged_clusters(df, 4, 3, copies=20, kept=9, most=3, members=4).orderBy("step").collect()
    assert [r.step for r in got] == [1, 2, 3]
    assert all(r.lower <= r["mean"] <= r.upper for r in got) and 25 < got[0]["mean"] < 36 and 55 < got[2]["mean"] < 72
