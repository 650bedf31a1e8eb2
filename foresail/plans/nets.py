"""Queries on nets over all series of a collection; training is iterative, so they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import r6
from ..operators import nets as N
from ..registry import query
from ..sources.files import written
from ..sources.series import SPECS, packed, series, split

#: Collection, cycle, window lengths and units by query; lengths that no series here has give no nets.
NETS = {
    "nn_yearly": ("Y_nation", 1, (4, 10), (50, 50)),
    "nn_quarterly": ("Q_nation", 4, (8, 20), (50, 50)),
    "nn_monthly": ("M_brand", 12, (24, 48), (20, 20)),
    "nn_weekly": ("W_plain", 1, (52, 104), (20, 20)),
    "nn_daily": ("D_event", 7, (14,), (20, 20)),
    "nn_hourly": ("H_event", 24, (168,), (20, 20)),
}
ROUNDS = 12


def trained_forecasts(spark, d, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(series_id, lengths, f): nets for each window length, trained on the values before the holdout, over their means."""
    name, cycle, lengths, hidden = NETS[key]
    h = SPECS[name].h
    past = written(split(packed(series(spark, d, name)), h).select("series_id", F.col("train").alias("ys")), "nets")
    made = []
    for length in lengths:
        shape = N.Shape(length, cycle, h, hidden)
        rows = N.windows(past, length, h)
        nets, _ = N.train(rows, shape, rounds)
        made.append(N.forecast(N.windows(past, length, h, ahead=True), nets, shape))
    return N.blended(made)


def _named(key: str) -> None:
    @query(key)
    def _(spark, d):
        rows = trained_forecasts(spark, d, key).select("series_id", F.col("lengths").cast("long").alias("lengths"), F.posexplode("f").alias("i", "f"))
        return rows.select("series_id", "lengths", (F.col("i") + 1).cast("long").alias("step"), r6("f").alias("mean"))


for _key in NETS:
    _named(_key)
