"""Nets over all series, one for each step ahead, trained by rounds of gradients that are summed in Spark.

A net adds two towers of dense layers: one over the means of the cycles of a window, one over what they leave, passed
through three filters a cycle wide.  Without a cycle there is one tower over the window.  Weights, a few thousand
numbers a net, go out with each round and come back as one summed gradient; the windows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursions as R
from ..sources.files import written

FILTERS = 3
#: Targets are held within this many standard deviations of all targets of a step.
CLIP = 5.0


@dataclass(frozen=True)
class Shape:
    """Window length, cycle (1 for none), steps ahead and units of the hidden layers."""

    length: int
    cycle: int
    steps: int
    hidden: tuple[int, ...]

    def layers(self) -> list[list[tuple[int, int]]]:
        """The (inputs, outputs) of the layers of each tower; the first layer of a second tower is its filters."""
        sizes = lambda n: list(zip((n, *self.hidden), (*self.hidden, 1), strict=True))
        if self.cycle == 1:
            return [sizes(self.length)]
        cycles = self.length // self.cycle
        return [sizes(cycles), [(self.cycle, FILTERS), *sizes(FILTERS * cycles)]]

    def start(self, seed: int) -> list[list[list[np.ndarray]]]:
        """Weights and biases by step and tower, drawn as Glorot and Bengio (2010) do; the same for the same seed."""
        rng = np.random.default_rng(seed)
        draw = lambda i, o: rng.uniform(-1, 1, (i, o)) * np.sqrt(6 / (i + o))
        return [[[w for i, o in tower for w in (draw(i, o), np.zeros(o))] for tower in self.layers()] for _ in range(self.steps)]

    def inputs(self, x: np.ndarray) -> list[np.ndarray]:
        if self.cycle == 1:
            return [x]
        means = x.reshape(len(x), -1, self.cycle).mean(2)
        return [means, (x.reshape(len(x), -1, self.cycle) - means[:, :, None])]

    def run(self, tower: list[np.ndarray], x: np.ndarray, filtered: bool) -> list[np.ndarray]:
        """The values between the layers of a tower, its inputs first."""
        held, last = [x], len(tower) // 2 - 1
        for k in range(last + 1):
            z = held[-1] @ tower[2 * k] + tower[2 * k + 1]
            if k == 0 and filtered:
                z = z.reshape(len(z), -1)
            elif k < last:
                z = np.maximum(z, 0)
            held.append(z)
        return held

    def predict(self, net: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
        return sum(self.run(tower, part, i == 1)[-1][:, 0] for i, (tower, part) in enumerate(zip(net, self.inputs(x), strict=True)))

    def gradient(self, net: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> tuple[float, list[list[np.ndarray]]]:
        """(loss, gradient), the sum of squared errors over the rows and its derivatives."""
        runs = [self.run(tower, part, i == 1) for i, (tower, part) in enumerate(zip(net, self.inputs(x), strict=True))]
        error = sum(r[-1][:, 0] for r in runs) - y
        out = []
        for i, (tower, held) in enumerate(zip(net, runs, strict=True)):
            back, grads = 2 * error[:, None], [np.empty(0)] * len(tower)
            for k in range(len(tower) // 2 - 1, -1, -1):
                if k == 0 and i == 1:
                    back = back.reshape(len(x), -1, FILTERS)
                    grads[0], grads[1] = np.einsum("ncw,ncf->wf", held[0], back), back.sum((0, 1))
                    continue
                grads[2 * k], grads[2 * k + 1] = held[k].T @ back, back.sum(0)
                if k:
                    back = back @ tower[2 * k].T
                    if not (k == 1 and i == 1):  # the filters have no bend
                        back = back * (held[k] > 0)
            out.append(grads)
        return float(error @ error), out


def _flat(nets: list) -> np.ndarray:
    return np.concatenate([w.ravel() for net in nets for tower in net for w in tower])


def _shaped(flat: np.ndarray, like: list) -> list:
    out, at = [], 0
    for net in like:
        out.append([])
        for tower in net:
            out[-1].append([])
            for w in tower:
                out[-1][-1].append(flat[at : at + w.size].reshape(w.shape))
                at += w.size
    return out


def windows(packs: DataFrame, length: int, steps: int, ahead: bool = False) -> DataFrame:
    """(series_id, x, y, mean, sd): the last window of each series and the values behind it, both less the window's mean over its deviation.

    With `ahead` the window ends with the series, and there is no y.  A series that is too short, or whose window does
    not vary, has no row.
    """
    n, need = F.size("ys"), length + (0 if ahead else steps)
    cut = packs.where(n >= need).select("series_id", F.slice("ys", n - need + 1, length).alias("x"), F.slice("ys", n - steps + 1, steps).alias("y"))
    made = cut.withColumn("mean", R.mean_of(F.col("x")))
    made = made.withColumn("sd", F.sqrt(R.mean_of(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))))).where(F.col("sd") > 1e-12)
    scaled = lambda c: F.transform(c, lambda v: (v - F.col("mean")) / F.col("sd"))
    return made.select("series_id", scaled("x").alias("x"), *([] if ahead else [scaled("y").alias("y")]), "mean", "sd")


def _limits(rows: DataFrame, steps: int) -> list[float]:
    """The largest absolute target of each step."""
    found = rows.select(F.posexplode("y").alias("k", "v")).groupBy("k").agg(F.stddev_pop("v").alias("s")).collect()  # one row a step
    by = {r.k: CLIP * r.s for r in found}
    return [by.get(k, 0.0) for k in range(steps)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def train(rows: DataFrame, shape: Shape, rounds: int = 60, rate: float = 0.02, seed: int = 0) -> tuple[list, list[float]]:
    """(nets, losses): a net for each step, fitted by Adam to the gradients of all rows (x, y), and the mean loss of each round.

    A round is a job: each task sums the gradients of its rows, Spark sums those of the tasks, place by place, and as
    many numbers as there are weights go to the driver.  The same rows and seed give the same nets, but for the order of
    sums.  Without rows the nets are as they were drawn.
    """
    held = written(rows.select("x", "y"), "windows")
    limits, nets = np.array(_limits(held, shape.steps)), shape.start(seed)
    weights = _flat(nets)
    first, second, losses = np.zeros_like(weights), np.zeros_like(weights), []

    def gradients(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss, n = np.zeros_like(now), 0.0, 0
            own = _shaped(now, nets)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = _matrix(batch.column("x"), shape.length), _matrix(batch.column("y"), shape.steps)
                y = np.clip(y, -limits, limits)
                found = [shape.gradient(net, x, y[:, k]) for k, net in enumerate(own)]
                total += _flat([g for _, g in found])
                loss += sum(v for v, _ in found)
                n += len(x)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(-2, len(total))), "v": pa.array(np.r_[n, loss, total])})

        return run

    for t in range(1, rounds + 1):
        summed = held.mapInArrow(gradients(weights), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        values = summed.sort_values("k")["v"].to_numpy()
        if len(values) == 0 or values[0] == 0:
            break
        n, loss, g = values[0], values[1], values[2:] / values[0]
        losses.append(loss / n / shape.steps)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return _shaped(weights, nets), losses


def forecast(rows: DataFrame, nets: list, shape: Shape) -> DataFrame:
    """(series_id, f): the forecasts of rows (series_id, x, mean, sd), scaled back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), shape.length) if batch.num_rows else np.zeros((0, shape.length))
            made = np.column_stack([shape.predict(net, x) for net in nets])
            made = made * batch.column("sd").to_numpy()[:, None] + batch.column("mean").to_numpy()[:, None]
            yield pa.RecordBatch.from_pydict({"series_id": batch.column("series_id"), "f": pa.array(list(made), pa.list_(pa.float64()))})

    return rows.select("series_id", "x", "mean", "sd").mapInArrow(run, "series_id string, f array<double>")


def blended(forecasts: list[DataFrame]) -> DataFrame:
    """(series_id, lengths, f): the mean of the forecasts of all window lengths that a series is long enough for."""
    rows = forecasts[0]
    for more in forecasts[1:]:
        rows = rows.unionByName(more)
    steps = rows.select("series_id", F.posexplode("f").alias("i", "f")).groupBy("series_id", "i").agg(F.avg("f").alias("f"), F.count("f").alias("n"))
    at: Column = F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda v: v["f"])  # as long as the horizon
    return steps.groupBy("series_id").agg(F.max("n").alias("lengths"), at.alias("f"))
