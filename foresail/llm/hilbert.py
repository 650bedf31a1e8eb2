"""Sharding by Hilbert-curve order: quantise metadata, sort by curve index, cut runs of rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Bits of each dimension: 2**BITS cells along every axis of the curve.
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve positions of points (rows of cells, each coordinate below 2**bits).

    The inverse of the transposed-index construction of Skilling (2004), on whole columns at once.
    """
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the curve's rotations, from the highest bit down
        p = q - 1
        for k in range(n):
            on = (x[k] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[k] ^= t
        q >>= 1
    for k in range(1, n):  # Gray code
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    for k in range(n):
        x[k] ^= t
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            index = (index << 1) | ((x[k] >> bit) & 1)
    return index


#: Types whose values order as doubles; other columns order as their strings.
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def value_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """The values of a string column at which its rows are cut into `cells` runs of nearly equal counts.

    Whole values are compared.  A value stands as often as there are cuts among its rows, so that few values still
    span all cells.  Each distinct value is sorted once, with its count; what the driver gets is a count for each
    range of values, and at most `cells` - 1 values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, "value").sortWithinPartitions("value")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ends = before + np.cumsum(batch.column("n").to_numpy())
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends)], [*batch.schema.names, "ends"])

    ranged = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(running, "value string, n long, part int, ends long")
    held = materialize(ranged, "values")
    sums = {r.part: r.n for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    seen = np.array(sorted(sums), np.int64)
    before = np.concatenate([[0], np.cumsum([sums[k] for k in seen.tolist()])])
    total = int(before[-1])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = batch.column("ends").to_numpy() + before[np.searchsorted(seen, batch.column("part").to_numpy())]
            start = end - batch.column("n").to_numpy()
            times = np.minimum(end * cells // total, cells - 1) - start * cells // total
            kept = np.flatnonzero(times > 0)
            yield pa.RecordBatch.from_pydict({"value": batch.column("value").take(pa.array(kept)), "times": pa.array(times[kept])})

    found = held.select("value", "n", "ends", "part").mapInArrow(crossed, "value string, times long").collect() if total else []
    return sorted((r.value for r in found for _ in range(r.times)), key=str.encode)


def hilbert_keys(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df with the column `hilbert`.  Each dimension is cut at quantiles over all rows; nulls go to cell 0.

    Numbers, dates and times are cut by their approximate quantiles, other values by `value_cuts` of their strings.
    """
    kinds, columns, exact = dict(df.dtypes), [], []
    for d in dims:
        c, kind = F.col(f"`{d}`"), kinds[d]
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        exact.append(kind not in NUMERIC and not kind.startswith("decimal") and kind not in ("date", "timestamp", "timestamp_ntz"))
        columns.append(c.cast("string" if exact[-1] else "double"))
    cells = 1 << bits
    held = df.withColumns({f"__d{i}": c for i, c in enumerate(columns)})
    numbers = [f"__d{i}" for i in range(len(dims)) if not exact[i]]
    cuts_at = [i / cells for i in range(1, cells)]
    found = held.agg(F.lit(0).alias("none"), *[F.percentile_approx(c, cuts_at, 1000).alias(c) for c in numbers]).head()
    cuts = [value_cuts(held, f"__d{i}", cells) if exact[i] else sorted(found[f"__d{i}"] or ()) for i in range(len(dims))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(cuts)), np.int64)
            for i, at in enumerate(cuts):
                column = batch.column(f"__d{i}")
                if exact[i]:
                    keys = [v.encode() for v in at]
                    out[:, i] = [0 if v is None else bisect_left(keys, v.encode()) for v in column.to_pylist()]
                else:
                    v = column.to_numpy(zero_copy_only=False).astype(float)
                    out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(np.array(at, float), v, side="left"))
            kept = batch.schema.names[: batch.num_columns - len(cuts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hilbert_index(out, bits))], [*kept, "hilbert"])

    return held.mapInArrow(index, T.StructType([*df.schema.fields, T.StructField("hilbert", T.LongType())]))


def shard_hilbert(
    df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = BITS
) -> DataFrame:
    """One row for each row of df with its shard and its slot there.

    Law `rows`: rows in the order of (curve index, doc_id, digest of the text) are cut into `shards` runs whose
    lengths differ by one at most; run s holds the ranks r with floor(r * shards / n) = s.  Each shard so covers
    a small box of every dimension, and readers can skip files by their column statistics.

    Texts stay where they are: only (doc_id, size, digest, curve index) is sorted, by range partitions, so that
    neither a hot source nor a group of equal texts meets in one task.  Null dimensions go to the first cell,
    null ids come first, null texts have size 1; repeated rows have a slot each; an empty table gives no rows.
    """
    own = df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(f"`{d}`").alias(f"dim_{i}") for i, d in enumerate(dims)],
    )
    keyed = hilbert_keys(own, [f"dim_{i}" for i in range(len(dims))], bits).select("doc_id", "size", "text_crc32", "hilbert")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["hilbert", "doc_id", "text_crc32", "size", "tie"]
    ranged = keyed.withColumn("tie", F.monotonically_increasing_id())  # rows that are equal can lie in several ranges
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = materialize(ranged.drop("tie").withColumn("place", F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright("place", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    at, before = 0, {}
    for r in sorted(counts, key=lambda r: r.part):
        before[r.part] = at
        at += r.n
    total, parts_seen = at, np.array(sorted(before), np.int64)
    offsets = np.array([before[p] for p in parts_seen.tolist()], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("place").to_numpy()
            rank = offsets[np.searchsorted(parts_seen, p >> 33)] + (p & ((1 << 33) - 1)) if total else p
            shard = rank * shards // max(total, 1)
            first = -(-shard * total // shards)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "size": batch.column("size"),
                    "text_crc32": batch.column("text_crc32"),
                    "law": pa.array(["rows"] * len(p), pa.string()),
                    "shard": pa.array(shard, pa.int32()),
                    "slot": pa.array(rank - first, pa.int64()),
                    "grown_shard": pa.nulls(len(p), pa.int32()),
                    "hilbert": batch.column("hilbert"),
                }
            )

    return ordered.mapInArrow(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, hilbert long")
