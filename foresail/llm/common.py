"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a vectorised step holds at once, apart from a single longer text.
CHUNK_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; on a local master without it (tests), a temporary one.

    On a cluster a folder of one machine would lose what the others write: there an unset name is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="foresail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that `materialize` wrote and nothing refers to any more."""
    jvm, paths = df.sparkSession._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about `limit` bytes of text each, at least one row in each."""
    if batch.num_rows == 0:
        return
    lengths = batch_lengths(batch.column(column))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def batch_lengths(column: pa.Array) -> np.ndarray:
    _, offsets = utf8(column)
    return np.diff(offsets)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty.  Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; nulls are empty."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches that are sorted by them; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        for i in range(batch.num_rows):
            if rows[i] != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, at = [], rows[i], i
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept for the next call."""
    held = _powers[base]
    if len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 23:
            _powers[base] = held
    return held[:n]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs data[start:end]; they depend on the bytes alone."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _powers_of(_BASE, n), out=sums[1:])
    back = _powers_of(_INVERSE, n + 1)[starts]
    return mix64((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of words: runs of ASCII letters, digits and underscores and of non-ASCII characters."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = _WORD_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] |= inside[edges]  # a text never runs on into the next
    stops[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text the hashes of its runs of `size` lower-cased words, in order.

    A text with fewer words has one shingle of all of them; a text without words has none.
    """
    lowered = pa.array([x.lower() for x in texts(column)], pa.large_string())
    data, offsets = utf8(lowered)
    starts, ends, row = word_spans(data, offsets)
    words = segment_hashes(data, starts, ends)
    rows = len(lowered)
    counts = np.bincount(row, minlength=rows).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(rows), made)
    begin = first[:-1][owner] + np.arange(out_at[-1]) - out_at[:-1][owner]
    out = np.zeros(len(begin), np.uint64)
    for k in range(size):
        at = begin + k
        has = at < first[1:][owner]
        term = words[np.minimum(at, len(words) - 1)] if len(words) else out
        salt = np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        out = mix64(out * np.uint64(0xFF51AFD7ED558CCD) + np.where(has, term, np.uint64(0)) + salt)
    return out, out_at
