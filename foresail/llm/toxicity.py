"""Toxicity by compression distance: windows are compressed with a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, segment_hashes, shingle_hashes, text_chunks, texts, utf8, word_spans

#: Bytes of a word that is one window at most.
WINDOW = 48
#: Bytes of the pieces that a longer word is cut into, and from one to the next: short, as what is ordinary in a piece
#: offsets an insult beside it.
PIECE, STEP = 24, 12
#: Bounds of what is learned from: labelled texts of each class, and bytes of such a text.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 16
DICTIONARY_BYTES = 1 << 15
#: Windows whose gain a worker remembers; all are forgotten when there are more.
MEMO = 500_000
#: How matches are searched for: short ones count, as insults are short.
SEARCH = {"strategy": zstandard.STRATEGY_BTLAZY2, "min_match": 4, "window_log": 16, "hash_log": 14, "chain_log": 14, "search_log": 4, "target_length": 16}


def window_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of windows: words, and of a word over WINDOW bytes pieces that overlap and reach its end.

    Scripts without spaces have whole sentences as words.  Pieces begin and end between code points.
    """
    start, end, row = word_spans(data, offsets)
    long = end - start > WINDOW
    if not long.any():
        return start, end, row
    made = np.where(long, 1 - (PIECE - (end - start)) // STEP, 1)
    word = np.repeat(np.arange(len(start)), made)
    piece = np.arange(len(word)) - np.repeat(np.cumsum(made) - made, made)
    begin = start[word] + STEP * piece
    stop = np.where(long[word], np.minimum(begin + PIECE, end[word]), end[word])
    for places, edge in ((begin, start[word]), (stop, end[word])):
        for _ in range(3):  # back to the first byte of a code point
            places -= (places != edge) & ((data[np.minimum(places, len(data) - 1)] & 0xC0) == 0x80)
    return begin, stop, row[word]


def windows(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(pieces, number of the piece, row) of the windows of lower-cased texts.

    A window is a word, or a piece of a long one, between two spaces; equal windows are one piece.
    """
    data, offsets = utf8(pa.array([x.lower() for x in texts(column)], pa.large_string()))
    start, end, row = window_spans(data, offsets)
    _, first, number = np.unique(segment_hashes(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [b" " + raw[a:b] + b" " for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], number, row


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; what was sampled itself if there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Distance:
    """Compressed lengths of windows under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.tools = []
        for raw in (toxic, ordinary):
            params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=0, write_dict_id=0, write_checksum=0)
            held = zstandard.ZstdCompressionDict(raw + PRIMER)
            held.precompute_compress(compression_params=params)
            self.tools.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))

        self.memo: dict[bytes, int] = {}

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each piece."""
        toxic, ordinary = (t.compress for t in self.tools)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for p in pieces:
            if p not in memo:
                memo[p] = len(ordinary(PRIMER + p)) - len(toxic(PRIMER + p))
        return np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))


def features(gain: np.ndarray, row: np.ndarray, rows: int, cuts: tuple[int, ...]) -> np.ndarray:
    """For each text: the largest gain, how many windows gain at least each cut (logarithms), and their share."""
    top = np.zeros(rows)
    np.maximum.at(top, row, gain)
    total = np.bincount(row, minlength=rows).astype(float)
    columns = [top]
    for c in cuts:
        n = np.bincount(row, gain >= c, rows)
        columns += [np.log1p(n), n / np.maximum(total, 1)]
    return np.column_stack(columns)


#: Stands before every window and ends every dictionary: zstandard stores a piece raw unless it saves some bytes,
#: and behind this, which is always matched, each further byte that a dictionary saves shows in the length.
PRIMER = bytes(range(128, 224))


@dataclass(frozen=True)
class Model:
    """What scoring needs: two dictionaries, the gain cuts, and the calibration."""

    toxic: bytes
    ordinary: bytes
    cuts: tuple[int, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, distance: Distance, column: pa.Array) -> np.ndarray:
        x = text_features(distance, column, self.cuts)
        z = ((x - self.mean) / self.scale) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_features(distance: Distance, column: pa.Array, cuts: tuple[int, ...]) -> np.ndarray:
    pieces, number, row = windows(column)
    return features(distance.gains(pieces)[number] if len(number) else np.zeros(0), row, len(column), cuts)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton's method; both classes weigh the same."""
    a = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _telling(held: list[bytes], labels: np.ndarray, least: float = 3.0, times: float = 8.0) -> set[int]:
    """Hashes of windows whose odds are `times` higher in toxic texts, by `least` standard errors from even odds."""
    data, offsets = utf8(pa.array([t.decode().lower() for t in held], pa.large_string()))
    start, end, row = window_spans(data, offsets)
    hashes = segment_hashes(data, start, end)
    seen = np.unique(np.column_stack([row.astype(np.uint64), hashes]), axis=0)
    words, at = np.unique(seen[:, 1], return_inverse=True)
    toxic = np.bincount(at, labels[seen[:, 0].astype(np.int64)] == 1, len(words))
    total = np.bincount(at, minlength=len(words))
    n1, n0 = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    odds = np.log((toxic + 0.5) / (n1 - toxic + 0.5)) - np.log((total - toxic + 0.5) / (n0 - (total - toxic) + 0.5))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (total - toxic + 0.5))
    return set(words[(odds / error > least) & (odds > np.log(times)) & (toxic >= 3)].tolist())


def _samples(texts: list[bytes], telling: set[int] | None) -> list[bytes]:
    """What dictionaries are trained on: runs of eight windows, of all words or of the telling ones."""
    data, offsets = utf8(pa.array([t.decode().lower() for t in texts], pa.large_string()))
    start, end, _ = window_spans(data, offsets)
    if telling is not None:
        hit = np.isin(segment_hashes(data, start, end), np.fromiter(telling, np.uint64, len(telling)))
        start, end = start[hit], end[hit]
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]


def _distinct(texts: list[bytes], labels: np.ndarray, most: float = 0.2) -> tuple[list[bytes], np.ndarray]:
    """The texts of which at most a share `most` of the word runs is in texts before them: copies would tell nothing."""
    hashes, at = shingle_hashes(pa.array([t.decode() for t in texts], pa.large_string()))
    seen: set[int] = set()
    kept = []
    for i in range(len(texts)):
        own = hashes[at[i] : at[i + 1]].tolist()
        if own and sum(h in seen for h in own) <= most * len(own):
            kept.append(i)
        seen.update(own)
    return [texts[i] for i in kept], labels[kept]


def _dictionaries(texts: list[bytes], labels: np.ndarray) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries.

    Words that tell toxic from ordinary texts choose the toxic windows, so that its dictionary is not spent on what
    both have in common; the ordinary dictionary sees all windows of ordinary texts.
    """
    telling = _telling(texts, labels)
    toxic = [t for t, y in zip(texts, labels, strict=True) if y == 1]
    ordinary = [t for t, y in zip(texts, labels, strict=True) if y == 0]
    return dictionary(_samples(toxic, telling or None)), dictionary(_samples(ordinary, None))


#: Gains, in bytes, that windows are counted at.
CUTS = (1, 3, 5)


def fit(texts: list[bytes], labels: np.ndarray, share: float = 0.5) -> Model:
    """Trains both dictionaries and calibrates the score.

    A dictionary saves more on what it was made of, so the calibration never sees that: each half of the texts is
    measured under dictionaries of the other half.  The dictionaries that score are then made of all texts.  The
    sample has as many texts of each class as it can; `share` is how much of the labelled rows is toxic, and moves
    the score to what is likely there.  One class alone gives the constant score 0 or 1; no text at all gives 0.
    """
    texts, labels = _distinct(texts, labels)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        constant = 30.0 if len(texts) and labels[0] == 1 else -30.0
        return Model(b"", b"", (1,), (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, constant)
    half = np.zeros(len(texts), np.int64)
    for y in (0, 1):  # both halves have their share of each class
        own = np.flatnonzero(labels == y)
        half[own] = np.arange(len(own)) % 2
    x = np.zeros((len(texts), 1 + 2 * len(CUTS)))
    for k in (0, 1):
        made, measured = np.flatnonzero(half != k), np.flatnonzero(half == k)
        distance = Distance(*_dictionaries([texts[i] for i in made], labels[made]))
        x[measured] = text_features(distance, pa.array([texts[i].decode() for i in measured], pa.large_string()), CUTS)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    weights, bias = _logistic((x - mean) / scale, labels.astype(float))
    bias += float(np.log(share) - np.log1p(-share))
    return Model(*_dictionaries(texts, labels), CUTS, tuple(mean), tuple(scale), tuple(weights), bias)


def in_training(doc_id: Column) -> Column:
    """Whether labels of this document may be learned: the checksum of its id is no multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from at most `rows` labelled texts of each class of at most `most_bytes`, chosen by a hash of their id.

    Only ids that have such a text are drawn from.  Null ids and labels and null or empty texts are left out; an id
    with both labels has no class and is left out; of an id with several texts up to `2 * rows` in all are read.  The
    share of toxic labels is that of all rows that may be learned from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & in_training(F.col("doc_id"))
    )
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = own.where(F.octet_length("text").between(1, most_bytes))
    clear = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    usable = materialize(clear.join(small.select("doc_id"), "doc_id", "left_semi"), "labelled")
    picked = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    found = small.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * rows).collect()
    share = known.agg(F.avg("toxic")).head()[0] or 0.0
    return fit([r.text.encode() for r in found], np.array([r.toxic for r in found], np.int64), min(max(share, 1e-3), 1 - 1e-3))


def score_rows(df: DataFrame, model: Model, text: str = "text", keep_below: float | None = None) -> DataFrame:
    """df with the column `score`; or, given `keep_below`, the rows of df that score less, without it.

    Null and empty texts score as a text without windows that gain; repeated rows repeat; an empty table gives no
    rows.  df must not have a column `score` of its own unless `keep_below` is given.
    """
    place = df.columns.index(text)
    schema = df.schema if keep_below is not None else df.withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.toxic, model.ordinary)
        for batch in batches:
            for part in text_chunks(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(place)):
                scores = model.score(distance, part.column(place))
                out = part.rename_columns(batch.schema.names)
                if keep_below is not None:
                    yield out.filter(pa.array(scores < keep_below))
                else:
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return df.mapInArrow(run, schema)


def score_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents.

    Null and empty texts have the score of a text without windows that gain; null ids count as held out; repeated
    rows repeat; ids with both labels are not learned from; an empty table of labels gives score 0 for all.
    """
    model = train(documents, labels)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_rows(own, model).select(
        "doc_id",
        F.coalesce(~in_training(F.col("doc_id")), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
