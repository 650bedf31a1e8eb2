"""An interpolated bigram model with modified Kneser-Ney discounts, counted in Spark and mapped into memory by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, scratch_dir, segment_hashes, text_chunks, utf8

#: Bytes of text whose tokens a task counts or scores at once.
TEXT_BYTES = 6 << 20
#: Tokens that a task counts before it passes the counts on.
HELD_TOKENS = 1 << 22
#: A word of this share of the tokens or more has its followers dealt out among all shards.
HOT_SHARE = 1000
#: Codes of the end of a text, a token that is predicted, and of its start, which is not.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): for each text the codes of its words, lower-cased within ASCII, and of its end."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    inside = np.r_[False, ~_SPACE[data], False]
    # a text never runs on into the next: its first byte begins a word and its last one ends it
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cuts[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cuts[1:])) + 1
    rows = len(offsets) - 1
    per_text = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=rows).astype(np.int64)
    out_at = np.r_[0, np.cumsum(per_text + 1)]
    out = np.full(out_at[-1], END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[out_at[1:] - 1] = False
    out[is_word] = segment_hashes(data, starts, ends)
    return out, out_at


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their summed counts (of one each, if not given)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.r_[new, len(keys)]) if counts is None else np.add.reduceat(counts, new) if len(keys) else counts
    return keys[new], sums.astype(np.int64)


# ---- files of arrays ---------------------------------------------------------------------------------------------


def _write(folder: str, *arrays: np.ndarray) -> str:
    """Writes arrays one after the other to a new file of a shared folder; a repeated task writes another file."""
    path = f"{folder}/{uuid.uuid4().hex}.bin"
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)
    return path


_opened: dict[str, np.ndarray] = {}


def _mapped(path: str) -> np.ndarray:
    """The bytes of a file, mapped into memory; one of a store without paths is copied first, to a file without a name."""
    if path not in _opened:
        if len(_opened) >= 1 << 14:  # files of models of the past
            _opened.clear()
        store, name = pyarrow.fs.FileSystem.from_uri(path)
        if isinstance(store, pyarrow.fs.LocalFileSystem):
            _opened[path] = np.memmap(name, np.uint8, "r")
        else:
            handle, copy = tempfile.mkstemp()
            with store.open_input_stream(name) as source, os.fdopen(handle, "wb") as out:
                while block := source.read(1 << 20):
                    out.write(block)
            _opened[path] = np.memmap(copy, np.uint8, "r")
            os.unlink(copy)
    return _opened[path]


@dataclass
class Shard:
    """A file with sorted keys and their figures, for keys whose first bits are `number`."""

    number: int
    path: str
    rows: int
    first: int = 0
    types: tuple[str, ...] = ()

    def keys(self) -> np.ndarray:
        return self.arrays()[0] if self.types else self.pair_arrays()[0]

    def pair_arrays(self) -> tuple[np.ndarray, ...]:
        """Keys and counts up to 255 in a byte each; then the places of the counts from 255 on, and those counts."""
        raw = _mapped(self.path)
        n = int(raw[:8].view("<i8")[0])
        at = 8 + 16 * n
        return raw[at : at + 8 * self.rows].view("<u8"), raw[at + 8 * self.rows :], raw[8 : 8 + 8 * n].view("<i8"), raw[8 + 8 * n : at].view("<i8")

    def arrays(self) -> list[np.ndarray]:
        raw, at, out = _mapped(self.path), 0, []
        for t in self.types:
            size = self.rows * np.dtype(t).itemsize
            out.append(raw[at : at + size].view(t))
            at += size
        return out


def _find(shards: dict[int, Shard], numbers: np.ndarray, keys: np.ndarray) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
    """For each shard asked for: which of the keys it has, and where."""
    order = np.lexsort((keys, numbers))
    cuts = np.flatnonzero(np.diff(numbers[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        shard = shards.get(int(numbers[part[0]]))
        if shard is None:
            continue
        sorted_keys = shard.keys()
        at = np.searchsorted(sorted_keys, keys[part])
        hit = (at < shard.rows) & (sorted_keys[np.minimum(at, shard.rows - 1)] == keys[part])
        if hit.any():
            yield shard, part[hit], at[hit]


# ---- the model ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Where the arrays of a model lie, and its totals.  Its size in memory grows with the number of shards only."""

    bits: int
    words: dict[int, Shard] = field(default_factory=dict)  # code -> count
    pairs: dict[int, Shard] = field(default_factory=dict)  # places of both words -> count
    sides: dict[int, Shard] = field(default_factory=dict)  # by place: words before, then followers, by 1, 2 and more counts
    n_tokens: int = 0
    n_words: int = 0
    discounts: np.ndarray = field(default_factory=lambda: np.zeros((2, 4)))  # of words and of pairs, by count
    before: np.ndarray = field(default_factory=lambda: np.zeros(3, np.int64))  # words with 1, 2, more words before them
    n_pairs: int = 0

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of each code; -1 and 0 for a code that was not learned."""
        place, count = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        for shard, at, where in _find(self.words, _shard_of(codes, self.bits), codes):
            place[at] = shard.first + where
            count[at] = shard.arrays()[1][where]
        return place, count

    def pair_shards(self, left: np.ndarray, left_count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Followers of a word lie together, but for hot words, whose followers are dealt out."""
        hot = (left_count * HOT_SHARE > self.n_tokens) | (left_count == 0)  # only the start of texts has no count
        return _shard_of(mix64(np.where(hot, pairs, left.astype(np.uint64))), self.bits)

    def pair_counts(self, shards: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        count = np.zeros(len(pairs), np.int64)
        for shard, at, where in _find(self.pairs, shards, pairs):
            found = shard.pair_arrays()[1][where].astype(np.int64)
            places, large = shard.pair_arrays()[2:]
            found[found == 255] = large[np.searchsorted(places, where[found == 255])]
            count[at] = found
        return count

    def side_counts(self, place: np.ndarray) -> np.ndarray:
        """(words before, followers once, twice, more often, followers' counts) of each place; zeros for -1."""
        out = np.zeros((len(place), 5), np.int64)
        firsts = np.array(sorted(s.first for s in self.sides.values()), np.int64)
        by_first = {s.first: s for s in self.sides.values()}
        owner = np.searchsorted(firsts, place, "right") - 1
        for k in np.unique(owner[place >= 0]):
            shard = by_first[int(firsts[k])]
            at = np.flatnonzero((owner == k) & (place >= 0))
            out[at] = np.stack([a[place[at] - shard.first] for a in shard.arrays()], 1)
        return out

    def log10(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the probability, count) of each token of texts that begin at offsets."""
        kinds, back = np.unique(codes, return_inverse=True)
        place, count = self.places(kinds)
        here, own = place[back], count[back]
        start, start_count = self.places(np.array([START]))
        left, left_count = np.r_[start, here[:-1]], np.r_[start_count, own[:-1]]
        left[offsets[:-1]], left_count[offsets[:-1]] = start[0], start_count[0]
        # what follows is worked out once for each different pair
        pair = left.astype(np.uint64) << np.uint64(32) | (here.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        _, one, back = np.unique(pair, return_index=True, return_inverse=True)
        left, left_count, here, pair = left[one], left_count[one], here[one], pair[one]
        known = (left >= 0) & (here >= 0)
        n = np.zeros(len(pair), np.int64)
        n[known] = self.pair_counts(self.pair_shards(left[known], left_count[known], pair[known]), pair[known])
        found, at = np.unique(np.r_[here, left], return_inverse=True)
        sides = self.side_counts(found)[at]
        before, follow = sides[: len(here), 0], sides[len(here) :, 1:]
        d1, d2 = self.discounts
        free = 1.0 / (self.n_words + 1)
        p = np.full(len(pair), free)
        if self.n_pairs:
            p = (np.maximum(before - d1[np.minimum(before, 3)], 0) + (self.before @ d1[1:]) * free) / self.n_pairs
        total = follow[:, 3]
        seen = total > 0
        p[seen] = (np.maximum(n - d2[np.minimum(n, 3)], 0)[seen] + (follow[:, :3] @ d2[1:])[seen] * p[seen]) / total[seen]
        return np.log10(p)[back], own


def _shard_of(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(codes), np.int64)


def discounts_of(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more from the numbers of n-grams with counts 1 to 4.

    Where one of the first three is zero, as in tiny tables, the customary half, one and one and a half.
    """
    n1, n2, n3, n4 = (float(x) for x in counts)
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


#: Counts of keys on their way to a shard, and what leaves the writer of a shard: its file, or figures for another shard.
_SUMS = "shard int, key long, a long"
_ROW = "kind int, shard int, key long, a long, b long, c long, d long, path string"
_NAMES = ["kind", "shard", "key", "a", "b", "c", "d", "path"]
_FILE, _COUNT, _SIDE = 0, 1, 2


def _sums(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], _NAMES[1:4])


def _rows(kind: int, shard: np.ndarray | int, key: np.ndarray | list, *figures, path: str | None = None) -> pa.RecordBatch:
    n = len(key)
    columns = [np.full(n, kind, np.int32), np.full(n, shard, np.int32), np.asarray(key, np.int64)]
    columns += [np.asarray(f, np.int64) for f in figures] + [np.zeros(n, np.int64)] * (4 - len(figures))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([path] * n, pa.string())], _NAMES)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, sorted keys with figures) from rows sorted by shard and key; a shard is held, in columns of numbers."""
    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "key", "a")])
        for part in np.split(columns, np.flatnonzero(np.diff(columns[0])) + 1, axis=1):
            if part[0, 0] != now and held:
                yield now, np.concatenate(held, 1)
                held = []
            now = part[0, 0]
            held.append(part[1:])
    if held:
        yield now, np.concatenate(held, 1)


def _flushed(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Summed keys of texts, passed on after each HELD_TOKENS of them."""
    held, n = [], 0
    for batch in batches:
        for part in text_chunks(batch, limit=TEXT_BYTES):
            found = keys_of(*tokens(part.column("text")))
            held.append(found)
            n += len(found)
            if n > HELD_TOKENS:
                yield _summed(np.concatenate(held))
                held, n = [], 0
    if held:
        yield _summed(np.concatenate(held))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "key")


def train(df: DataFrame, text: str = "text", bits: int | None = None) -> Model:
    """Learns from every text of df (null: empty): words, then pairs of neighbours, then what each word has on its sides.

    Counts are summed by task, shuffled by 2 ** bits shards of hashed keys (by default four times the partitions of a
    shuffle) and written as sorted arrays to the shared folder, where workers map them.  Only a row for each shard goes
    to the driver.  An empty table gives a model in which all is unknown.  A task holds a shard: raise `bits` with the
    input.
    """
    spark = df.sparkSession
    if bits is None:
        bits = (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    folder = f"{scratch_dir(spark)}/kneser-{uuid.uuid4().hex}"
    own = df.select(F.col(text).cast("string").alias("text"))
    model = Model(bits)

    # words and their counts; the place of a word among all sorted codes is its name from here on
    def count_words(batches):
        for keys, counts in _flushed(batches, lambda codes, _: codes):
            yield _sums(_shard_of(keys, bits), keys, counts)

    def write_words(batches):
        for shard, rows in _grouped(batches):
            keys, counts = _summed(rows[0].view(np.uint64), rows[1])
            if shard == int(_shard_of(np.array([START]), bits)[0]):
                keys, counts = _summed(np.r_[keys, START], np.r_[counts, 0])
            path = _write(folder, keys, counts)
            yield _rows(_FILE, shard, [len(keys)], [counts.sum()], [(counts > 0).sum()], path=path)

    first = 0
    files = _dealt(own.mapInArrow(count_words, _SUMS)).mapInArrow(write_words, _ROW).collect()
    for r in sorted(files, key=lambda r: r.shard):
        model.words[r.shard] = Shard(r.shard, r.path, r.key, first, ("<u8", "<i8"))
        first += r.key
        model.n_tokens += r.a
        model.n_words += r.b
    if not files:
        return model
    if first >= 1 << 32:
        raise ValueError("a model has at most 2**32 different words")
    if not (n := int(_shard_of(np.array([START]), bits)[0])) in model.words:  # no word fell into the shard of the start
        model.words[n] = Shard(n, _write(folder, np.array([START]), np.zeros(1, np.int64)), 1, first, ("<u8", "<i8"))

    # pairs of neighbours, as the places of both
    def count_pairs(batches):
        start = model.places(np.array([START]))[0][0]

        def keys_of(codes, offsets):
            kinds, back = np.unique(codes, return_inverse=True)
            here = model.places(kinds)[0].astype(np.uint64)[back]
            left = np.r_[np.uint64(start), here[:-1]]
            left[offsets[:-1]] = start
            return left << np.uint64(32) | here

        counts_of = _Counts(model)
        for keys, counts in _flushed(batches, keys_of):
            left = (keys >> np.uint64(32)).astype(np.int64)
            yield _sums(model.pair_shards(left, counts_of(left), keys), keys, counts)

    def write_pairs(batches):
        for shard, rows in _grouped(batches):
            keys, counts = _summed(rows[0].view(np.uint64), rows[1])
            levels = [(counts == k).sum() for k in (1, 2, 3, 4)]
            large = np.flatnonzero(counts >= 255)
            path = _write(folder, np.array([len(large)]), large, counts[large], keys, np.minimum(counts, 255).astype(np.uint8))
            yield _rows(_FILE, shard, [len(keys)], *([x] for x in levels), path=path)
            left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            lefts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
            sums = [np.add.reduceat(x.astype(np.int64), lefts) for x in (counts == 1, counts == 2, counts > 2, counts)]
            yield _rows(_SIDE, model_owner(left[lefts]), left[lefts], *sums)
            rights, n = _summed(right)
            yield _rows(_COUNT, model_owner(rights), rights, n)

    firsts = np.array([s.first for s in sorted(model.words.values(), key=lambda s: s.first)], np.int64)

    def model_owner(places):
        return np.searchsorted(firsts, places, "right") - 1

    dealt = _dealt(own.mapInArrow(count_pairs, _SUMS)).mapInArrow(write_pairs, _ROW)
    sides = {i: s for i, s in enumerate(sorted(model.words.values(), key=lambda s: s.first))}

    # dense arrays by place, for each shard of words
    def write_sides(batches):
        now, arrays = None, None
        for batch in batches:
            held = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in _NAMES[:-1]}
            files = batch.filter(pa.array(held["kind"] == _FILE))
            if files.num_rows:
                yield files
            order = np.flatnonzero(held["kind"] != _FILE)
            for part in np.split(order, np.flatnonzero(np.diff(held["shard"][order])) + 1) if len(order) else ():
                shard = int(held["shard"][part[0]])
                if shard != now:
                    if arrays is not None:
                        yield finish(now, arrays)
                    now, arrays = shard, np.zeros((5, sides[shard].rows), np.int64)
                at, kind = held["key"][part] - sides[shard].first, held["kind"][part]
                np.add.at(arrays[0], at[kind == _COUNT], held["a"][part][kind == _COUNT])
                for k, n in enumerate("abcd"):
                    np.add.at(arrays[k + 1], at[kind == _SIDE], held[n][part][kind == _SIDE])
        if arrays is not None:
            yield finish(now, arrays)

    def finish(shard, arrays):
        levels = [[(arrays[0] == k).sum()] for k in (1, 2, 3, 4)]
        return _rows(_SIDE, shard, [(arrays[0] > 2).sum()], *levels, path=_write(folder, arrays[:4].astype(np.uint32), arrays[4]))

    files = _side_rows(dealt).mapInArrow(write_sides, _ROW).collect()
    levels = np.zeros((2, 4), np.int64)
    for r in files:
        if r.kind == _FILE:
            model.pairs[r.shard] = Shard(r.shard, r.path, r.key)
            model.n_pairs += r.key
            levels[1] += (r.a, r.b, r.c, r.d)
        else:
            s = sides[r.shard]
            model.sides[r.shard] = Shard(r.shard, r.path, s.rows, s.first, ("<u4",) * 4 + ("<i8",))
            levels[0] += (r.a, r.b, r.c, r.d)
            model.before += (r.a, r.b, r.key)
    model.discounts = np.stack([discounts_of(x) for x in levels])
    return model


def _side_rows(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions(F.col("kind") != _FILE, "shard")


class _Counts:
    """Counts of words by place."""

    def __init__(self, model: Model):
        self.shards = sorted(model.words.values(), key=lambda s: s.first)
        self.firsts = np.array([s.first for s in self.shards], np.int64)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        owner = np.searchsorted(self.firsts, places, "right") - 1
        for k in np.unique(owner):
            at = owner == k
            out[at] = self.shards[k].arrays()[1][places[at] - self.shards[k].first]
        return out


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df, with all its columns, and n_tokens, n_known, base_score and score of their whole texts.

    The score is the log10 probability of the text under the model, the base score that under counts plus one.  A null
    or empty text is its end alone.  Columns of df by these names are an error.
    """
    added = ["n_tokens", "n_known", "base_score", "score"]
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = df.selectExpr("*", "0L n_tokens", "0L n_known", "0D base_score", "0D score").schema
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part in text_chunks(numbered, str(place), TEXT_BYTES):
                codes, offsets = tokens(part.column(place))
                logs, counts = model.log10(codes, offsets)
                base = np.log10((counts + 1) / (model.n_tokens + model.n_words + 1))
                sums = [np.add.reduceat(x, offsets[:-1]) for x in ((counts > 0).astype(np.int64), base, logs)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(offsets)), *map(pa.array, sums)], [*batch.schema.names, *added])

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """A seventh of the ids, which are not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every row of df by a model of those that are not held out.

    A null doc_id stays null and is learned from; repeated rows count and give rows each; other columns are not read.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = held_out(F.col("doc_id"))
    model = train(own.where(~out))
    return score(own, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
