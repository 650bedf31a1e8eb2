"""Spelling variants: words one edit apart, found in blocks of dictionaries sorted forwards and backwards."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks, texts

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form is this many times as frequent as its variant, at least.
RATIO = 5
#: Blocks of more words than this are subdivided before they are scanned; it changes cost only.
BLOCK = 128
#: Different words that a task counts before it passes their counts on.
HELD_WORDS = 200_000
#: Characters of a comparison at once.
_CELLS = 1 << 21

_BLOCK = ("short", "from", "to", "head", "tail")


def runs_of(least: int) -> re.Pattern:
    return re.compile("[A-Za-zÀ-ÿ]{%d,}" % max(least, 1))


def count_words(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rewrite: Callable[[int | None, str], str] | None = None,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of all words of df of min_length code points and min_count occurrences, lower-cased within ASCII.

    `rewrite` maps a word of a document to what is counted.  It must not make words longer.  Null and empty texts have
    no words; a null doc_id is passed on; repeated rows count each; other columns are not read.
    """
    pattern = runs_of(min_length)
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in text_chunks(batch):
                for key, value in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
                    found = pattern.findall(value.encode().lower().decode())
                    if rewrite is None:
                        held.update(found)
                        continue
                    for word, n in Counter(found).items():
                        word = rewrite(key, word)
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) > HELD_WORDS:
                    yield out(held)
                    held = Counter()
        yield out(held)

    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _sides(words: DataFrame) -> DataFrame:
    """Each word in the blocks of its halves, once as the shorter word of a pair and once as the longer.

    Of two words one edit apart, the shorter with `short` letters, the edit lies before or after the middle of the
    shorter: the letters after it, or before it, are the same.  A block holds the words of `short` or one more letters
    whose letters outside [from, to) of the shorter word are the same.
    """
    size = F.length("word")
    shorts = F.explode(F.array(size, size - 1)).alias("short")
    half = F.floor(F.col("short") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("from"), half.alias("to")), F.struct(half.alias("from"), F.col("short").alias("to")))
    return _keyed(words.select("word", "n", shorts).select("word", "n", "short", F.explode(spans).alias("span")).select("word", "n", "short", "span.from", "span.to"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "word", "n", "short", "`from`", "`to`", "substring(word, 1, `from`) as head", "substring(word, length(word) - (short - `to`) + 1) as tail"
    )


def _fitting_blocks(words: DataFrame, limit: int) -> DataFrame:
    """The rows of all blocks, where blocks of more than `limit` words are halved until they fit or hold one place.

    A block of one place can't grow with the input: its words differ in one letter, or in two that a longer word has.
    """
    todo, done = materialize(_sides(words), "spelling-sides"), None
    while True:
        large = todo.groupBy(*_BLOCK).count().where((F.col("count") > limit) & (F.col("to") - F.col("from") > 1)).select(*_BLOCK)
        large = materialize(large.withColumn("large", F.lit(True)), "spelling-large")
        if large.isEmpty():
            return todo if done is None else done.unionByName(todo)
        marked = materialize(todo.join(large, list(_BLOCK), "left"), "spelling-marked")
        small = marked.where(F.col("large").isNull()).select(*todo.columns)
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("from") + F.col("to")) / 2).cast("int")
        spans = F.array(F.struct(F.col("from"), middle.alias("to")), F.struct(middle.alias("from"), F.col("to")))
        halves = marked.where("large").select("word", "n", "short", F.explode(spans).alias("span"))
        todo = materialize(_keyed(halves.select("word", "n", "short", "span.from", "span.to")), "spelling-halves")


def _compare(letters: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, long: np.ndarray, at_end: bool) -> np.ndarray:
    """Which pairs (a, b) are one edit apart at a place that this block answers for.

    `letters` has a row of width + 1 for each word, the letters that its block doesn't fix.
    """
    keep = np.zeros(len(a), bool)
    step = max(1, _CELLS // (width + 1))
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        swap = long[x] & ~long[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        left, right = letters[x], letters[y]
        same = left == right
        exact = ~long[x] & ~long[y] & (width + 1 - same.sum(1) == 1)
        mixed = np.flatnonzero(~long[x] & long[y])
        if len(mixed):
            before = np.minimum.accumulate(same[mixed, :width], 1).sum(1)
            after = np.minimum.accumulate((left[mixed, :width] == right[mixed, 1:])[:, ::-1], 1).sum(1)
            exact[mixed] = (before + after >= width) & (at_end | (before < width))
        keep[at : at + step] = exact
    return keep


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of blocks that follow each other in order."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _starts(table)
        held = table.slice(starts[-1])
        yield from _scan_blocks(table.slice(0, starts[-1]))
    if held is not None:
        yield from _scan_blocks(held)


def _starts(table: pa.Table) -> np.ndarray:
    """Where blocks begin."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for name in _BLOCK:
        column = table.column(name).combine_chunks()
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _scan_blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if table.num_rows == 0:
        return
    starts = _starts(table)
    spans = [table.column(c).to_numpy()[starts] for c in ("short", "from", "to")]
    kinds = np.flatnonzero(np.r_[True, (spans[0][1:] != spans[0][:-1]) | (spans[1][1:] != spans[1][:-1]) | (spans[2][1:] != spans[2][:-1])])
    ends = np.r_[starts[1:], table.num_rows]
    for first, stop in zip(kinds, np.r_[kinds[1:], len(starts)], strict=True):
        yield from _scan_kind(table.slice(starts[first], ends[stop - 1] - starts[first]), starts[first:stop] - starts[first], *(int(s[first]) for s in spans))


def _scan_kind(table: pa.Table, starts: np.ndarray, short: int, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pairs in blocks that fix the same places: each word with the next in its block, the next but one, and so on."""
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    width, rows = end - begin, len(words)
    sizes = np.diff(np.r_[starts, rows])
    if sizes.max() < 2:
        return
    free = [w[begin : len(w) - (short - end)] for w in words]
    letters = np.array(free, f"U{width + 1}").view(np.uint32).reshape(rows, width + 1)
    long = np.fromiter((len(w) > short for w in words), bool, rows)
    last = np.repeat(starts + sizes, sizes)
    left = np.arange(rows)
    for step in range(1, int(sizes.max())):
        left = left[left + step < last[left]]
        hits = left[_compare(letters, width, left, left + step, long, end == short)]
        if len(hits):
            a, b = np.r_[hits, hits + step], np.r_[hits + step, hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in a], pa.string()), pa.array([words[i] for i in b], pa.string()), pa.array(counts[b], pa.int64())],
                ["word", "near", "near_n"],
            )


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all pairs of words (word string, n long; each word once) one edit apart, both ways round."""
    placed = _fitting_blocks(words, limit).repartition(*_BLOCK).sortWithinPartitions("short", "from", "to", "head", F.reverse("tail"), "word")
    return placed.mapInArrow(_scan, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the forms lead to.  Steps double each round; forms grow, so there are no rings."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, limit: int = BLOCK) -> DataFrame:
    """One row for each word of (word, n): its number of near words, its form and root.

    The form is the near word of largest n (ties: first by code points) if that n is `ratio` times the word's n or
    more, else null; the root is where forms lead to, the word itself without one.  An empty table gives no rows.
    """
    words = materialize(words, "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words, limit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    out = materialize(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.near")).alias("form"),
            F.when(has, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return out.join(roots(out.where(F.col("form").isNotNull())), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def misspell(doc_id: int | None, word: str) -> str:
    """The word without one letter, for one in 199 pairs of document and word; a null id leaves words as they are."""
    if doc_id is None:
        return word
    h = zlib.crc32(word.encode(), zlib.crc32(b"%d:" % doc_id))
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def variant_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among the words of df after `misspell`; nulls, empty texts, repeated rows and other columns as there."""
    return group_variants(count_words(df, doc_id, text, misspell))
