"""Runs of words that repeat with a period, found by the Lyndon words that begin at each place."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least this many words, and this many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words compared one by one before hashes are made use of.
DIRECT = 12
_MODULUS = (1 << 61) - 1
_BASE = random.Random(11).randrange(1 << 40, _MODULUS)

RUNS_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extensions:
    """How far the words from two places agree, to the right and to the left.

    Few words are compared directly.  Beyond them the length is sought by bisection over rolling hashes, and the words
    are compared after it; for each distance the stretch that was compared is kept, so that no word is compared twice
    at one distance.
    """

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self._sums: list[int] | None = None
        self._powers: list[int] = []
        self._same: dict[int, tuple[int, int]] = {}  # distance -> [from, to): word k equals word k + distance

    def _hash(self, start: int, length: int) -> int:
        return (self._sums[start + length] - self._sums[start] * self._powers[length]) % _MODULUS

    def _prepare(self) -> None:
        self._sums = list(accumulate(self.words, lambda s, w: (s * _BASE + w + 1) % _MODULUS, initial=0))
        self._powers = list(accumulate(range(self.n), lambda p, _: p * _BASE % _MODULUS, initial=1))

    def _equal(self, at: int, to: int, d: int) -> bool:
        return self.words[at:to] == self.words[at + d : to + d]

    def right(self, i: int, j: int) -> int:
        """The number of words from i on that equal those from j on; i < j."""
        words, d = self.words, j - i
        most = self.n - j
        for k in range(min(DIRECT, most)):
            if words[i + k] != words[j + k]:
                return k
        if most <= DIRECT:
            return most
        lo, hi = self._same.get(d, (0, 0))
        if lo <= i + DIRECT and hi > i:  # reaches a stretch that is known, which ends where the words differ
            self._same[d] = (min(lo, i), hi)
            return hi - i
        if self._sums is None:
            self._prepare()
        low, high = DIRECT, most
        while low < high:
            mid = (low + high + 1) // 2
            if self._hash(i, mid) == self._hash(j, mid):
                low = mid
            else:
                high = mid - 1
        if not self._equal(i, i + low, d):  # two different stretches with one hash
            low = next(k for k in range(low) if words[i + k] != words[j + k])
        self._same[d] = (i, i + low)
        return low

    def left(self, i: int, j: int) -> int:
        """The number of words before i that equal those before j; i < j."""
        words, d = self.words, j - i
        for k in range(min(DIRECT, i)):
            if words[i - 1 - k] != words[j - 1 - k]:
                return k
        if i <= DIRECT:
            return i
        if self._sums is None:
            self._prepare()
        low, high = DIRECT, i
        while low < high:
            mid = (low + high + 1) // 2
            if self._hash(i - mid, mid) == self._hash(j - mid, mid):
                low = mid
            else:
                high = mid - 1
        if not self._equal(i - low, i, d):
            low = next(k for k in range(low) if words[i - 1 - k] != words[j - 1 - k])
        return low


def lyndon_ends(words: list[int], reach: Extensions, reverse: bool) -> list[int]:
    """For each place the end of the longest Lyndon word that begins there, by one scan from right to left.

    The stack holds the beginnings of the Lyndon factors of what was scanned; a new place takes in the factors whose
    suffix is greater than its own.  `reverse` turns the order of words round; an end comes before any word in both.
    """
    n = len(words)
    ends, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        first = words[i]
        while stack:
            j = stack[-1]
            a, b = first, words[j]
            if a == b:
                k = reach.right(i, j)
                if j + k == n:
                    break  # the later suffix is the beginning of this one, hence smaller
                a, b = words[i + k], words[j + k]
            if (a < b) == reverse:
                break
            stack.pop()
        if stack:
            ends[i] = stack[-1]
        stack.append(i)
    return ends


def _runs_of_stretch(words: list[int], min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least min_exponent (2 or more) periods."""
    reach, n = Extensions(words), len(words)
    found: set[tuple[int, int, int]] = set()
    for reverse in (False, True):
        last: dict[int, int] = {}  # period -> where its last run ends
        for i, j in enumerate(lyndon_ends(words, reach, reverse)):
            p = j - i
            if j == n or words[i] != words[j] or i < last.get(p, 0) - p:
                continue
            right = reach.right(i, j)
            if right < p * (min_exponent - 2):
                continue  # some place in a run of enough periods has more of it on its right
            s, e = i - reach.left(i, j), j + right
            last[p] = e
            if e - s >= min_exponent * p:
                found.add((s, e - s, p))
    return list(found)


def runs_of_words(words: list[str], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of all runs: smallest period q, length >= max(min_words, min_exponent * q).

    A word of such a run occurs at least min_exponent times, so words that are rarer in the text cut it into
    stretches that are searched for themselves.
    """
    counts = Counter(words)
    code = {w: k for k, (w, c) in enumerate(counts.items()) if c >= min_exponent}
    if not code:
        return []
    codes = [code.get(w, -1) for w in words]
    codes.append(-1)
    out, at, n = [], 0, len(codes)
    while at < n:
        stop = codes.index(-1, at)
        if stop - at >= min_words:
            out += [(at + s, ln, p) for s, ln, p in _runs_of_stretch(codes[at:stop], min_exponent) if ln >= min_words]
        at = stop + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    dropped = bytearray(len(words))
    for s, length, p in runs:
        dropped[s + p : s + length] = b"\1" * (length - p)
    return " ".join([w for w, d in zip(words, dropped, strict=True) if not d])


def find_runs(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rewrite: Callable[[int | None, list[str]], list[str]] | None = None,
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row for each row of df: its number of words, all its runs by start and period, and its collapsed text.

    `rewrite` may change the words of a text first.  A null or empty text has no words, no runs and an empty collapsed
    text; a null doc_id stays null; repeated rows give repeated rows; other columns of df are not read.  Texts are
    never cut: time is about linear in the words, memory that of one text.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                sizes, all_runs, left = [], [], []
                for key, value in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
                    words = WORD.findall(value)
                    if rewrite is not None:
                        words = rewrite(key, words)
                    found = runs_of_words(words, min_words, min_exponent)
                    sizes.append(len(words))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    left.append(collapse(words, found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(all_runs, kind), pa.array(left, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return own.mapInArrow(run, RUNS_SCHEMA)


def plant(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with a run at the end, for a tenth of the ids; a null id has none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def run_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the runs of each text after `plant`, with its longest run (ties: first, then shortest period).

    Nulls, empty texts, repeated rows and other columns are as for `find_runs`; without runs start, length, period and
    exponent_milli are null, and the digests are those of no bytes and of the whole text.
    """
    found = find_runs(df, doc_id, text, plant)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.n").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("(1000 * top.n) div (-top.p)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
