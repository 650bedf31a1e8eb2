"""Hierarchical packing of documents into windows of several lengths, with balanced step groups."""

from __future__ import annotations

import base64
import bisect
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, texts

#: Window lengths.  All are powers of two, so that every shorter window divides every longer one.
TIERS: tuple[int, ...] = (128, 256, 512, 1024)
#: Tokens of pieces that a task holds before it packs them, and of the windows in a step group.
POOL_TOKENS = 1 << 20
GROUP_TOKENS = 8192
#: Characters that both libraries class alike, as the tests show for each of them; texts with others take the slower one.
PLAIN = range(0x250)

PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class Tokens:
    """Token ids by the tokenizer file, as little-endian unsigned 32-bit integers.

    Texts of PLAIN characters without the file's added tokens go to a faster library with the same ranks, unless the
    file names a normalizer; all others go to the library that the file is for.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.quick = None
        own = json.loads(self.exact.to_str())
        added = "".join("|" + regex.escape(t["content"]) for t in own["added_tokens"])
        self.unusual = regex.compile(f"[^{chr(PLAIN[0])}-{chr(PLAIN[-1])}]{added}").search
        if ranks_path and pattern and own["normalizer"] is None:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.quick is not None and not self.unusual(text):
            return np.array(self.quick.encode_ordinary(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def tokens_of(path: str, ranks_path: str | None, pattern: str | None) -> Tokens:
    """One tokenizer for each worker process."""
    return Tokens(path, ranks_path, pattern)


class Packer:
    """Packs the pieces of one task.  Windows are closed when they are full; a task leaves one short window at most.

    A document's full windows of the longest tier go out as they are.  What is left of it goes to the shortest tier
    that holds it.  In each tier, from the longest down, pieces are laid best-fit decreasing; the gaps that stay are
    filled from the shorter tiers, whole pieces first, then the head of a piece that is cut.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS):
        self.tiers, self.pool_tokens = tuple(sorted(tiers)), pool_tokens
        self.held: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        """Takes a document; yields windows (length, pieces) that are complete."""
        top, n = self.tiers[-1], len(ids)
        whole = n // top * top
        for at in range(0, whole, top):
            yield top, [(doc_id, at, ids[at : at + top], n)]
        if whole < n:
            self.held.append((doc_id, whole, ids[whole:], n))
            self.tokens += n - whole
        if self.tokens >= self.pool_tokens:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple[int, list[tuple]]]:
        """Packs what is held; unless it is the last time, pieces that fill no window are held on."""
        pools: dict[int, list[tuple[int, int]]] = {t: [] for t in self.tiers}  # (length, number of the piece), ascending
        pieces = self.held
        for k, p in enumerate(pieces):
            pools[next(t for t in self.tiers if len(p[2]) <= t)].append((len(p[2]), k))
        for pool in pools.values():
            pool.sort()
        self.held, self.tokens = [], 0

        def cut(k: int, n: int) -> tuple:
            doc, start, ids, total = pieces[k]
            pieces[k] = (doc, start + n, ids[n:], total)
            return doc, start, ids[:n], total

        open_windows: list[list[tuple]] = []
        for i in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[i]
            lower = [pools[t] for t in self.tiers[i::-1]]
            while pools[tier]:
                n, k = pools[tier].pop()
                window, room = [pieces[k]], tier - n
                while room:
                    fits = None
                    for pool in lower:  # the longest piece that fits whole
                        at = bisect.bisect_right(pool, (room, len(pieces)))
                        if at and (fits is None or pool[at - 1][0] > fits[0]):
                            fits = (pool[at - 1][0], pool, at - 1)
                    if fits is None:
                        break
                    size, pool, at = fits
                    window.append(pieces[pool.pop(at)[1]])
                    room -= size
                if room:  # every piece that is left is longer: cut the shortest of them
                    pool = next((p for p in reversed(lower) if p), None)
                    if pool is not None:
                        size, k = pool.pop(0)
                        window.append(cut(k, room))
                        room = 0
                        bisect.insort(pools[next(t for t in self.tiers if size - len(window[-1][2]) <= t)], (size - len(window[-1][2]), k))
                if room:
                    open_windows.append(window)
                else:
                    yield tier, window
        rest = [p for w in open_windows for p in w]
        if not last:
            self.held = rest
            self.tokens = sum(len(p[2]) for p in rest)
            return
        yield from self._close(rest)

    def _close(self, rest: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
        """The end of a task: windows of falling length while they can be full, then one that is padded."""
        left = sum(len(p[2]) for p in rest)
        while left:
            tier = next((t for t in reversed(self.tiers) if t <= left), None)
            room, window = tier or left, []
            left -= room
            while room:
                doc, start, ids, total = rest[0]
                n = min(room, len(ids))
                window.append((doc, start, ids[:n], total))
                room -= n
                rest[0] = (doc, start + n, ids[n:], total)
                if n == len(ids):
                    rest.pop(0)
            yield tier or self.tiers[-1], window


def step_groups(windows: list[int], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """A group for each window: the longest first, each to the group with the fewest tokens so far."""
    groups = max(1, -(-sum(windows) // group_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i]):
        n, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (n + windows[i], g))
    return out


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    tiers: tuple[int, ...] = TIERS,
    pool_tokens: int = POOL_TOKENS,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row for each piece: where it comes from, its ids, its sequence, its offset there, and the step group.

    Ids are those of the tokenizer file, with `end_id` after each document.  Every sequence is full at a tier's
    length, but for one at the end of each task.  Tasks pack what they read, so nothing is shuffled; sequences and
    groups are numbered in the task with the partition in the high bits, so that a task that runs again gives the
    same rows.  A null or empty text is the end id alone; repeated rows are packed each; null ids stay null; other
    columns are not read; an empty table gives no rows.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        high = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        t, packer = tokens_of(tokenizer, ranks, pattern), Packer(tiers, pool_tokens)
        sequence = group = 0

        def rows(windows: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
            nonlocal sequence, group
            groups = step_groups([w for w, _ in windows], group_tokens)
            out = []
            for (window, pieces), g in zip(windows, groups, strict=True):
                at = 0
                for doc, start, ids, total in pieces:
                    out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, high + sequence, at, window, high + group + g))
                    at += len(ids)
                sequence += 1
            group += max(groups) + 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        made: list[tuple[int, list[tuple]]] = []
        size = 0

        def take(found: Iterator[tuple[int, list[tuple]]]) -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            for w in found:
                made.append(w)
                size += w[0]
                if size >= 64 * group_tokens:
                    yield rows(made)
                    made, size = [], 0

        for batch in batches:
            for part in text_chunks(batch):
                for doc, x in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
                    yield from take(packer.add(doc, np.append(t.ids(x), np.uint32(end_id))))
        yield from take(packer.flush())
        if made:
            yield rows(made)

    return own.mapInArrow(run, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")
