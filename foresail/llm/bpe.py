"""Byte-level BPE: a minimal perfect hash for pre-tokens in the vocabulary, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, segment_hashes, text_chunks, texts

#: Pre-tokens outside the vocabulary whose merges a worker remembers; all are forgotten when there are more.
MEMO = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _joined(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


class PerfectHash:
    """A minimal perfect hash by hash-and-displace: n keys to the slots 0..n-1, one displacement for a few keys.

    `lookup` compares the bytes found in the slot, so that strangers give -1.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // load)
        data, at = _joined(keys)
        hashes = segment_hashes(data, at[:-1], at[1:])
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(n, bool)
        slots = np.zeros(n, np.int64)
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():  # the fullest first
            own = order[bounds[b] : bounds[b + 1]]
            if not len(own):
                break
            d = 0
            while True:
                tried = np.arange(d, d + 64, dtype=np.uint64)
                found = (mix64(hashes[own][None, :] + (tried[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                good = ~taken[found].any(1)
                if len(own) > 1 and good.any():
                    s = np.sort(found, 1)
                    good &= (s[:, 1:] != s[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b] = d + k
                    slots[own] = found[k]
                    taken[found[k]] = True
                    break
                d += 64
        placed = np.empty(n, np.int64)
        placed[slots] = np.arange(n)
        self.values = np.asarray(values, np.int64)[placed]
        self.data, self.at = _joined([keys[i] for i in placed.tolist()])

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        data, at = _joined(keys)
        hashes = segment_hashes(data, at[:-1], at[1:])
        moved = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slot = (mix64(hashes + (moved + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        sizes = np.diff(at)
        same = np.flatnonzero(sizes == self.at[slot + 1] - self.at[slot])
        out = np.full(len(keys), -1, np.int64)
        if len(same):
            owner = np.repeat(np.arange(len(same)), sizes[same])
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[same]) - sizes[same], sizes[same])
            differs = data[at[:-1][same][owner] + inner] != self.data[self.at[slot[same]][owner] + inner]
            equal = np.bincount(owner, differs, len(same)) == 0
            out[same[equal]] = self.values[slot[same[equal]]]
        return out


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: linked bytes, the pair of lowest rank (leftmost first) merged until none is left."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 for a start that was merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r << 32) | i for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        j = end[i]
        if j == 0 or j == n:
            continue
        k = end[j]
        if get(word[i:k]) != top >> 32:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            if (r := get(word[i : end[k]])) is not None:
                push(heap, (r << 32) | i)
        if (h := before[i]) >= 0 and (r := get(word[h:k])) is not None:
            push(heap, (r << 32) | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Coder:
    """Encodes and decodes whole texts by a rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        tokens = list(self.ranks)
        self.known = PerfectHash(tokens, [self.ranks[t] for t in tokens])
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.memo: dict[str, bytes] = {}

    def encode(self, held: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(x) for x in held]
        table: dict[str, bytes] = {}
        fresh = list(set().union(*pieces)) if pieces else []
        coded = [x.encode() for x in fresh]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, ranks = self.memo, self.ranks
        for x, raw, found in zip(fresh, coded, self.known.lookup(coded).tolist(), strict=True):
            if found >= 0:
                table[x] = struct.pack("<I", found)
            elif len(raw) > 64:
                table[x] = np.array(heap_merge(raw, ranks), "<u4").tobytes()
            else:
                ids = memo.get(x)
                if ids is None:
                    merged = heap_merge(raw, ranks)
                    memo[x] = ids = struct.pack(f"<{len(merged)}I", *merged)
                table[x] = ids
        return [b"".join(map(table.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One coder for each worker process."""
    return Coder(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row of df: ids as little-endian unsigned 32-bit integers in a binary, and the bytes they decode to.

    A null or empty text gives no ids; null ids stay null, repeated rows repeat, other columns are not read, and an
    empty table gives no rows.  `path` names a rank file that each worker can read, `pattern` the pre-token pattern.
    """
    own = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 21):
                ids = c.encode(texts(part.column("text")))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(map(c.decode, ids), pa.binary())}
                )

    return own.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts and digests of `encode_texts`."""
    return encode_texts(df, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
