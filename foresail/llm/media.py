"""Media columns in content-defined chunks: gear-hash cuts, chunks deduplicated by digest, ordered chunk lists."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, text_chunks

#: Bytes of a chunk: cuts are looked for from MIN on, come every AVERAGE further bytes in the mean, and at MAX at last.
MIN, AVERAGE, MAX = 1024, 2048, 16384
#: Payloads are filled with bytes 255 to a positive multiple of this.
UNIT = 576
LEVEL = 9
#: The compression dictionary is trained on this many texts at most, of each this many bytes.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 1 << 16
DIGEST = 16

_GEAR = (mix64(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum of g[byte] << age over the last 32 bytes, modulo 2**32.

    All places at once, by doubling the window five times.
    """
    h = _GEAR[data]
    width = 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        width *= 2
    return h


def cuts(payload: np.ndarray, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> list[int]:
    """Ends of the chunks of a payload.  A cut depends on the bytes near it alone, so an edit moves few of them."""
    n = len(payload)
    mask = np.uint32(((1 << (average.bit_length() - 1)) - 1) << (32 - average.bit_length() + 1) & 0xFFFFFFFF)
    places = np.flatnonzero((gear(payload) & mask) == 0) + 1 if n > least else np.zeros(0, np.int64)
    out, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(places, at + least))
        end = int(places[i]) if i < len(places) else n
        at = min(end, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def chunked(payload: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(np.frombuffer(payload, np.uint8)):
        out.append(payload[at:end])
        at = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def manifest(n_bytes: int, sizes: list[int], digests: list[bytes]) -> bytes:
    """The stored form of one medium: a header and its ordered chunk list; the chunks themselves are in the store."""
    return b"CDC1" + struct.pack("<QI", n_bytes, len(sizes)) + b"".join(struct.pack("<I", n) + d for n, d in zip(sizes, digests, strict=True))


def parse(stored: bytes) -> tuple[int, list[int], list[bytes]]:
    n_bytes, n = struct.unpack_from("<QI", stored, 4)
    step = 4 + DIGEST
    entries = [stored[16 + i * step : 16 + (i + 1) * step] for i in range(n)]
    return n_bytes, [struct.unpack("<I", e[:4])[0] for e in entries], [e[4:] for e in entries]


def _key(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * DIGEST))


def chunk_lists(texts: DataFrame) -> DataFrame:
    """(key, stored) of (key, text): the manifest of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                stored = []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    held = chunked(payload_of(raw))
                    stored.append(manifest(len(raw), list(map(len, held)), [digest(c) for c in held]))
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "stored": pa.array(stored, pa.binary())})

    return texts.mapInArrow(run, "key binary, stored binary")


def chunk_refs(lists: DataFrame) -> DataFrame:
    """(key, pos, digest): the entries of manifests (key, stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, d) for k, s in zip(batch.column("key").to_pylist(), batch.column("stored").to_pylist(), strict=True) for i, d in enumerate(parse(s)[2])]
            kinds = {"key": pa.binary(), "pos": pa.int32(), "digest": pa.binary()}
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})

    return lists.mapInArrow(run, "key binary, pos int, digest binary")


def train_dictionary(docs: DataFrame) -> bytes:
    """A zstandard dictionary for the texts of docs, from a bounded sample; empty if there is too little text.

    It makes packs smaller.  As their bytes depend on it, the sample is the texts of least hashed keys of the whole
    table, in that order: the same for any order and partitioning of the rows.
    """
    head = F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES)
    long = docs.where(F.octet_length(F.col("text").cast("binary")) > 64).select(F.xxhash64("key").alias("h"), "key")
    drawn = long.distinct().orderBy("h", "key").limit(SAMPLE_TEXTS)  # each task keeps as many at most
    heads = docs.join(F.broadcast(drawn), "key").select("h", "key", head.alias("x")).distinct().orderBy("h", "key").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.x) for r in heads]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _squeezer(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _unsqueezer(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


@dataclass(frozen=True)
class Store:
    """A chunk store: its rows, and the dictionary that its packs are compressed with."""

    rows: DataFrame
    dictionary: bytes


def write_store(docs: DataFrame) -> Store:
    """Stores each distinct text of docs (key, text) once and returns the store, its rows read again from shared files.

    A row of the store is one medium: key, manifest, the positions of the chunks that it holds for all media (`own`),
    which of these others refer to (`shared`), the chunks it finds elsewhere (`foreign`), and the bytes of its own
    chunks as one compressed pack.  The first holder of a digest, by key and position, owns the chunk.

    Only digests are grouped and joined to find owners: a digest that a third of all media share meets as one partial
    count for each task.  The texts move once, compressed, to the owner flags of their key.
    """
    dictionary = train_dictionary(docs)
    lists = materialize(chunk_lists(docs), "chunk-lists").dropDuplicates(["key"])
    refs = chunk_refs(lists)
    owners = refs.groupBy("digest").agg(F.min(F.struct("key", "pos")).alias("owner"), F.count(F.lit(1)).alias("n"))
    held = owners.groupBy("owner.key").agg(
        F.collect_list(F.struct(F.col("owner.pos").alias("pos"), (F.col("n") > 1).alias("shared"))).alias("own")
    )
    wanted = F.transform(F.filter("own", lambda x: x["shared"]), lambda x: x["pos"])
    flags = lists.join(held, "key", "left").select(
        "key",
        "stored",
        F.coalesce(F.transform("own", lambda x: x["pos"]), F.array().cast("array<int>")).alias("own"),
        F.coalesce(wanted, F.array().cast("array<int>")).alias("shared"),
    )

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _squeezer(dictionary)
        for batch in batches:
            for part in text_chunks(batch):
                seen: dict[bytes, bytes] = {}
                for k, raw in zip(part.column("key").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if k not in seen:
                        seen[k] = tool.compress(raw)
                yield pa.RecordBatch.from_pydict({"key": pa.array(seen.keys(), pa.binary()), "packed": pa.array(seen.values(), pa.binary())})

    squeezed = docs.mapInArrow(squeeze, "key binary, packed binary").dropDuplicates(["key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, back = _squeezer(dictionary), _unsqueezer(dictionary)
        for batch in batches:
            foreign, packs = [], []
            columns = [batch.column(c).to_pylist() for c in ("packed", "stored", "own")]
            for packed, stored, own in zip(*columns, strict=True):
                payload = payload_of(back.decompress(packed))
                _, sizes, digests = parse(stored)
                ends = np.cumsum(sizes)
                mine = sorted(own)
                held = set(mine)
                packs.append(tool.compress(b"".join(payload[ends[p] - sizes[p] : ends[p]] for p in mine)))
                foreign.append([{"pos": i, "digest": d} for i, d in enumerate(digests) if i not in held])
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary())]))
            yield pa.RecordBatch.from_pydict(
                {"key": batch.column("key"), "stored": batch.column("stored"), "own": batch.column("own"), "shared": batch.column("shared"), "foreign": pa.array(foreign, kind), "pack": pa.array(packs, pa.binary())}
            )

    made = squeezed.join(flags, "key").mapInArrow(
        pack, "key binary, stored binary, own array<int>, shared array<int>, foreign array<struct<pos: int, digest: binary>>, pack binary"
    )
    return Store(materialize(made, "chunk-store"), dictionary)


def shared_chunks(store: Store) -> DataFrame:
    """(digest, data) of the stored chunks that several places refer to."""
    dictionary = store.dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _unsqueezer(dictionary)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("stored", "own", "shared", "pack")]
            digests, data = [], []
            for stored, own, shared, packed in zip(*columns, strict=True):
                _, sizes, names = parse(stored)
                raw, at, wanted = back.decompress(packed), 0, set(shared)
                for p in sorted(own):
                    if p in wanted:
                        digests.append(names[p])
                        data.append(raw[at : at + sizes[p]])
                    at += sizes[p]
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "data": pa.array(data, pa.binary())})

    return store.rows.where(F.size("shared") > 0).select("stored", "own", "shared", "pack").mapInArrow(run, "digest binary, data binary")


def read_media(store: Store) -> DataFrame:
    """(key, stored, pack, payload) of every medium, put together from its chunk list and verified chunk by chunk.

    Media whose chunks are all their own are read where they lie.  For the others the foreign chunks are joined by
    digest and gathered by key: what is gathered is part of one medium.  A chunk that differs from its digest, or is
    missing, raises an error.
    """
    dictionary = store.dictionary

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _unsqueezer(dictionary)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("stored", "own", "pack", "found")]
            payloads = []
            for stored, own, packed, found in zip(*columns, strict=True):
                _, sizes, names = parse(stored)
                raw, at = back.decompress(packed), 0
                parts: list[bytes | None] = [None] * len(sizes)
                for p in sorted(own):
                    parts[p] = raw[at : at + sizes[p]]
                    at += sizes[p]
                for f in found or ():
                    parts[f["pos"]] = f["data"]
                for p, d in zip(parts, names, strict=True):
                    if p is None or digest(p) != d:
                        raise ValueError("a chunk is missing or damaged")
                payloads.append(b"".join(parts))
            held = {k: batch.column(k) for k in ("key", "stored", "pack")}
            yield pa.RecordBatch.from_pydict({**held, "payload": pa.array(payloads, pa.binary())})

    schema = "key binary, stored binary, pack binary, payload binary"
    none = F.array().cast("array<struct<pos: int, data: binary>>")
    alone = store.rows.where(F.size("foreign") == 0).select("key", "stored", "own", "pack", none.alias("found"))
    others = store.rows.where(F.size("foreign") > 0)
    refs = others.select("key", F.explode("foreign").alias("f")).select("key", "f.pos", "f.digest")
    found = refs.join(shared_chunks(store), "digest").groupBy("key").agg(F.collect_list(F.struct("pos", "data")).alias("found"))
    joined = others.select("key", "stored", "own", "pack").join(found, "key")
    return alone.mapInArrow(assemble, schema).unionByName(joined.select("key", "stored", "own", "pack", "found").mapInArrow(assemble, schema))


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the texts of docs as media, reads them back, and returns a row of digests and features for each row.

    Equal texts share one medium.  A null text counts as empty, an empty text is one unit of filling; null ids stay
    null; repeated rows repeat; other columns are not read; an empty table gives no rows.  `media_bytes` and
    `media_sha256` are those of the bytes that are stored for the medium: its manifest and, behind it, the pack of the
    chunks that it owns.  The feature gives mean, deviation and entropy of the samples and the number of chunks.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(body).alias("key"), body.alias("text"))
    store = write_store(own.select("key", "text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stored, packed, payload in zip(*(batch.column(k).to_pylist() for k in ("stored", "pack", "payload")), strict=True):
                out["n_bytes"].append(parse(stored)[0])
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(stored) + len(packed))
                out["media_sha256"].append(hashlib.sha256(stored + packed).hexdigest())
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                p = counts / len(payload)
                mean = float((p * np.arange(256)).sum())
                spread = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
                entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
                out["feature"].append(f"mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};chunks={len(parse(stored)[1])}")
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}})

    schema = "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    measured = read_media(store).mapInArrow(measure, schema)
    return own.select("doc_id", "key").join(measured, "key").drop("key")
