"""N-gram Jaccard self-join: candidates by MinHash bands, Bayesian pruning, exact checks, classes of near copies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, groups_of, materialize, mix64, shingle_hashes, text_chunks

#: Five words, a similarity of 0.8 or more.
SIZE, THRESHOLD = 5, 0.8
#: A candidate shares one of BANDS bands of ROWS values; at similarity 0.8 a pair shares none once in 300,000 times.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: A pair is dropped when the chance that it reaches the threshold is below this, looked at after every STEP values.
TOLERANCE, STEP = 1e-5, 16
#: Groups are cut by a hash of the member into tiles, and pairs of tiles are separate work: one tile for each SMALL
#: members up to SPREAD tiles, so that a group is spread, and one for each TILE where these are more, as a member moves
#: once for every tile of its group.
SMALL, SPREAD, TILE = 256, 16, 4096
#: Shingles of the texts of one tile at most, in the mean.
TILE_SHINGLES = 1_000_000

_MULTIPLY = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def minhash(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The signature of each set: HASHES minima of 32-bit values.  A set without members has the largest value."""
    rows = len(offsets) - 1
    out = np.full((rows, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        at = offsets[:-1][full]
        step = 1 << 18
        bounds = [0]
        while bounds[-1] < len(full):  # sets of about `step` members at a time, which the cache holds
            bounds.append(max(bounds[-1] + 1, int(np.searchsorted(offsets[1:][full], at[bounds[-1]] + step, side="right"))))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = hashes[at[a] : offsets[1:][full][b - 1]]
            places = at[a:b] - at[a]
            for k in range(HASHES):
                value = ((own * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32)
                out[full[a:b], k] = np.minimum.reduceat(value, places)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix64(out * np.uint64(0xFF51AFD7ED558CCD) + signatures[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.uint64(r + 1))
    return mix64(out + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After each STEP values: the fewest matches with which a pair stays.

    Under a uniform prior the similarity given m matches of n values is Beta(m+1, n-m+1).  A pair is dropped if this
    puts less than `tolerance` at or above the threshold.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    above = grid >= threshold
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[above].sum() >= tolerance * p.sum():
                out.append(m)
                break
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of `many` stay candidates of the signature `one`, compared STEP values at a time."""
    alive = np.arange(len(many))
    matches = np.zeros(len(many), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (many[alive, part] == one[part]).sum(1)
        stays = matches >= least
        alive, matches = alive[stays], matches[stays]
        if not len(alive):
            break
    return alive


def identified(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, row_key, text_key) for each row of df: together the keys tell rows apart that differ.

    Ids may be null or stand for several texts.  `row_key` orders as the id does; null ids come after all others.
    """
    row_key, text_key = _keys(doc_id, text)
    return df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row_key.alias("row_key"), text_key.alias("text_key")
    )


def _keys(doc_id: str, text: str) -> tuple[Column, Column]:
    text_key = F.xxhash64(F.col(text).cast("string"))
    late = F.lit(1 << 62).bitwiseOR(text_key.bitwiseAND(F.lit((1 << 62) - 1)))
    return F.coalesce(F.col(doc_id).cast("long"), late), text_key


def signatures(df: DataFrame) -> DataFrame:
    """(doc_id, row_key, text_key, set_id, n, signature) for each row of df, as `identified` gives them.

    `set_id` is a digest of the set of shingles, so that texts with the same set are one; it is null for no words.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, limit=1 << 21):
                hashes, offsets = shingle_hashes(part.column("text"), SIZE)
                made = minhash(hashes, offsets)
                ids, sizes = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.unique(hashes[a:b])
                    ids.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sizes.append(len(own))
                yield pa.RecordBatch.from_pydict(
                    {
                        **{k: part.column(k) for k in ("doc_id", "row_key", "text_key")},
                        "set_id": pa.array(ids, pa.binary()),
                        "n": pa.array(sizes, pa.int64()),
                        "signature": pa.array([s.tobytes() for s in made], pa.binary()),
                    }
                )

    return df.mapInArrow(run, "doc_id long, row_key long, text_key long, set_id binary, n long, signature binary")


def _tiles(members: DataFrame, group: list[str], cost: str | None = None) -> DataFrame:
    """The members of groups of two or more with `tiles`, the number of tiles of the group, and `tile`, a hash of the member."""
    n = F.count(F.lit(1))
    amount = F.greatest(n / TILE, F.least(n / SMALL, F.lit(SPREAD).cast("double")))
    if cost is not None:
        amount = F.greatest(amount, F.sum(cost) / TILE_SHINGLES)
    sizes = members.groupBy(*group).agg(F.ceil(amount).cast("int").alias("tiles"), n.alias("members")).where(F.col("members") > 1)
    known = materialize(sizes.drop("members"), "tiles")
    own = members.join(known.hint("merge"), group)  # their number grows with the input: one plan at every size
    return own.withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))


def _tile_pairs(tiled: DataFrame, once: Column | None = None) -> DataFrame:
    """Each member once for every pair of tiles, tile_a <= tile_b, that its own is part of; a group of one tile has (0, 0).

    A row where `once` is true is in the pairs that its tile is the lower of only.
    """
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    if once is not None:
        others = F.filter(others, lambda other: ~once | (other >= F.col("tile")))
    pairs = F.transform(others, lambda other: F.struct(F.least(other, F.col("tile")).alias("a"), F.greatest(other, F.col("tile")).alias("b")))
    columns = [c for c in tiled.columns if c != "tiles"]
    return tiled.select(*columns, F.explode(pairs).alias("p")).select(*columns, F.col("p.a").alias("tile_a"), F.col("p.b").alias("tile_b"))


def _forest(n: int, links: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links (one, many), at most n - 1 pairs."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    out = []
    for i, many in links:
        for j in many.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _pairs(tile: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) members of a tile pair; in a pair of a tile with itself both are all, and only later ones count."""
    return np.flatnonzero(tile == a), np.flatnonzero(tile == b)


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b) spanning edges of the candidate graph of sets (set_id, n, signature).

    Sets that share a band are compared value by value, tile pair by tile pair; of the pairs that stay only a
    spanning forest leaves the task, so a bucket of n sets gives less than n edges for each of its tile pairs.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            made = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, HASHES)
            keys = band_keys(made).view(np.int64)
            at = np.repeat(np.arange(n), BANDS)
            yield pa.RecordBatch.from_pydict({"band": pa.array(keys.ravel()), "set_id": batch.column("set_id").take(pa.array(at))})

    buckets = sets.select("set_id", "signature").mapInArrow(bands, "band long, set_id binary")
    tiled = _tile_pairs(_tiles(buckets, ["band"])).join(sets.select("set_id", "signature"), "set_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: tuple[list, list] = ([], [])
        for group in groups_of(batches, ["band", "tile_a", "tile_b"]):
            ids = group.column("set_id").to_pylist()
            made = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(ids), HASHES)
            a, b = group.column("tile_a")[0].as_py(), group.column("tile_b")[0].as_py()
            left, right = _pairs(group.column("tile").to_numpy(), a, b)

            def links() -> Iterator[tuple[int, np.ndarray]]:
                for k, i in enumerate(left):
                    others = right[k + 1 :] if a == b else right
                    yield int(i), others[survivors(made[i], made[others])]

            for i, j in _forest(len(ids), links()):
                done[0].append(ids[i])
                done[1].append(ids[j])
            if len(done[0]) > 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(done[0], pa.binary()), "b": pa.array(done[1], pa.binary())})
                done = ([], [])
        yield pa.RecordBatch.from_pydict({"a": pa.array(done[0], pa.binary()), "b": pa.array(done[1], pa.binary())})

    keys = ["band", "tile_a", "tile_b"]
    return tiled.repartition(*keys).sortWithinPartitions(*keys, "set_id").mapInArrow(compare, "a binary, b binary").dropDuplicates()


def components(edges: DataFrame) -> DataFrame:
    """(set_id, root): the least id of each connected component, for every id that has an edge.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stay the same, which takes a
    number of rounds logarithmic in the longest chain; the steps keep the number of edges, and hot nodes are only ever
    grouped to their least neighbour, by partial minima.  What is known of a node is written before its edges are
    joined to it: Spark splits a hot partition only where both sides of a join are shuffled for it, and not where one
    is an aggregate on the same key.  Tables of past rounds are deleted.
    """
    now = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).dropDuplicates(), "edges")
    seen = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where(F.col("a") != F.col("b")).dropDuplicates(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).dropDuplicates(), "edges")
        for past in (now, least, large, low):
            discard(past)
        now = after
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if seen == mark:
            break
        seen = mark
    stars = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "set_id")
    return stars.unionByName(stars.select(F.col("root").alias("set_id"), "root").dropDuplicates())


MEMBER = "root binary, tile int, tiles int, base boolean, set_id binary, n long, copies long, signature binary, relative boolean, shingles binary"


def shingle_sets(bodies: DataFrame) -> DataFrame:
    """Members of components (root, set_id, n, copies, signature, text) with their shingles in place of their texts.

    A component is cut into tiles.  The set of its root is the base, which each tile gets as a row of its own; of a
    member that differs from it in fewer shingles than it has, these are kept (`relative`), of others all.  So a text
    moves once, and what moves once for every pair of tiles is what sets near copies apart.
    """
    tiled = _tiles(bodies, ["root"], "n")
    own = F.array(F.struct(F.col("tile").alias("tile"), F.lit(False).alias("base")))
    bases = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(t.alias("tile"), F.lit(True).alias("base")))
    places = F.when(F.col("set_id") == F.col("root"), F.concat(own, bases)).otherwise(own)
    kept = ["root", "tiles", "set_id", "n", "copies", "signature", "text"]
    dealt = tiled.select(*kept, F.explode(places).alias("p")).select(*kept, F.col("p.tile").alias("tile"), F.col("p.base").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["root", "tile"]):
            base = None
            for batch in group.to_batches():  # the base is the first row
                for part in text_chunks(batch):
                    hashes, offsets = shingle_hashes(part.column("text"), SIZE)
                    relative, sets = [], []
                    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                        own = np.unique(hashes[a:b])
                        if base is None:
                            base = own
                        apart = np.setxor1d(own, base, assume_unique=True)
                        relative.append(len(apart) < len(own) and not part.column("base")[i].as_py())
                        sets.append((apart if relative[-1] else own).tobytes())
                    columns = {k: part.column(k) for k in ("root", "tile", "tiles", "base", "set_id", "n", "copies", "signature")}
                    yield pa.RecordBatch.from_pydict({**columns, "relative": pa.array(relative, pa.bool_()), "shingles": pa.array(sets, pa.binary())})

    order = [F.col("root"), F.col("tile"), F.col("base").desc(), F.col("set_id")]
    return dealt.repartition("root", "tile").sortWithinPartitions(*order).mapInArrow(run, MEMBER)


def verified(docs: DataFrame, firsts: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, links): spanning edges (a, b) of the pairs at the threshold or above, and links (set_id, n_links) in documents.

    `firsts` names the row (row_key, text_key) that stands for a set and how many have it, `grouped` the candidate
    component of a set; `docs` is as `identified` gives it.
    The texts of candidates alone move, once; their pairs are pruned again by signature and the rest compared as exact
    sets.  With the base set R of a component, and d(A) for the shingles in one of A and R only, the shingles that A
    and B have in common are |R| - |d(A) & R| - |d(B) & R| + |d(A) & d(B)|.
    """
    picked = grouped.join(firsts, "set_id").select("set_id", "root", "n", "copies", "signature", "first.row_key", "first.text_key")
    bodies = docs.join(picked, ["row_key", "text_key"]).dropDuplicates(["set_id"])
    members = shingle_sets(bodies.select("root", "set_id", "n", "copies", "signature", "text"))
    tiled = _tile_pairs(members, F.col("base"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["root", "tile_a", "tile_b"]):
            a, b = group.column("tile_a")[0].as_py(), group.column("tile_b")[0].as_py()
            base = np.frombuffer(group.column("shingles")[0].as_py(), np.uint64)
            group = group.slice(1)  # the base is the first row
            ids = group.column("set_id").to_pylist()
            if len(ids) < 2:
                continue
            made = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(ids), HASHES)
            copies, n = group.column("copies").to_numpy(), group.column("n").to_numpy()
            left, right = _pairs(group.column("tile").to_numpy(), a, b)
            held = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            apart = [x if r else np.setxor1d(x, base, assume_unique=True) for x, r in zip(held, group.column("relative").to_pylist(), strict=True)]
            sizes = np.array(list(map(len, apart)))
            at = np.concatenate([[0], np.cumsum(sizes)])
            names, flat = np.unique(np.concatenate(apart), return_inverse=True)
            inside = np.concatenate([[0], np.cumsum(np.isin(names, base, assume_unique=True)[flat])])
            lost = inside[at[1:]] - inside[at[:-1]]
            mark = np.zeros(len(names), np.int32)
            found = np.zeros(len(ids), np.int64)

            def links() -> Iterator[tuple[int, np.ndarray]]:
                for k, i in enumerate(left):
                    others = right[k + 1 :] if a == b else right
                    others = others[survivors(made[i], made[others])]
                    if not len(others):
                        continue
                    mark[flat[at[i] : at[i + 1]]] = 1
                    owner = np.repeat(np.arange(len(others)), sizes[others])
                    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[others]) - sizes[others], sizes[others])
                    both = np.bincount(owner, mark[flat[at[others][owner] + inner]], len(others))
                    mark[flat[at[i] : at[i + 1]]] = 0
                    common = len(base) - lost[i] - lost[others] + both
                    near = others[common >= THRESHOLD * (n[i] + n[others] - common) - 1e-9]
                    found[i] += copies[near].sum()
                    found[near] += copies[i]
                    yield int(i), near

            edges = _forest(len(ids), links())
            rows = [(ids[i], ids[j], 0) for i, j in edges] + [(ids[i], None, int(c)) for i, c in enumerate(found) if c]
            if rows:
                x, y, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary()), "n_links": pa.array(c, pa.int64())})

    keys = ["root", "tile_a", "tile_b"]
    order = [*keys, F.col("base").desc(), "set_id"]
    done = materialize(tiled.repartition(*keys).sortWithinPartitions(*order).mapInArrow(compare, "a binary, b binary, n_links long"), "verified")
    edges = done.where(F.col("b").isNotNull()).select("a", "b")
    return edges, done.where(F.col("b").isNull()).groupBy(F.col("a").alias("set_id")).agg(F.sum("n_links").alias("n_links"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, text_key, class, n_links, n_copies) for each row of df.

    `class` is the least (row_key, text_key, doc_id) among the rows that chains of links join to it, itself included.
    """
    own = identified(df, doc_id, text)
    made = materialize(signatures(own), "signatures")
    sets = (
        made.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(
            F.min(F.struct("row_key", "text_key", "doc_id")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.min("n").alias("n"),
            F.min("signature").alias("signature"),
        )
    )
    sets = materialize(sets, "sets")
    edges = materialize(candidate_edges(sets), "candidates")
    linked, links = verified(own, sets, components(edges))
    roots = components(linked)
    named = sets.join(roots, "set_id", "left").select("set_id", "first", "copies", F.coalesce("root", "set_id").alias("root"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("first").alias("class")), "classes")
    facts = named.join(least, "root").join(links, "set_id", "left").select("set_id", "class", "copies", F.coalesce("n_links", F.lit(0)).alias("others"))
    rows = made.select("doc_id", "row_key", "text_key", "set_id")
    return rows.join(materialize(facts, "facts"), "set_id", "left").select(
        "doc_id",
        "row_key",
        "text_key",
        F.when(F.col("set_id").isNull(), F.struct("row_key", "text_key", "doc_id")).otherwise(F.col("class")).alias("class"),
        F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each row of df.

    The class of a document is the least id among those that chains of links join to it; `n_links` counts the rows
    whose text has a similarity of 0.8 or more with its own, copies included, `n_copies` those with the same set.
    Words are lower-cased runs of letters and digits; a text with fewer than five is one shingle.  A text without
    words, or null, links to nothing and is its own class.  Rows with a null id link as others do; their class is
    null if no row of it has an id.  An id may have several texts.  Repeated rows are copies of each other; an empty
    table gives no rows.
    """
    return classes(df, doc_id, text).select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links", "n_copies")


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, with all its columns, but one of each class: that with the least id, and of repeated rows one.

    A row with a null id stays if it is the first of its class, in which no row then has an id.  Texts move once, to
    the keys of their row, where repeated rows become one; rows that are gone are met there.
    """
    found = classes(df, doc_id, text)
    first = (F.col("row_key") == F.col("class.row_key")) & (F.col("text_key") == F.col("class.text_key"))
    keys = ["__row_key", "__text_key"]
    gone = found.where(~first).select(F.col("row_key").alias(keys[0]), F.col("text_key").alias(keys[1]))
    own = df.withColumns(dict(zip(keys, _keys(doc_id, text), strict=True))).dropDuplicates(keys)
    return own.join(gone.hint("merge"), keys, "left_anti").drop(*keys)
