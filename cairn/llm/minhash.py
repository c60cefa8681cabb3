"""Near-duplicate documents: b-bit MinHash signatures joined by Hamming distance with a multi-index.

A document's set holds its distinct shingles of `size` lower-cased words. Equal sets form one class, so that exact
copies cost one row from there on. Every class gets a signature of CHUNKS * WIDTH MinHash values of BITS bits. Two
signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 values agree, by pigeonhole, in some chunk up to ERRORS
values; each chunk therefore enumerates its allowed errors as keys with ERRORS values left out, and classes that share
a key meet. Classes joined by shared keys make candidate groups. Within these, every pair that shares a key, and no
other, is confirmed by the exact similarity of the whole sets, tile against tile, and the confirmed links give the
components; so which pairs count depends on the two texts alone. At similarity 0.85 a pair shares no key with a
probability of about 6e-6. A task holds two tiles of TILE shingles; it returns local spanning links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import worker
from cairn.llm.common import BROADCAST_ROWS, bounded_batches, components, cut, free_name, join_sized, tidy
from cairn.llm.shingles import U, mix, shingle_set

CHUNKS, WIDTH, ERRORS, BITS = 8, 6, 1, 16
#: Shingles a tile holds on average, and the tiles above which a candidate group is compared key by key, with equal results.
TILE, MOST_TILES = 200_000, 36


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of CHUNKS * WIDTH values of BITS bits for each set; sets must not be empty."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets)
    out = np.empty((len(sets), CHUNKS * WIDTH), dtype=np.uint16)
    for k, seed in enumerate(_seeds(CHUNKS * WIDTH)):
        out[:, k] = (mix(np.minimum.reduceat(flat * seed, starts)) >> U(64 - BITS)).astype(np.uint16)
    return out


def _features(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])

    def part(rows: list[tuple]) -> pa.RecordBatch:
        sets = [x for x in (r[1] for r in rows) if len(x)]
        sig = iter(signatures(sets)) if sets else iter(())
        cols = [[], [], [], [], []]
        for doc_id, s in rows:
            full = len(s) > 0
            both = (int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + U(0x632BE59BD9B4E019))))) if full else (0, 0)
            for c, v in zip(cols, (doc_id, len(s), *(x - (1 << 64) if x >> 63 else x for x in both), next(sig).tobytes() if full else None)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    def run(batches):
        worker.forget()
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set((text.as_py() or "").encode(), size)
                rows.append((doc_id, s))
                held += len(s)
                if held > 2_000_000:
                    yield part(rows)
                    rows, held = [], 0
            if rows:
                yield part(rows)

    return run


def _patterns() -> list[tuple[int, tuple[int, ...]]]:
    return [(c, left) for c in range(CHUNKS) for left in combinations(range(WIDTH), WIDTH - ERRORS)]


def _keys(batches):
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1).astype(np.uint64)
        out = np.empty((b.num_rows, len(_patterns())), dtype=np.uint64)
        for k, (chunk, left) in enumerate(_patterns()):
            h = np.full(b.num_rows, U(k + 1))
            for i in left:
                h = mix(h * U(0x9E3779B97F4A7C15) + sig[:, chunk * WIDTH + i])
            out[:, k] = h
        ids = np.repeat(b.column(0).to_numpy(), out.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "rep"])


def _sets(size: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                s = shingle_set((row["text"] or "").encode(), size)
                yield pa.RecordBatch.from_pylist([{"group_id": row["group_id"], "tiles": row["tiles"], "doc_id": row["doc_id"], "shingles": s.tobytes()}], schema=_SETS)

    return run


def _meet(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which signatures share a key with another one: those with at most ERRORS other values in some chunk."""
    return ((sig != other).reshape(len(sig), CHUNKS, WIDTH).sum(axis=2, dtype=np.uint8) <= ERRORS).any(axis=1)


_SETS = pa.schema([("group_id", pa.int64()), ("tiles", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.binary())])


def _confirm(percent: int):
    """Local spanning links between the two tiles of a group (a tile with itself if both are the same)."""

    def run(table: pa.Table) -> pa.Table:
        tile_i, tile_j = table.column("tile_i")[0].as_py(), table.column("tile_j")[0].as_py()
        ids, tile = table.column("doc_id").to_numpy(), table.column("tile").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        sig = signatures(sets)
        starts = np.concatenate([[0], np.cumsum(n)])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(flat.max() + 1, dtype=bool)
        root = np.arange(len(ids))
        found = []
        second = np.flatnonzero(tile == tile_j)
        for i in np.flatnonzero(tile == tile_i):
            rest = second[second > i] if tile_i == tile_j else second
            rest = rest[(root[rest] != root[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            rest = rest[_meet(sig[rest], sig[i])] if len(rest) else rest
            if not len(rest):
                continue
            own = flat[starts[i] : starts[i + 1]]
            flag[own] = True
            at = np.concatenate([[0], np.cumsum(n[rest])[:-1]])
            picked = np.repeat(starts[rest] - at, n[rest]) + np.arange(n[rest].sum())
            inter = np.add.reduceat(flag[flat[picked]].astype(np.int64), at)
            flag[own] = False
            for j in rest[100 * inter >= percent * (n[rest] + n[i] - inter)]:
                if root[i] != root[j]:
                    found.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, tile: int = TILE) -> DataFrame:
    """Links documents with 100 * intersection >= percent * union of their shingle sets.

    Takes doc_id and text; other columns are not read. Returns a row per input row: doc_id, n_shingles,
    component_id (smallest doc_id reachable by links, itself included), kept (doc_id = component_id).
    A null, empty or blank text has no shingles and links with nothing; a text shorter than `size` words is one
    shingle; A-Z count as a-z. Rows that share a doc_id are one document. A null doc_id links with nothing: its
    component_id is null and it is kept. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = tidy(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    feats = cut(docs.mapInArrow(_features(size), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"))
    usable = feats.where("doc_id is not null and n_shingles > 0")
    sets = cut(usable.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("copies")))
    keyed = sets.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    groups = components(keyed.join(shared, "key").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")))
    members = _units(groups, sets, keyed, shared, tile)
    full = _with_texts(docs, members).mapInArrow(_sets(size), "group_id long, tiles long, doc_id long, shingles binary")
    full = full.withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "group_id", F.least("tile", "other").alias("tile_i"), F.greatest("tile", "other").alias("tile_j"), "tile", "doc_id", "shingles"
    )
    links = dealt.groupBy("group_id", "tile_i", "tile_j").applyInArrow(_confirm(percent), "a long, b long")
    parts = cut(components(links))
    return _result(feats, sets, parts)


def _units(groups: DataFrame, sets: DataFrame, keyed: DataFrame, shared: DataFrame, tile: int) -> DataFrame:
    """What is compared with what: rep, group_id, tiles.

    A unit is a candidate group. A group of more than MOST_TILES tiles, which chance meetings can chain together, is
    taken apart into its keys' members instead, so that a member is dealt at most once a key. Either way exactly the
    pairs that share a key are compared.
    """
    found = cut(groups.join(sets.select("rep", "n_shingles"), groups["node"] == F.col("rep")).select("rep", F.col("component_id").alias("group_id"), "n_shingles"))
    count = F.ceil(F.sum("n_shingles") / F.lit(tile)).alias("tiles")
    members = cut(found.join(found.groupBy("group_id").agg(count), "group_id").select("rep", "group_id", "tiles", "n_shingles"))
    large = members.where(F.col("tiles") > MOST_TILES)
    if large.isEmpty():
        return members.drop("n_shingles")
    met = cut(keyed.join(shared.select("key"), "key").join(large.select("rep", "n_shingles"), "rep"))
    by_key = met.join(met.groupBy("key").agg(count), "key").select("rep", F.col("key").alias("group_id"), "tiles")
    return cut(members.where(F.col("tiles") <= MOST_TILES).select("rep", "group_id", "tiles").union(by_key))


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Texts of the members of candidate groups; only as many rows as members leave the scan if these may be broadcast."""
    small = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    return docs.join(small, docs["doc_id"] == members["rep"]).select("group_id", "tiles", "doc_id", "text")


def _result(feats: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    copies = sets.where("copies > 1").select(F.struct("n_shingles", "h1", "h2").alias("same"), F.col("rep").alias("first"))
    own = feats.select("doc_id", "n_shingles", F.struct("n_shingles", "h1", "h2").alias("same"))
    own = join_sized(own, copies, "same", salt="doc_id").withColumn("rep", F.coalesce("first", "doc_id"))
    parts = parts.select(F.col("node").alias("rep"), "component_id")
    out = join_sized(own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), parts, "rep", salt="doc_id")
    out = out.withColumn("component_id", F.coalesce("component_id", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, percent: int = 85, size: int = 5) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: the one with the smallest doc_id.

    Of rows that share a doc_id one stays, unless doc_id is null.
    """
    key = free_name(docs, "__id")
    dropped = near_duplicates(docs, percent, size).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    out = docs.join(_side(dropped), F.col("doc_id") == F.col(key), "left_anti")
    repeated = cut(repeated)
    if repeated.isEmpty():
        return out
    same = F.col("doc_id") == F.col(key)
    one = out.join(_side(repeated), same, "left_semi").dropDuplicates(["doc_id"])
    return out.join(_side(repeated), same, "left_anti").unionByName(one)


def _side(ids: DataFrame) -> DataFrame:
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
