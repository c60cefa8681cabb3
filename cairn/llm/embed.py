"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are compared by cosine, in double precision. A fixed random rotation spreads a vector's squared length evenly;
the rotated unit vector is cut into BLOCKS blocks. If cosine >= t, the squared distance is at most 2 * (1 - t), so in
some block it is at most that block's share of dimensions of it. Every block is range-joined under its budget: cells
from quantiles of a bounded sample split the block's coordinates, a vector goes to each pair (own cell, other cell)
whose other cell lies within the budget's radius, and a task compares the two sides of a cell pair block by block in
numpy. The union of the blocks' candidates is verified by the exact cosine. A link is counted in the first block whose
budget it keeps, so that no pair is written down to remove repeats: a task returns sums of links and local spanning
edges. Cells of more than two tiles' vectors are dealt into tiles, and tile pairs to tasks. A tile is as many vectors
as TILE_BYTES holds in double precision: the larger a tile, the fewer copies of a vector travel.

Exact copies are one row with a count. Every vector is indexed; the sample only places cell borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import components, cut, join_sized

THRESHOLD, BLOCKS = 0.9, 8
#: Bytes of double-precision vectors that a cell holds on average, and how many vectors' coordinates place the cells' borders.
TILE_BYTES, SAMPLE = 32 << 20, 4096
#: Bytes of vectors that may be broadcast.
_BROADCAST_BYTES = 16 << 20
_ROWS, _SLACK = 256, 1e-6


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240607).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Grid:
    """Blocks of a dimension, their squared-distance budgets and the borders of their cells."""

    def __init__(self, dim: int, threshold: float, blocks: int):
        self.dim, self.turn = dim, rotation(dim)
        self.parts = [p for p in np.array_split(np.arange(dim), min(blocks, dim))]
        self.budget = [2 * (1 - threshold) * len(p) / dim for p in self.parts]
        self.borders: list[list[np.ndarray]] = [[np.empty(0) for _ in p] for p in self.parts]

    def place(self, sample: np.ndarray, cells: int) -> None:
        """Borders that make at least `cells` cells a block of about equal numbers of the sample's vectors."""
        if not len(sample):
            return
        x = self.rotated(sample)
        for p, borders in zip(self.parts, self.borders):
            counts = [1] * len(p)
            while np.prod(counts) < cells:
                counts[counts.index(min(counts))] += 1
            for k, n in enumerate(counts):
                borders[k] = np.quantile(x[:, p[k]], np.arange(1, n) / n)

    def cells(self) -> int:
        """Cells of the block that has most."""
        return max(int(np.prod([len(x) + 1 for x in borders])) for borders in self.borders)

    def rotated(self, v: np.ndarray) -> np.ndarray:
        """Unit vectors, rotated."""
        return unit(v) @ self.turn

    def reach(self, x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each rotated vector in a block, and which cells lie within its budget's radius."""
        own, gap = np.zeros(len(x), dtype=np.int64), np.zeros((len(x), 1))
        for k, borders in zip(self.parts[b], self.borders[b]):
            if not len(borders):
                continue
            v, n = x[:, k], len(borders) + 1
            low, high = np.concatenate([[-np.inf], borders]), np.concatenate([borders, [np.inf]])
            d = np.maximum(np.maximum(low[None] - v[:, None], v[:, None] - high[None]), 0) ** 2
            own = own * n + np.searchsorted(borders, v, side="right")
            gap = (gap[:, :, None] + d[:, None, :]).reshape(len(x), -1)
        return own, gap <= self.budget[b] + _SLACK


def unit(v: np.ndarray) -> np.ndarray:
    """v with rows of length 1; scaled first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _raw(wide: bool):
    kind = "<f8" if wide else "<f4"

    def run(batches):
        for b in batches:
            v = b.column(1)
            ends = np.cumsum([len(x) for x in v]) if b.num_rows else np.empty(0, dtype=int)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            step = int(kind[-1])
            cut = [flat[s * step : e * step] for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist() if len(ends) else [], ends.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.binary())], names=["vec_id", "raw"])

    return run


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)


_CELLS = pa.schema([("block", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("high", pa.bool_()), ("rep", pa.int64()), ("copies", pa.int64()), ("raw", pa.binary())])


def _deal(grid: Grid, kind: str):
    """A row for each block and reachable pair of cells (lo <= hi); high says that the vector's own cell is hi."""

    def run(batches):
        most = max(1, min(2048, 4_000_000 // grid.cells()))  # distances to all cells of a block are held at once
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                some = batch.slice(i, most)
                x = grid.rotated(_matrix(some.column("raw").to_pylist(), kind))
                for b in range(len(grid.parts)):
                    own, near = grid.reach(x, b)
                    row, cell = np.nonzero(near)
                    mine = own[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), b, dtype=np.int32)), pa.array(np.minimum(mine, cell)), pa.array(np.maximum(mine, cell)), pa.array(mine > cell), *(some.column(c).take(pa.array(row)) for c in ("rep", "copies", "raw"))],
                        schema=_CELLS,
                    )

    return run


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j, whole arrays at once; roots point to themselves."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _compare(grid: Grid, kind: str, threshold: float):
    """Links between the sides of a cell pair that count in its block: (rep, null, links) and spanning (rep, other, null)."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        one = table.column("lo")[0].as_py() == table.column("hi")[0].as_py() and table.column("tile_lo")[0].as_py() == table.column("tile_hi")[0].as_py()
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        u = unit(_matrix(table.column("raw").to_pylist(), kind))
        x = u @ grid.turn
        second = table.column("second").to_numpy(zero_copy_only=False)
        left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        # one product gives squared distances: (-2x, |x|^2, 1) . (y, 1, |y|^2)
        part = x[:, grid.parts[block]].astype(np.float32)
        square, ones = (part * part).sum(axis=1, keepdims=True), np.ones((len(part), 1), dtype=np.float32)
        probe, build = np.concatenate([-2 * part, square, ones], axis=1), np.concatenate([part, ones, square], axis=1)
        budget = np.float32(grid.budget[block] + 1e-4)
        probe, build = probe[left], np.ascontiguousarray(build[right].T)
        space, flags = np.empty(_ROWS * len(right), dtype=np.float32), np.empty(_ROWS * len(right), dtype=bool)
        for start in range(0, len(left), _ROWS):
            rows = left[start : start + _ROWS]
            cols = right[start:] if one else right
            if not len(cols):
                break
            shape = (len(rows), len(cols))
            d2 = np.matmul(probe[start : start + _ROWS], build[:, start:] if one else build, out=space[: shape[0] * shape[1]].reshape(shape))
            near = np.less_equal(d2, budget, out=flags[: shape[0] * shape[1]].reshape(shape))
            if one:
                near[:, : len(rows)] &= np.triu(np.ones((len(rows),) * 2, dtype=bool), 1)
            i, j = np.divmod(np.flatnonzero(near), len(cols))
            if 50 * len(i) > near.size:  # many: whole products are faster than picking rows
                near &= u[rows] @ u[cols].T >= threshold - _SLACK  # the sum below decides, as it does for few
                i, j = np.nonzero(near)
            for at in range(0, len(i), 100_000):
                a, b = rows[i[at : at + 100_000]], cols[j[at : at + 100_000]]
                linked = (u[a] * u[b]).sum(axis=1) >= threshold
                a, b = a[linked], b[linked]
                if not len(a):
                    continue
                first = np.stack([((x[a][:, p] - x[b][:, p]) ** 2).sum(axis=1) <= s + _SLACK / 2 for p, s in zip(grid.parts, grid.budget)]).argmax(axis=0)
                a, b = a[first == block], b[first == block]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                _union(parent, a, b)
        some, moved = links > 0, parent != np.arange(len(ids))
        n, m = int(some.sum()), int(moved.sum())
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], ids[moved]]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(n, dtype=np.int64), ids[parent[moved]]]), pa.int64(), mask=np.arange(n + m) < n),
            "links": pa.array(np.concatenate([links[some], np.zeros(m, dtype=np.int64)]), pa.int64(), mask=np.arange(n + m) >= n),
        })

    return run


def _linked(sets: DataFrame, dim: int, kind: str, threshold: float, blocks: int, tile: int) -> DataFrame:
    """Sums of links and spanning edges among the distinct vectors of one dimension."""
    grid, n = Grid(dim, threshold, blocks), sets.count()
    share = min(1.0, SAMPLE / max(1, n))
    # distinct vectors, so that a hash of the bytes draws about SAMPLE of them at any size
    draw = F.shiftrightunsigned(F.xxhash64("raw"), 1) < int(share * (1 << 63)) if share < 1 else F.lit(True)
    sample = sets.where(draw).select("raw").collect()
    grid.place(_matrix([bytes(r["raw"]) for r in sample], kind).reshape(len(sample), dim), -(-n // tile))
    dealt = sets.select("rep", "copies", "raw").mapInArrow(_deal(grid, kind), "block int, lo long, hi long, high boolean, rep long, copies long, raw binary")
    own = F.when(F.col("high"), F.col("hi")).otherwise(F.col("lo"))
    other = F.when(F.col("high"), F.col("lo")).otherwise(F.col("hi"))
    full = dealt.where("lo = hi").groupBy("block", F.col("lo").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * tile)
    full = cut(full.select(F.struct("block", "cell").alias("at"), F.ceil(F.col("n") / tile).alias("tiles")))
    dealt = dealt.withColumn("own", F.struct("block", own.alias("cell"))).withColumn("other", F.struct("block", other.alias("cell")))
    dealt = join_sized(dealt, full.select(F.col("at").alias("own"), F.col("tiles").alias("own_tiles")), "own")
    dealt = join_sized(dealt, full.select(F.col("at").alias("other"), F.col("tiles").alias("other_tiles")), "other")
    mine = F.pmod(F.xxhash64("rep"), F.coalesce("own_tiles", F.lit(1)))
    dealt = dealt.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("other_tiles", F.lit(1)) - 1)))
    # in one cell the smaller tile comes first; between cells the lower cell does
    same = F.col("lo") == F.col("hi")
    second = F.when(same, F.col("mine") > F.col("theirs")).otherwise(F.col("high"))
    dealt = dealt.withColumn("second", second).withColumn("tile_lo", F.when(second, F.col("theirs")).otherwise(F.col("mine"))).withColumn("tile_hi", F.when(second, F.col("mine")).otherwise(F.col("theirs")))
    dealt = dealt.select("block", "lo", "hi", "tile_lo", "tile_hi", "second", "rep", "copies", "raw")
    return dealt.groupBy("block", "lo", "hi", "tile_lo", "tile_hi").applyInArrow(_compare(grid, kind, threshold), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, tile: int | None = None) -> DataFrame:
    """Links vectors with cosine >= threshold. tile: vectors a cell holds on average, if not what TILE_BYTES holds.

    Takes vec_id and embedding (array of float or double); other columns, labels too, are not read. Returns a row per
    input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links, itself
    included), kept (vec_id = component_id). A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, as does one of another dimension or with a null vec_id (its component_id is null; it is kept).
    Repeated rows link with each other. An empty table gives no rows.
    """
    wide = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind = "<f8" if wide else "<f4"
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    own = rows.where(F.coalesce(sound, F.lit(False))).mapInArrow(_raw(wide), "vec_id long, raw binary")
    sets = cut(own.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", (F.length("raw") / int(kind[-1])).cast("int")))
    found = None
    for (dim,) in sets.select("dim").distinct().collect():  # a handful of dimensions
        part = cut(_linked(sets.where(F.col("dim") == dim), dim, kind, threshold, blocks, tile or max(1, TILE_BYTES // (8 * dim))))
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = components(found.where("b is not null").select("a", "b"))
    sums = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    state = sets.join(sums, sets["rep"] == sums["a"], "left").join(parts, sets["rep"] == parts["node"], "left")
    state = state.select("rep", "raw", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # only what isn't a vector alone needs to be joined back
    state = cut(state.where("n_links > 0"))
    bytes_of = rows.mapInArrow(_all_raw(wide), "vec_id long, raw binary")
    widest = sets.agg(F.max(F.length("raw"))).first()[0] + 32
    out = join_sized(bytes_of, state.drop("rep"), "raw", limit=_BROADCAST_BYTES // widest, salt="vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _all_raw(wide: bool):
    """vec_id and the bytes of its vector, null where it links with nothing."""
    kind = "<f8" if wide else "<f4"

    def run(batches):
        for b in batches:
            out = []
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = None if vec_id is None or v.as_py() is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "raw"])

    return run
