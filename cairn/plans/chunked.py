"""K-means in chunks: chunk-local clusters, groups of them, a representative sample, final centers.

Chunks are row ranges of `size` points, a task's memory by definition, and are clustered by a grouped map; the points
are shuffled once, by chunk. The driver holds the k * chunks centroids that greedy grouping needs in order. Rows beyond
the last whole chunk take no part in chunks and groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.lineage import cut
from cairn.operators import assign as A
from cairn.operators import grouping, kernel, sampling
from cairn.sources.points import chunked

_CHUNK = pa.schema([
    ("chunk_id", pa.int64()), ("cluster_id", pa.int32()), ("center", pa.list_(pa.float64())), ("n", pa.int64()), ("sse", pa.float64()), ("iterations", pa.int32()), ("init_row", pa.int64()),
    ("rows", pa.list_(pa.int64())),
])
_CHUNK_DDL = "chunk_id long, cluster_id int, center array<double>, n long, sse double, iterations int, init_row long, rows array<long>"
_ROWS = 100_000


def _cluster(k: int, first: int | None, passes: int):
    """A row a cluster; the rows of its members follow in lists of bounded length."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("row_id").to_numpy(), kind="stable")
        rows = table.column("row_id").to_numpy()[order]
        features = table.column("features").combine_chunks()
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[order]
        chunk = table.column("chunk_id")[0].as_py()
        start = kernel.farthest_first(x, k, chunk + 1 if first is None else first)
        centers, cluster, done = kernel.lloyd(x, x[start], passes)
        sse, out = kernel.energies(x, centers, cluster), []
        for j in range(k):
            own = rows[cluster == j]
            head = {"chunk_id": chunk, "cluster_id": j, "center": centers[j].tolist(), "n": len(own), "sse": float(sse[j]), "iterations": done, "init_row": start[j], "rows": None}
            out.append(head)
            out += [{"chunk_id": chunk, "cluster_id": j, "rows": own[i : i + _ROWS].tolist()} for i in range(0, len(own), _ROWS)]
        return pa.Table.from_pylist(out, schema=_CHUNK)

    return run


def chunk_clusters(points: DataFrame, k: int, size: int, first: int | None = None, passes: int = kernel.MAX_PASSES) -> DataFrame:
    """Every chunk's clusters, and their members' rows: see split(). Starts from local row chunk_id + 1 unless given."""
    return chunked(points, size).select("chunk_id", "row_id", "features").groupBy("chunk_id").applyInArrow(_cluster(k, first, passes), _CHUNK_DDL)


def centroids_of(found: DataFrame, k: int, size: int) -> DataFrame:
    """centroid_id, chunk_id, cluster_id, center, n, sse, var (sse over the chunk's size), iterations, init_row."""
    c = found.where("center is not null")
    return c.select((F.col("chunk_id") * k + F.col("cluster_id")).alias("centroid_id"), "chunk_id", "cluster_id", "center", "n", "sse", (F.col("sse") / F.lit(float(size))).alias("var"), "iterations", "init_row")


def members_of(found: DataFrame, k: int) -> DataFrame:
    """row_id and centroid_id of every clustered row."""
    return found.where("rows is not null").select(F.explode("rows").alias("row_id"), (F.col("chunk_id") * k + F.col("cluster_id")).alias("centroid_id"))


@dataclass
class Result:
    """Final centers and what led to them."""

    centers: DataFrame
    iterations: int
    chunks: int
    groups: DataFrame | None = None
    centroids: DataFrame | None = None
    sample: DataFrame | None = None
    events: list[tuple[int, int, int, int]] = field(default_factory=list)


def _final(points: DataFrame, k: int, first: int, passes: int) -> tuple[DataFrame, int]:
    found = cut(points.select(F.lit(0).cast("long").alias("chunk_id"), "row_id", "features").groupBy("chunk_id").applyInArrow(_cluster(k, first, passes), _CHUNK_DDL).where("center is not null"))
    return found.select("cluster_id", "center", "n", "sse", "iterations", "init_row"), found.first()["iterations"]


def single(points: DataFrame, k: int, first: int = 1, passes: int = kernel.MAX_PASSES) -> Result:
    """All points as one chunk, in one task. For more points than fit a task, use operators.lloyd."""
    centers, done = _final(points, k, first, passes)
    return Result(centers, done, 1, events=[(2, 3, 1, done)])


def cluster(points: DataFrame, k: int, size: int, n: int | None = None, sample: str = "modulo", seed: int = 0, passes: int = kernel.MAX_PASSES, random_first: bool = False) -> Result:
    """Final k centers of points in chunks of `size` rows.

    With fewer than two whole chunks, all points are one chunk. sample: `modulo` picks members by place, and may pick a
    row again; `random` draws places with replacement, by a seeded hash. random_first starts chunks from seeded rows.
    """
    n = points.count() if n is None else n
    chunks = n // size
    if chunks <= 1:
        return single(points, k, passes=passes)
    used = points.where(F.col("row_id") < chunks * size)
    found = cut(chunk_clusters(used, k, size, seed * 16807 % size if random_first else None, passes))
    centroids = centroids_of(found, k, size)
    groups = grouping.group_map(centroids)
    sizes = grouping.group_sizes(centroids.select("centroid_id", "n"), groups)
    picked = sampling.picks(sampling.quotas(sizes, n, size), size)
    if sample == "random":
        place = F.pmod(F.xxhash64(F.lit(seed), "order"), F.col("nb_members"))
        picked = picked.join(sizes, "group_id").select("order", "group_id", place.alias("member_idx"))
    elif sample != "modulo":
        raise ValueError(f"sample: {sample}")
    chosen = cut(sampling.sample(cut(picked), grouping.member_index(members_of(found, k), groups), used, size))
    last = chosen.select(F.col("sel_idx").cast("long").alias("row_id"), "features")
    centers, done = _final(last, k, chunks + 1, passes)
    per_chunk = {r["chunk_id"]: r["iterations"] for r in centroids.where("cluster_id = 0").collect()}
    events = [(1, 4, m + 1, i) for m, i in sorted(per_chunk.items())] + [(2, 1, 1, k * chunks), (2, 2, 1, groups.agg(F.max("group_id")).first()[0] + 1), (4, 2, 1, done)]
    return Result(centers, done, chunks, groups, centroids, chosen, events)


def cluster_of_centers(points: DataFrame, k: int, size: int, seed: int = 0, passes: int = kernel.MAX_PASSES) -> Result:
    """K-means of the chunks' centers, started from k random ones."""
    n = points.count()
    chunks = max(1, n // size)
    found = cut(chunk_clusters(points.where(F.col("row_id") < chunks * size), k, size, passes=passes))
    centroids = centroids_of(found, k, size)
    rows = centroids.where(~F.exists("center", lambda v: F.isnan(v))).select(F.col("centroid_id").alias("row_id"), F.col("center").alias("features"))
    local = sorted((r["row_id"], list(r["features"])) for r in rows.collect())  # k * chunks rows, as in grouping
    x = np.array([v for _, v in local])
    start = np.random.default_rng(seed).choice(len(x), size=k, replace=False)
    centers, clusters, done = kernel.lloyd(x, x[start], passes)
    return Result(A.centers_frame(points, centers.tolist()), done, chunks, centroids=centroids)


def assign_all(points: DataFrame, result: Result) -> DataFrame:
    """Every point with its nearest final center (beyond what the program this follows returns)."""
    return A.assign(points, A.collect_centers(result.centers))


def main(argv: list[str]) -> int:
    """Arguments: path of a text file, k, number of points, chunk size, dimensions, output path."""
    from cairn.sources import points as P

    path, k, n, size, _, out = argv[0], int(argv[1]), int(argv[2]), int(argv[3]), int(argv[4]), argv[5]
    spark = SparkSession.builder.getOrCreate()
    result = cluster(P.from_text(spark, path), k, size, n)
    P.write_text(result.centers.select("cluster_id", F.col("center").alias("features")), out, "cluster_id")
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
