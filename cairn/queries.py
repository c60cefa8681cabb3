"""Registered queries of the clustering engine over whole tables, and their SQL for DuckDB.

Doubles that come out of sums are rounded on both sides, as the order of a sum is not fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import random, text, vectors
from cairn.lineage import new_dir
from cairn.operators import assign as A
from cairn.operators import centers as C
from cairn.operators import grouping, inits, kernel, lloyd, sampling
from cairn.plans import chunked, sweep
from cairn.sources import logs, points as P

K, SEED = 4, 12345
_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: Point sets as SQL.
EV = "ev AS (SELECT event_id AS row_id, value AS x0, user_id::DOUBLE AS x1 FROM events)"
CU = "cu AS (SELECT c_custkey AS row_id, c_acctbal AS x0, c_nationkey::DOUBLE AS x1 FROM customer)"
#: The first rows as centers, and the nearest of them.
CE = f"ce AS (SELECT row_id::INTEGER AS cluster_id, x0 AS c0, x1 AS c1 FROM ev WHERE row_id < {K})"
DI = "di AS (SELECT row_id, x0, x1, cluster_id, (x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1) AS d2 FROM ev, ce)"
NE = "ne AS (SELECT row_id, x0, x1, s.cluster_id AS cluster_id, s.d2 AS d2 FROM (SELECT row_id, x0, x1, min({'d2': d2, 'cluster_id': cluster_id}) AS s FROM di GROUP BY row_id, x0, x1))"
BASE = f"WITH {EV}, {CE}, {DI}, {NE}"


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.named(spark, sf_dir, "events2d")


def _first(points: DataFrame, k: int = K) -> list[list[float]]:
    return A.collect_centers(inits.first_rows(points, k))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _events(spark, sf_dir)
    return A.assign(points, _first(points))


def _flat(df: DataFrame, column: str = "center", dim: int = 2, digits: int | None = 6) -> DataFrame:
    parts = [F.get(column, F.lit(i)) for i in range(dim)]
    return df.select(*(c for c in df.columns if c != column), *((F.round(p, digits) if digits else p).alias(f"x{i}") for i, p in enumerate(parts)))


# sources and slices


@_query(f"WITH {EV} SELECT row_id // 1000 AS chunk_id, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n_rows FROM ev GROUP BY 1")
def chunk_marks(spark, sf_dir):
    return P.marks(_events(spark, sf_dir), 1000)


@_query(f"WITH {EV} SELECT * FROM ev WHERE row_id BETWEEN 100 AND 349")
def row_slice(spark, sf_dir):
    return _flat(P.rows_between(_events(spark, sf_dir), 100, 250), "features", digits=None)


@_query(f"WITH {EV} SELECT 0 AS dim, min(x0) AS lo, max(x0) AS hi FROM ev UNION ALL SELECT 1, min(x1), max(x1) FROM ev")
def point_bounds(spark, sf_dir):
    return P.bounds(_events(spark, sf_dir), 2)


@_query("SELECT count(*) AS n_rows FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l, chr(32) || chr(9) || chr(13) || chr(10)) <> '' AND NOT starts_with(l, '#')")
def text_row_count(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("value"))
    return P.row_count(lines)


#: All lines of all documents by document and place, and the words of the first that counts.
LINES = """li AS (SELECT doc_id, i, v, starts_with(v, '#') AS comment, trim(v, chr(32) || chr(9) || chr(13) || chr(10)) <> '' AND NOT starts_with(v, '#') AS kept
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
co AS (SELECT coalesce(first(len(list_filter(regexp_split_to_array(v, '[ \\n]'), lambda w: w <> ''))::INTEGER ORDER BY comment, doc_id, i), -1) AS n_columns FROM li WHERE kept OR comment)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, by document and place."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    return lines.select(F.struct("doc_id", "i").alias("row_id"), "value")


@_query(f"WITH {LINES} SELECT n_columns FROM co")
def text_column_count(spark, sf_dir):
    return P.column_count(_lines(spark, sf_dir))


@_query(f"WITH {LINES} SELECT n_columns, (SELECT count(*) FROM li WHERE kept) AS n_rows FROM co")
def text_header(spark, sf_dir):
    return P.header(_lines(spark, sf_dir))


@_query(f"WITH {CU} SELECT * FROM cu")
def points_text_round_trip(spark, sf_dir):
    """Points written as tab-separated text, in order, and read again with row ids from the lines' places."""
    path = new_dir(spark, "points")
    P.write_text(P.named(spark, sf_dir, "customer2d"), path, "row_id")
    return _flat(P.from_text(spark, path), "features", digits=None)


@_query(f"WITH {CU} SELECT * FROM cu")
def points_text_skipping(spark, sf_dir):
    """Points written as text with a comment and a blank line before each, and read again without these."""
    path = new_dir(spark, "points")
    points = P.named(spark, sf_dir, "customer2d").orderBy("row_id")
    lines = F.array(F.concat(F.lit("# row "), F.col("row_id").cast("string")), F.lit(" "), F.concat_ws("\t", F.transform("features", lambda v: v.cast("string"))))
    points.select(F.explode(lines).alias("value")).write.text(path)
    return _flat(P.from_text(spark, path, skip=True), "features", digits=None)


@_query(BASE + " SELECT row_id, chr(32) || chr(32) || cluster_id::VARCHAR AS value FROM ne")
def clusters_as_text(spark, sf_dir):
    """Cluster numbers written as lines in the order of the points, and the lines read again."""
    path = new_dir(spark, "clusters")
    P.ints_as_text(_near(spark, sf_dir).orderBy("row_id"), "cluster_id").write.text(path)
    return P.numbered_lines(spark, path)


# projections and predicates


@_query(f"WITH {EV} SELECT a.row_id, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) AS d2 FROM ev a, ev b WHERE b.row_id = 0")
def sq_distance(spark, sf_dir):
    points = _events(spark, sf_dir)
    return points.select("row_id", vectors.sq_distance(F.col("features"), lloyd.row(points, 0)).alias("d2"))


@_query(f"WITH {EV}, {CE}, {DI} SELECT row_id, cluster_id, d2 FROM di")
def distance_matrix(spark, sf_dir):
    points = _events(spark, sf_dir)
    return A.distances(points, _first(points))


@_query("SELECT vec_id, (list_min(embedding) < 0) AS any_negative, (list_max(embedding) <= 0) AS all_nonpositive FROM embeddings")
def sign_tests(spark, sf_dir):
    p = P.named(spark, sf_dir, "embed64")
    return p.select(F.col("row_id").alias("vec_id"), vectors.any_negative(F.col("features")).alias("any_negative"), vectors.all_nonpositive(F.col("features")).alias("all_nonpositive"))


@_query(f"WITH {EV}, {CE} SELECT row_id FROM ev WHERE row_id NOT IN (SELECT cluster_id FROM ce)")
def unchosen_points(spark, sf_dir):
    points = _events(spark, sf_dir)
    chosen = inits.first_rows(points, K).select(F.col("cluster_id").cast("long").alias("row_id"))
    return points.join(F.broadcast(chosen), "row_id", "left_anti").select("row_id")


# joins and assignments


@_query(BASE + " SELECT row_id, cluster_id, d2 FROM ne")
def assign_nearest(spark, sf_dir):
    return _near(spark, sf_dir).select("row_id", "cluster_id", "d2")


@_query(BASE + ", a AS (SELECT row_id, cluster_id FROM ne), b AS (SELECT row_id, min({'d2': (x0 - d0) * (x0 - d0) + (x1 - d1) * (x1 - d1), 'c': c}).c AS cluster_id FROM ev, (SELECT row_id - 4 AS c, x0 AS d0, x1 AS d1 FROM ev WHERE row_id BETWEEN 4 AND 7) GROUP BY row_id) SELECT count(*) FILTER (a.cluster_id <> b.cluster_id) AS n_changed FROM a JOIN b USING (row_id)")
def change_count(spark, sf_dir):
    points = _events(spark, sf_dir)
    both = _first(points, 2 * K)
    return A.change_count_of(points, both[:K], both[K:])


# aggregations


@_query(BASE + " SELECT cluster_id, count(*) AS n, round(sum(d2), 4) AS sse, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1 FROM ne GROUP BY cluster_id")
def centroids(spark, sf_dir):
    return _flat(A.centroids(_near(spark, sf_dir), K, 2)).withColumn("sse", F.round("sse", 4))


@_query(BASE + " SELECT cluster_id::INTEGER AS cluster_id, n FROM (SELECT r.i AS cluster_id, count(ne.row_id) AS n FROM range(6) r(i) LEFT JOIN ne ON ne.cluster_id = r.i GROUP BY r.i)")
def cluster_counts(spark, sf_dir):
    """Six clusters, two of them empty."""
    return A.member_counts(_near(spark, sf_dir), 6)


@_query(BASE + " SELECT round(sum(d2), 4) AS total FROM ne WHERE d2 <= 10000")
def total_distance(spark, sf_dir):
    """Points too far from every center are set aside: they have no cluster and do not count."""
    near = _near(spark, sf_dir)
    return A.total_distance(near.withColumn("cluster_id", F.when(F.col("d2") <= 10_000, F.col("cluster_id")))).select(F.round("total", 4).alias("total"))


@_query(BASE + " SELECT round(sum(d2), 4) AS total FROM ne")
def total_distance_all(spark, sf_dir):
    """The sum over all assigned points of the whole table; only points without a finite distance are skipped."""
    return A.total_distance(_near(spark, sf_dir)).select(F.round("total", 4).alias("total"))


@_query(BASE + " SELECT cluster_id, round(sum(d2), 4) AS energy FROM ne GROUP BY cluster_id")
def cluster_energy(spark, sf_dir):
    return A.cluster_energy(_near(spark, sf_dir), K).select("cluster_id", F.round("energy", 4).alias("energy"))


@_query(BASE + " SELECT cluster_id, round(sum(d2) / 250, 4) AS var FROM ne GROUP BY cluster_id")
def chunk_variance(spark, sf_dir):
    return A.chunk_variance(_near(spark, sf_dir), K, 250).select("cluster_id", F.round("var", 4).alias("var"))


@_query(BASE + " SELECT cluster_id, round(avg(d2), 4) AS var FROM ne GROUP BY cluster_id")
def cluster_variance(spark, sf_dir):
    return A.cluster_variance(_near(spark, sf_dir), K).select("cluster_id", F.round("var", 4).alias("var"))


@_query(BASE + """, c AS (SELECT cluster_id, count(*) AS p, sum(d2) AS e, sum(d2) / count(*) AS v FROM ne GROUP BY cluster_id), t AS (SELECT sum(p) AS tp, sum(e) AS te, sum(v) AS tv, sum(p * v) AS pv FROM c)
SELECT cluster_id, p AS population, floor(p * 100 / tp)::INTEGER AS population_pc, round(e, 4) AS energy, floor(e * 100 / te)::INTEGER AS energy_pc, round(v, 4) AS variance, floor(v * 100 / tv)::INTEGER AS variance_pc FROM c, t
UNION ALL SELECT NULL, tp::BIGINT, 100, round(te, 4), 100, round(pv / tp, 4), 100 FROM t""")
def summary_report(spark, sf_dir):
    return A.summary(_near(spark, sf_dir), K).withColumn("energy", F.round("energy", 4)).withColumn("variance", F.round("variance", 4))


@_query(f"WITH {EV} SELECT row_id // 500 AS chunk_id, count(*) AS n, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1 FROM ev GROUP BY 1")
def partial_means(spark, sf_dir):
    return _flat(C.partial_means(_events(spark, sf_dir), 500, 2), "mean")


@_query(f"WITH {EV}, {CE} SELECT round(sum((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1)), 6) AS total FROM ce a JOIN ce b ON a.cluster_id < b.cluster_id")
def inter_centroid(spark, sf_dir):
    return C.inter_centroid(inits.first_rows(_events(spark, sf_dir), K)).select(F.round("total", 6).alias("total"))


@_query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) AS total, (list_position(embedding, list_min(embedding)) - 1)::INTEGER AS min_index, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 6) AS self_dot FROM embeddings")
def vector_reductions(spark, sf_dir):
    f = F.col("features")
    return P.named(spark, sf_dir, "embed64").select(F.col("row_id").alias("vec_id"), F.round(vectors.total(f), 6).alias("total"), vectors.min_index(f).alias("min_index"), F.round(vectors.dot(f, f), 6).alias("self_dot"))


@_query("SELECT vec_id, 0::DOUBLE AS zeros, -len(embedding)::INTEGER AS minus_ones FROM embeddings")
def constant_vectors(spark, sf_dir):
    p = P.named(spark, sf_dir, "embed64")
    minus = F.aggregate(vectors.constant(64, -1), F.lit(0), lambda a, v: a + v)
    return p.select(F.col("row_id").alias("vec_id"), vectors.total(vectors.constant(64, 0.0)).alias("zeros"), minus.alias("minus_ones"))


# ordering, ranking, sampling


def _farthest_sql(k: int) -> str:
    parts = [EV, "f0 AS (SELECT 0 AS rank, row_id, x0, x1 FROM ev WHERE row_id = 1)"]
    for r in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(r))
        parts.append(f"f{r} AS (SELECT {r} AS rank, row_id, x0, x1 FROM (SELECT e.row_id, e.x0, e.x1, min((e.x0 - c.x0) * (e.x0 - c.x0) + (e.x1 - c.x1) * (e.x1 - c.x1)) AS d2 FROM ev e, ({before}) c GROUP BY 1, 2, 3) ORDER BY d2 DESC, row_id LIMIT 1)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT rank, row_id, x0, x1 FROM f{i}" for i in range(k))


@_query(_farthest_sql(K))
def farthest_first(spark, sf_dir):
    found = lloyd.farthest_first(_events(spark, sf_dir), K)
    return spark.createDataFrame([(i, r, v[0], v[1]) for i, (r, v) in enumerate(found)], "rank int, row_id long, x0 double, x1 double")


@_query(f"WITH {EV} SELECT e.row_id, (e.x0 - b.x0) * (e.x0 - b.x0) + (e.x1 - b.x1) * (e.x1 - b.x1) AS d2 FROM ev e, ev b WHERE b.row_id = 0 ORDER BY d2 DESC, e.row_id LIMIT 1")
def dispersion(spark, sf_dir):
    return spark.createDataFrame([C.dispersion(_events(spark, sf_dir))], "row_id long, d2 double")


@_query(f"WITH {EV}, m AS (SELECT row_id // 100 AS chunk_id, avg(x0) AS m0, avg(x1) AS m1 FROM ev GROUP BY 1) SELECT a.chunk_id, round(sum((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1)), 6) AS total FROM m a, m b WHERE b.chunk_id IN (0, 1) AND a.chunk_id NOT IN (0, 1) GROUP BY a.chunk_id ORDER BY total DESC, a.chunk_id LIMIT 1")
def farthest_mean(spark, sf_dir):
    means = C.partial_means(_events(spark, sf_dir), 100, 2)
    return C.farthest_mean(means, [0, 1]).select("chunk_id", F.round("total", 6).alias("total"))


@_query(f"WITH {EV}, {CE} SELECT (row_number() OVER (ORDER BY c0 DESC, cluster_id) - 1)::INTEGER AS rank, cluster_id, c0 AS x0, c1 AS x1 FROM ce")
def sort_centers(spark, sf_dir):
    return _flat(C.sort_centers(inits.first_rows(_events(spark, sf_dir), K)), digits=None)


_MEMBERS = BASE + ", gr AS (SELECT row_id, cluster_id // 2 AS group_id FROM ne), me AS (SELECT group_id, row_id, row_number() OVER (PARTITION BY group_id ORDER BY row_id) - 1 AS member_idx FROM gr)"


def _grouped(spark, sf_dir):
    rows = _near(spark, sf_dir).select("row_id", F.col("cluster_id").cast("long").alias("centroid_id"))
    groups = spark.createDataFrame([(i, i // 2) for i in range(K)], "centroid_id long, group_id int")
    return rows, groups


@_query(_MEMBERS + " SELECT group_id, row_id, member_idx FROM me")
def member_index(spark, sf_dir):
    return grouping.member_index(*_grouped(spark, sf_dir), chunk=512)


@_query(_MEMBERS + " SELECT group_id, count(*) AS nb_members FROM gr GROUP BY group_id")
def group_sizes(spark, sf_dir):
    rows, groups = _grouped(spark, sf_dir)
    return grouping.group_sizes(rows.groupBy("centroid_id").agg(F.count("*").alias("n")), groups)


_QUOTAS = _MEMBERS + ", qu AS (SELECT group_id, nb, trunc((nb::FLOAT / (SELECT count(*) FROM ev)::FLOAT)::FLOAT * 250::FLOAT)::INTEGER AS q FROM (SELECT group_id, count(*) AS nb FROM gr GROUP BY group_id))"


@_query(_QUOTAS + " SELECT group_id, nb AS nb_members, q AS quota FROM qu")
def quotas(spark, sf_dir):
    return sampling.quotas(group_sizes(spark, sf_dir), _events(spark, sf_dir).count(), 250)


@_query(_QUOTAS + """, pi AS (SELECT p.i * (SELECT sum(q) FROM qu) + coalesce((SELECT sum(b.q) FROM qu b WHERE b.group_id < qu.group_id), 0) + j.j AS o, group_id, (j.j + group_id * q) % nb AS member_idx FROM qu, range(251) p(i), range(250) j(j) WHERE j.j < q),
sa AS (SELECT o, row_id FROM pi JOIN me USING (group_id, member_idx) WHERE o < 250)
SELECT (row_number() OVER (ORDER BY row_id // 250, o) - 1)::INTEGER AS sel_idx, row_id, x0, x1 FROM sa JOIN ev USING (row_id)""")
def representative_sample(spark, sf_dir):
    rows, groups = _grouped(spark, sf_dir)
    picked = sampling.picks(quotas(spark, sf_dir), 250)
    return _flat(sampling.sample(picked, grouping.member_index(rows, groups), _events(spark, sf_dir), 250), "features", digits=None)


@_query(f"WITH {EV} SELECT row_id, x0, x1 FROM ev ORDER BY md5('7:' || row_id), row_id LIMIT 10")
def random_rows(spark, sf_dir):
    return _flat(sampling.random_rows(_events(spark, sf_dir), 10, 7), "features", digits=None)


# iterations


def _lloyd_sql(passes: int) -> str:
    """Centers after a number of passes without an early end."""
    parts = [EV, CE]
    for t in range(passes + 1):
        c = "ce" if not t else f"c{t}"
        parts.append(f"a{t} AS (SELECT row_id, x0, x1, min({{'d2': (x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1), 'c': cluster_id}}).c AS cluster_id FROM ev, {c} GROUP BY row_id, x0, x1)")
        if t < passes:
            parts.append(f"c{t + 1} AS (SELECT cluster_id, avg(x0) AS c0, avg(x1) AS c1 FROM a{t} GROUP BY cluster_id)")
    return f"WITH {', '.join(parts)} SELECT cluster_id, round(c0, 6) AS x0, round(c1, 6) AS x1 FROM c{passes}"


@_query(_lloyd_sql(3))
def lloyd_three_passes(spark, sf_dir):
    points = _events(spark, sf_dir)
    found, _ = lloyd.lloyd(points, _first(points), passes=3)
    return _flat(A.centers_frame(points, found))


@_query()
def lloyd_converged(spark, sf_dir):
    """All points, farthest-first, to the end."""
    points = _events(spark, sf_dir)
    found, done = lloyd.lloyd(points, [v for _, v in lloyd.farthest_first(points, K)])
    return _flat(A.centers_frame(points, found)).withColumn("iterations", F.lit(done))


def _cluster_sql(points: str, p: str, first: str, passes: int = 2) -> list[str]:
    """Farthest-first centers and passes in every chunk of points (ch, li, row_id, x0, x1): tables {p}s, {p}a."""
    d = "(x0 - c0) * (x0 - c0) + (x1 - c1) * (x1 - c1)"
    out = [f"{p}f0 AS (SELECT ch, 0 AS k, li, x0 AS c0, x1 AS c1 FROM {points} WHERE li = {first})"]
    for r in range(1, K):
        before = " UNION ALL ".join(f"SELECT * FROM {p}f{i}" for i in range(r))
        far = f"SELECT q.ch, q.li, x0, x1, min({d}) AS d2 FROM {points} q JOIN ({before}) c USING (ch) GROUP BY 1, 2, 3, 4"
        out.append(f"{p}f{r} AS (SELECT ch, {r} AS k, li, x0 AS c0, x1 AS c1 FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY d2 DESC, li) AS w FROM ({far})) WHERE w = 1)")
    out.append(f"{p}s AS ({' UNION ALL '.join(f'SELECT * FROM {p}f{i}' for i in range(K))})")
    for t in range(passes + 1):
        c = f"{p}c{t}"
        out.append(f"{c} AS (SELECT ch, k, " + ("c0, c1 FROM " + p + "s)" if not t else f"avg(x0) AS c0, avg(x1) AS c1 FROM {p}a{t - 1} GROUP BY ch, k)"))
        out.append(f"{p}a{t} AS (SELECT ch, row_id, li, x0, x1, s.k AS k, s.d2 AS d2 FROM (SELECT q.ch, row_id, li, x0, x1, min({{'d2': {d}, 'k': k}}) AS s FROM {points} q JOIN {c} USING (ch) GROUP BY 1, 2, 3, 4, 5))")
    last = f"SELECT ch, k, count(*) AS n, sum(d2) AS sse FROM {p}a{passes} GROUP BY ch, k"
    out.append(f"{p}o AS (SELECT ch, k, n, sse, c0, c1, li FROM ({last}) JOIN {p}c{passes} USING (ch, k) JOIN (SELECT ch, k, li FROM {p}s) USING (ch, k))")
    return out


_CHUNKS = [EV, "sz AS (SELECT count(*) // 4 AS t, count(*) AS n FROM ev)", "pt AS (SELECT row_id // t AS ch, row_id % t AS li, row_id, x0, x1 FROM ev, sz WHERE row_id < t * (n // t))", *_cluster_sql("pt", "u", "ch + 1")]


@_query(f"WITH {', '.join(_CHUNKS)} SELECT ch * {K} + k AS centroid_id, ch AS chunk_id, k::INTEGER AS cluster_id, n, round(sse, 4) AS sse, 2 AS iterations, li AS init_row, round(c0, 6) AS x0, round(c1, 6) AS x1 FROM uo")
def chunk_clusters_two_passes(spark, sf_dir):
    points = _events(spark, sf_dir)
    size = points.count() // 4
    found = chunked.cut(chunked.chunk_clusters(points.where(F.col("row_id") < size * 4), K, size, passes=2))
    return _flat(chunked.centroids_of(found, K, size).drop("var")).withColumn("sse", F.round("sse", 4))


def _whole_sql() -> str:
    groups = """l AS (SELECT list(ch * 4 + k ORDER BY ch * 4 + k) AS ids, list(c0 ORDER BY ch * 4 + k) AS xs, list(c1 ORDER BY ch * 4 + k) AS ys, list(sse / t ORDER BY ch * 4 + k) AS vs FROM uo, sz),
g AS (
  SELECT 0 AS step, list_transform(ids, lambda i: -1) AS grp, 0 AS m FROM l
  UNION ALL
  SELECT step + 1, CASE WHEN grp[step + 1] >= 0 THEN grp ELSE list_transform(range(1, len(ids) + 1), lambda i: CASE
    WHEN grp[i] >= 0 OR i < step + 1 THEN grp[i] WHEN i = step + 1 THEN m
    WHEN (xs[i] - xs[step + 1]) * (xs[i] - xs[step + 1]) + (ys[i] - ys[step + 1]) * (ys[i] - ys[step + 1]) < vs[step + 1] THEN m ELSE -1 END) END,
    CASE WHEN grp[step + 1] >= 0 THEN m ELSE m + 1 END
  FROM g, l WHERE step < len(ids)),
gm AS (SELECT ids[i] AS id, grp[i] AS group_id FROM (SELECT ids, grp, unnest(range(1, len(ids) + 1)) AS i FROM g, l WHERE step = len(ids))),
me AS (SELECT group_id, row_id, row_number() OVER (PARTITION BY group_id ORDER BY row_id) - 1 AS member_idx FROM ua2 JOIN gm ON ch * 4 + k = id),
qu AS (SELECT group_id, nb, trunc((nb::FLOAT / n::FLOAT)::FLOAT * t::FLOAT)::INTEGER AS q FROM (SELECT group_id, count(*) AS nb FROM me GROUP BY group_id), sz),
pa AS (SELECT sum(q) AS one FROM qu),
pi AS (SELECT p.i * one + coalesce((SELECT sum(b.q) FROM qu b WHERE b.group_id < qu.group_id), 0) + j.j AS o, group_id, (j.j + group_id * q) % nb AS member_idx FROM qu, pa, (SELECT unnest(range((t // one)::BIGINT + 2)) AS i FROM sz, pa) p, (SELECT unnest(range(t)) AS j FROM sz) j WHERE j.j < q),
sa AS (SELECT 0 AS ch, row_number() OVER (ORDER BY row_id // t, o) - 1 AS li, row_number() OVER (ORDER BY row_id // t, o) - 1 AS row_id, x0, x1 FROM pi JOIN me USING (group_id, member_idx) JOIN ev USING (row_id), sz WHERE o < t)"""
    parts = [*_CHUNKS, groups, *_cluster_sql("sa", "v", "(SELECT n // t + 1 FROM sz)")]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT k::INTEGER AS cluster_id, n, round(sse, 4) AS sse, 2 AS iterations, li AS init_row, round(c0, 6) AS x0, round(c1, 6) AS x1 FROM vo"


@_query(_whole_sql())
def chunked_kmeans_two_passes(spark, sf_dir):
    """The whole computation in four chunks, with two passes in each and two at the end."""
    points = _events(spark, sf_dir)
    n = points.count()
    return _flat(chunked.cluster(points, K, n // 4, n, passes=2).centers).withColumn("sse", F.round("sse", 4))


@_query()
def chunk_clusters(spark, sf_dir):
    points = _events(spark, sf_dir)
    size = max(1, points.count() // 4)
    found = chunked.cut(chunked.chunk_clusters(points, K, size))
    return _flat(chunked.centroids_of(found, K, size).drop("var")).withColumn("sse", F.round("sse", 4))


_GREEDY = """
WITH RECURSIVE c AS (SELECT c_nationkey AS id, avg(c_acctbal) AS x, var_pop(c_acctbal) / 1000 AS v FROM customer GROUP BY 1),
l AS (SELECT list(id ORDER BY id) AS ids, list(x ORDER BY id) AS xs, list(v ORDER BY id) AS vs FROM c),
g AS (
  SELECT 0 AS step, list_transform(ids, lambda i: -1) AS grp, 0 AS n FROM l
  UNION ALL
  SELECT step + 1, CASE WHEN grp[step + 1] >= 0 THEN grp ELSE list_transform(range(1, len(ids) + 1), lambda i: CASE
    WHEN grp[i] >= 0 OR i < step + 1 THEN grp[i] WHEN i = step + 1 THEN n WHEN (xs[i] - xs[step + 1]) * (xs[i] - xs[step + 1]) < vs[step + 1] THEN n ELSE -1 END) END,
    CASE WHEN grp[step + 1] >= 0 THEN n ELSE n + 1 END
  FROM g, l WHERE step < len(ids))
SELECT ids[i]::BIGINT AS centroid_id, grp[i]::INTEGER AS group_id FROM (SELECT ids, grp, unnest(range(1, len(ids) + 1)) AS i FROM g, l WHERE step = len(ids))
"""


@_query(_GREEDY)
def greedy_groups(spark, sf_dir):
    """Nations' mean balances as centroids, merged where closer than a share of the variance."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = customer.groupBy(F.col("c_nationkey").cast("long").alias("centroid_id")).agg(F.array(F.avg("c_acctbal")).alias("center"), (F.var_pop("c_acctbal") / 1000).alias("var"))
    return grouping.group_map(found)


@_query()
def chunked_kmeans(spark, sf_dir):
    """The whole computation on the events in four chunks: final centers."""
    points = _events(spark, sf_dir)
    n = points.count()
    return _flat(chunked.cluster(points, K, n // 4, n).centers).withColumn("sse", F.round("sse", 4))


@_query()
def chunked_kmeans_assignments(spark, sf_dir):
    points = _events(spark, sf_dir)
    n = points.count()
    return chunked.assign_all(points, chunked.cluster(points, K, n // 4, n)).select("row_id", "cluster_id", F.round("d2", 6).alias("d2"))


@_query()
def chunked_kmeans_random(spark, sf_dir):
    """Chunks begun from seeded rows and a sample drawn with replacement."""
    points = _events(spark, sf_dir)
    n = points.count()
    return _flat(chunked.cluster(points, K, n // 4, n, sample="random", seed=SEED, random_first=True).centers).withColumn("sse", F.round("sse", 4))


@_query()
def single_kmeans(spark, sf_dir):
    return _flat(chunked.single(P.named(spark, sf_dir, "customer2d"), K).centers).withColumn("sse", F.round("sse", 4))


@_query()
def embedding_kmeans(spark, sf_dir):
    found = chunked.single(P.named(spark, sf_dir, "embed64"), 10).centers
    return found.select("cluster_id", "n", F.round("sse", 6).alias("sse"), "iterations", "init_row")


@_query()
def kmeans_of_kmeans(spark, sf_dir):
    points = _events(spark, sf_dir)
    return _flat(chunked.cluster_of_centers(points, K, points.count() // 4).centers)


@_query(BASE + ", c AS (SELECT cluster_id, count(*) AS n FROM ne GROUP BY 1) SELECT ne.row_id, di.cluster_id AS to_cluster, round(CASE WHEN ne.cluster_id = di.cluster_id THEN CASE WHEN n > 1 THEN di.d2 * (n::DOUBLE / (n - 1)) ELSE 0 END ELSE di.d2 * (n::DOUBLE / (n + 1)) END, 3) AS score FROM ne JOIN di USING (row_id) JOIN c ON c.cluster_id = di.cluster_id")
def move_scores(spark, sf_dir):
    points = _events(spark, sf_dir)
    first = _first(points)
    near = A.assign(points, first)
    counts = [r["n"] for r in A.member_counts(near, K).orderBy("cluster_id").collect()]
    return A.move_scores(near, first, counts).withColumn("score", F.round("score", 3))


_MOVED = "CASE WHEN k = old THEN (s{i} - m.x{i}) / (p - 1) WHEN k = (old + 1) % 4 THEN (s{i} + m.x{i}) / (p + 1) ELSE s{i} / p END"


@_query(f"""{BASE}, c AS (SELECT cluster_id AS k, count(*) AS p, sum(x0) AS s0, sum(x1) AS s1 FROM ne GROUP BY 1), m AS (SELECT cluster_id AS old, x0, x1 FROM ne WHERE row_id = 17)
SELECT k AS cluster_id, p - (k = old)::INT + (k = (old + 1) % 4)::INT AS n, round({_MOVED.format(i=0)}, 6) AS x0, round({_MOVED.format(i=1)}, 6) AS x1 FROM c, m""")
def move_point(spark, sf_dir):
    near = _near(spark, sf_dir)
    moved = near.where("row_id = 17").first()
    state = A.centroids(near, K, 2).select("cluster_id", "n", "center")
    return _flat(A.move(state, moved["features"], moved["cluster_id"], (moved["cluster_id"] + 1) % K))


@_query(BASE + ", c AS (SELECT cluster_id, avg(x0) AS m0, avg(x1) AS m1 FROM ne GROUP BY 1) SELECT round(sqrt(sum((c0 - m0) * (c0 - m0) + (c1 - m1) * (c1 - m1))), 6) AS distance FROM ce JOIN c USING (cluster_id)")
def compare_solution(spark, sf_dir):
    first = inits.first_rows(_events(spark, sf_dir), K)
    return C.compare(first, A.centroids(_near(spark, sf_dir), K, 2).select("cluster_id", "center")).select(F.round("distance", 6).alias("distance"))


# initialisers


@_query(f"WITH {EV}, {CE} SELECT cluster_id, c0 AS x0, c1 AS x1 FROM ce")
def init_first_rows(spark, sf_dir):
    return _flat(inits.first_rows(_events(spark, sf_dir), K), digits=None)


_U = "({s} * 4.656612875e-10::DOUBLE)"


@_query(f"WITH {EV}, b AS (SELECT min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1 FROM ev), r AS (SELECT i::INTEGER AS cluster_id, {_U.format(s=random.state_sql(SEED, 'i * 2 + 1'))} AS r0, {_U.format(s=random.state_sql(SEED, 'i * 2 + 2'))} AS r1 FROM range({K}) t(i)) SELECT cluster_id, round((1 - r0) * l0 + r0 * h0, 6) AS x0, round((1 - r1) * l1 + r1 * h1, 6) AS x1 FROM r, b")
def init_in_box(spark, sf_dir):
    return _flat(inits.in_box(_events(spark, sf_dir), K, 2, SEED))


@_query(f"WITH {EV}, l AS (SELECT *, CASE WHEN row_id < {K} THEN row_id ELSE {random.uniform_int_sql(SEED, f'greatest(row_id - {K} + 1, 0)', 0, K - 1)} END::INTEGER AS cluster_id FROM ev) SELECT cluster_id, round(avg(x0), 6) AS x0, round(avg(x1), 6) AS x1 FROM l GROUP BY cluster_id")
def init_random_partition(spark, sf_dir):
    return _flat(inits.random_partition(_events(spark, sf_dir), K, 2, SEED))


@_query(f"WITH {EV}, w AS (SELECT x0, x1, row_id, c::INTEGER AS cluster_id, {_U.format(s=random.state_sql(SEED, f'row_id * {K} + c + 1'))} AS u FROM ev, range({K}) t(c)), f AS (SELECT *, u / sum(u) OVER (PARTITION BY row_id) AS f FROM w) SELECT cluster_id, round(sum(f * x0) / sum(f), 6) AS x0, round(sum(f * x1) / sum(f), 6) AS x1 FROM f GROUP BY cluster_id")
def init_random_split(spark, sf_dir):
    return _flat(inits.random_split(_events(spark, sf_dir), K, 2, SEED))


@_query(f"WITH {EV}, w AS (SELECT x0, x1, c::INTEGER AS cluster_id, {_U.format(s=random.state_sql(SEED, 'row_id + c * (SELECT count(*) FROM ev) + 1'))} AS u FROM ev, range({K}) t(c)) SELECT cluster_id, round(sum(u * x0) / sum(u), 6) AS x0, round(sum(u * x1) / sum(u), 6) AS x1 FROM w GROUP BY cluster_id")
def init_random_mixture(spark, sf_dir):
    points = _events(spark, sf_dir)
    return _flat(inits.random_mixture(points, K, 2, SEED, points.count()))


# scalars


@_query(f"SELECT event_id AS row_id, {random.state_sql(SEED, 'event_id + 1')} AS state, {_U.format(s=random.state_sql(SEED, 'event_id + 1'))} AS r, {random.uniform_int_sql(SEED, 'event_id + 1', -3, 9)} AS i FROM events")
def congruential_draws(spark, sf_dir):
    n = F.col("row_id") + 1
    return _events(spark, sf_dir).select("row_id", random.state(SEED, n).alias("state"), random.uniform(SEED, n).alias("r"), random.uniform_int(SEED, n, -3, 9).alias("i"))


@_query(f"SELECT event_id AS row_id, {_U.format(s=random.state_sql(SEED, 'event_id * 3 + 1'))} AS x0, {_U.format(s=random.state_sql(SEED, 'event_id * 3 + 2'))} AS x1, {_U.format(s=random.state_sql(SEED, 'event_id * 3 + 3'))} AS x2 FROM events")
def generator_vectors(spark, sf_dir):
    """Three draws for each event, one event's after the other's."""
    points = _events(spark, sf_dir).select("row_id", random.uniform_vector(SEED, F.col("row_id") * 3, 3).alias("center"))
    return _flat(points, dim=3, digits=None)


@_query(f"SELECT (k % 50)::INTEGER AS i, (k // 50)::INTEGER AS j, {_U.format(s=random.state_sql(SEED, 'k + 1'))} AS v FROM range(1000) t(k)")
def generator_matrix(spark, sf_dir):
    return random.uniform_matrix(spark, SEED, 50, 20)


@_query(f"WITH {CU}, m AS (SELECT row_id AS j, 0 AS i, x0 AS v FROM cu UNION ALL SELECT row_id, 1, x1 FROM cu) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.v * b.v), 2) AS v FROM m a JOIN m b USING (j) GROUP BY a.i, b.i")
def matrix_product(spark, sf_dir):
    """The product of the customers' matrix, transposed, with itself."""
    cells = P.named(spark, sf_dir, "customer2d").select(F.posexplode("features").alias("i", "v"), F.col("row_id").alias("j"))
    other = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return vectors.matmul(cells.select("i", "j", "v"), other).withColumn("v", F.round("v", 2))


@_query("SELECT p_partkey, upper(left(p_name, 1)) AS cap, upper(left(p_name, 1)) = upper(left(p_brand, 1)) AS same_letter, coalesce(try_cast(right(p_brand, 1) AS INTEGER), -1) AS digit, length(rtrim(p_name, ' ' || chr(10))) AS trimmed, len(list_filter(regexp_split_to_array(p_name, '[ \\n]'), lambda w: w <> ''))::INTEGER AS n_words, greatest(p_size, 25) AS at_least, least(p_size, 25) AS at_most, (p_size * p_size)::INTEGER AS square FROM part")
def character_functions(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    first = F.substring("p_name", 1, 1)
    return part.select(
        "p_partkey", text.upper_ascii(first).alias("cap"), text.equal_ignoring_case(first, F.substring("p_brand", 1, 1)).alias("same_letter"), text.digit(F.right("p_brand", F.lit(1))).alias("digit"),
        text.trimmed_length(F.col("p_name")).cast("long").alias("trimmed"), text.word_count(F.col("p_name")).alias("n_words"), F.greatest("p_size", F.lit(25)).alias("at_least"), F.least("p_size", F.lit(25)).alias("at_most"), (F.col("p_size") * F.col("p_size")).alias("square"),
    )


@_query("SELECT c_custkey, c_acctbal AS plain, c_acctbal AS cut_off, round(c_acctbal * 100, 4) AS scaled, c_acctbal AS c_prefix FROM customer")
def parse_reals(spark, sf_dir):
    """Balances written as text with blanks, tails and exponents, and read again."""
    s = F.col("c_acctbal").cast("string")
    number = lambda x: text.real(F.concat(*x))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", number([F.lit(" , "), s]).alias("plain"), number([s, F.lit("A1")]).alias("cut_off"), F.round(number([s, F.lit("d2 7")]), 4).alias("scaled"), text.prefix_real(F.concat(s, F.lit("x9"))).alias("c_prefix"),
    )


@_query("SELECT c_custkey, c_acctbal AS x0, c_nationkey::DOUBLE AS x1 FROM customer")
def parse_vectors(spark, sf_dir):
    """Two numbers of a line of three."""
    line = F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(",  "), F.col("c_nationkey").cast("string"), F.lit(" 7"))
    return _flat(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.reals(line, 2).alias("center")), digits=None)


# logs and sweeps


@_query("SELECT event_id, strftime(ts, '%d %B %Y %I:%M:%S %p') AS time_text FROM events")
def time_texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.time_text(F.col("ts").cast("timestamp")).alias("time_text"))


@_query(BASE + " SELECT row_id, cluster_id // 2 = 0 AS in_first_group, cluster_id NOT IN (0, 3) AS in_no_listed_group FROM ne")
def group_membership(spark, sf_dir):
    """Whether a point's centroid is in one group, and whether it is in no group of a list."""
    rows, groups = _grouped(spark, sf_dir)
    listed = spark.createDataFrame([(0, 0), (3, 1)], "centroid_id long, other int")
    known = rows.join(F.broadcast(groups), "centroid_id").join(F.broadcast(listed), "centroid_id", "left")
    return known.select("row_id", (F.col("group_id") == 0).alias("in_first_group"), F.col("other").isNull().alias("in_no_listed_group"))


@_query(BASE + " SELECT row_id, cluster_id, row_id AS kept_row_id FROM ne WHERE cluster_id = (SELECT min(cluster_id) FROM ne)")
def copied_assignment(spark, sf_dir):
    """An assignment frame is immutable, so a copy is a projection of it: here the rows of the first cluster."""
    near = _near(spark, sf_dir)
    return near.where("cluster_id = 0").select("row_id", "cluster_id", F.col("row_id").alias("kept_row_id"))


@_query(BASE + " SELECT row_id, cluster_id, row_id AS kept_row_id FROM ne")
def copied_assignment_all(spark, sf_dir):
    """The copy of a whole assignment: every point's row."""
    return _near(spark, sf_dir).select("row_id", "cluster_id", F.col("row_id").alias("kept_row_id"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("AbsoluteTime"), F.col("user_id").alias("run"), F.lit(1).alias("Phase"), F.lit(4).alias("Step"), F.col("event_id").cast("int").alias("Loop"))


@_query("SELECT (epoch_us(ts) // 1000)::BIGINT AS \"AbsoluteTime\", user_id AS run, event_id::INTEGER AS \"Loop\", (epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS duration_ms FROM events")
def phase_durations(spark, sf_dir):
    """The events read as a log of runs: time since the event before in the same run."""
    return logs.durations(_log(spark, sf_dir), "run").select("AbsoluteTime", "run", "Loop", "duration_ms")


@_query("SELECT (epoch_us(ts) // 1000)::BIGINT AS \"AbsoluteTime\", 1 AS \"Phase\", 4 AS \"Step\", event_id::INTEGER AS \"Loop\", user_id::INTEGER AS \"Iteration\", 2900000::BIGINT AS \"Frequency\", value AS \"CPU_Usage\", NULL::DOUBLE AS \"SWAP\" FROM events")
def log_file(spark, sf_dir):
    """The events appended to a log file, and the file read again."""
    path = new_dir(spark, "log")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("AbsoluteTime"), F.lit(1).alias("Phase"), F.lit(4).alias("Step"), F.col("event_id").cast("int").alias("Loop"), F.col("user_id").cast("int").alias("Iteration"), F.lit(logs.FREQUENCY).alias("Frequency"), F.col("value").alias("CPU_Usage"))
    logs.append(rows, path)
    return logs.read(spark, path).select(*rows.columns, "SWAP")


@_query("SELECT (epoch_us(ts) // 1000)::BIGINT AS ts_ms, value AS util_avg, user_id::DOUBLE AS load_avg FROM events")
def scheduler_file(spark, sf_dir):
    """The events written as scheduler samples, and the file read again."""
    path = new_dir(spark, "scheduler")
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_millis(F.col("ts").cast("timestamp")), "value", F.col("user_id").cast("double")).write.csv(path)
    return logs.read_scheduler(spark, path)


@_query("SELECT (epoch_us(ts) // 1000)::BIGINT AS \"AbsoluteTime\", CASE WHEN value < 50 THEN 1 END::INTEGER AS \"Phase\", CASE WHEN value >= 50 THEN value END AS \"CPU_Usage\" FROM events")
def stacked_logs(spark, sf_dir):
    """Two logs with different columns as one, by time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("AbsoluteTime"), "value")
    phase = e.where("value < 50").select("AbsoluteTime", F.lit(1).alias("Phase"))
    return logs.in_order(logs.stack(phase, e.where("value >= 50").select("AbsoluteTime", F.col("value").alias("CPU_Usage"))))


@_query("SELECT r::INTEGER AS ratio, 13421800::BIGINT // r AS chunk, (ceil((13421800::BIGINT // r * 10 * 8 + 13421800::BIGINT // r * 10 * 8 + 13421800::BIGINT // r * 12) / 1048576::DOUBLE + 1.5) + 1)::BIGINT AS memory_mb, s AS setting, '13421800,' || (13421800 // r) || ',' || r || ',' || s AS tag FROM (VALUES (1), (2), (4), (5), (8), (10)) a(r), (VALUES ('performance'), ('powersave')) b(s)")
def parameter_sweep(spark, sf_dir):
    return sweep.sweep(spark, 13_421_800, 10, 10, [1, 2, 4, 5, 8, 10], ["performance", "powersave"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked clustering of the events: final centers."""
    return chunked_kmeans(spark, sf_dir)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
