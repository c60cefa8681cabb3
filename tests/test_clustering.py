import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import assign as A
from cairn.operators import centers as C
from cairn.operators import grouping, inits, kernel, lloyd, sampling
from cairn.plans import chunked, sweep
from cairn.sources import points as P
from tests import model

TOY = [(0, 0), (0, 1), (10, 10), (10, 11), (1, 0), (1, 1), (11, 10), (11, 11), (0, 2), (2, 0), (10, 12), (12, 10)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row_id long, features array<double>").repartition(parts)


def centers(result):
    return A.collect_centers(result.centers)


def test_toy_in_two_chunks(spark):
    r = chunked.cluster(frame(spark, TOY), 2, 6)
    found = {(x["chunk_id"], x["cluster_id"]): x for x in r.centroids.collect()}
    assert [found[m, j]["init_row"] for m in (0, 1) for j in (0, 1)] == [1, 3, 2, 5]
    assert [found[m, j]["iterations"] for m in (0, 1) for j in (0, 1)] == [0] * 4
    assert [list(found[m, j]["center"]) for m in (0, 1) for j in (0, 1)] == [[0.5, 0.5], [10, 10.5], [1, 1], [11, 10.75]]
    assert np.allclose([found[m, j]["var"] for m in (0, 1) for j in (0, 1)], [1 / 3, 1 / 12, 2 / 3, 19 / 24])
    assert [x["row_id"] for x in r.sample.orderBy("sel_idx").collect()] == [0, 1, 3, 8, 10, 11]
    assert np.allclose(centers(r), [(0, 1), (32 / 3, 11)])
    assert [x["n"] for x in r.centers.orderBy("cluster_id").collect()] == [3, 3]
    assert (2, 2, 1, 4) in r.events and (4, 2, 1, 0) in r.events


def test_toy_in_one_chunk(spark):
    r = chunked.cluster(frame(spark, TOY), 2, 12)
    assert np.allclose(centers(r), [(2 / 3, 2 / 3), (32 / 3, 32 / 3)])
    assert [x["init_row"] for x in r.centers.orderBy("cluster_id").collect()] == [1, 11]


@pytest.mark.parametrize("k", [2, 3])
def test_empty_quotas_raise(spark, k):
    with pytest.raises(sampling.EmptyQuotas):
        chunked.cluster(frame(spark, TOY), k, 4)


def test_events_as_published(spark):
    """The values that were worked out for the events of the smallest tables."""
    points = P.named(spark, "/root/testdata/sf0.001", "events2d")
    r = chunked.cluster(points, 4, 250)
    by = {}
    for x in r.centroids.collect():
        by.setdefault(x["chunk_id"], {})[x["cluster_id"]] = x
    assert [by[m][0]["iterations"] for m in range(4)] == [6, 10, 10, 19]
    assert [[by[m][j]["init_row"] for j in range(4)] for m in range(4)] == [[1, 25, 185, 91], [2, 38, 147, 129], [3, 56, 159, 198], [4, 50, 179, 187]]
    assert np.allclose([sum(by[m][j]["sse"] for j in range(4)) for m in range(4)], [64693.316398, 67697.502740, 78398.267909, 42473.419240])
    groups = {}
    for x in r.groups.collect():
        groups.setdefault(x["group_id"], []).append(x["centroid_id"])
    assert sorted(map(sorted, groups.values())) == sorted([[0, 4, 10], [1], [2, 7, 8, 14], [3], [5], [6], [9], [11], [12], [13], [15]])
    assert r.sample.count() == 250 and r.sample.select("row_id").distinct().count() == 244
    last = r.centers.orderBy("cluster_id").collect()
    assert [x["init_row"] for x in last] == [5, 53, 237, 164] and [x["n"] for x in last] == [77, 4, 28, 141] and r.iterations == 2
    assert np.allclose(centers(r), [(65.8806493506, 7.7792207792), (209.665, 11.25), (119.1017857143, 6.4285714286), (19.5297163121, 7.4255319149)])


def test_against_plain_python(spark):
    random.seed(5)
    rows = [(random.gauss(5 * (i % 3), 1), random.gauss(3 * (i % 3), 1)) for i in range(90)]
    want = model.chunked(rows, 3, 30)
    r = chunked.cluster(frame(spark, rows), 3, 30)
    assert {x["centroid_id"]: x["group_id"] for x in r.groups.collect()} == want["groups"]
    assert [x["row_id"] for x in r.sample.orderBy("sel_idx").collect()] == want["rows"]
    assert np.allclose(centers(r), want["centers"]) and r.iterations == want["iterations"]


def test_rows_beyond_the_last_chunk_take_no_part(spark):
    rows = TOY + [(100, 100)] * 3
    r = chunked.cluster(frame(spark, rows), 2, 6)
    assert r.chunks == 2 and max(max(c) for c in centers(r)) < 20


def test_random_variant_is_seeded(spark):
    a, b = (centers(chunked.cluster(frame(spark, TOY), 2, 6, sample="random", seed=3)) for _ in range(2))
    assert a == b
    with pytest.raises(ValueError):
        chunked.cluster(frame(spark, TOY), 2, 6, sample="other")


def test_distributed_lloyd_agrees_with_the_kernel(spark):
    points = P.named(spark, "/root/testdata/sf0.001", "events2d")
    x = np.array([r["features"] for r in points.orderBy("row_id").collect()])
    start = kernel.farthest_first(x, 4, 1)
    assert [i for i, _ in lloyd.farthest_first(points, 4)] == start == [1, 288, 800, 682]
    c, cluster, done = kernel.lloyd(x, x[start])
    found, passes = lloyd.lloyd(points, x[start].tolist())
    assert done == passes == 18 and np.allclose(found, c)
    assert np.bincount(cluster).tolist() == [288, 22, 141, 549] and math.isclose(kernel.energies(x, c, cluster).sum(), 256675.287219, rel_tol=1e-9)


def test_too_few_points(spark):
    same = frame(spark, [(1, 1)] * 4)
    with pytest.raises(kernel.TooFewPoints):
        lloyd.farthest_first(same, 2)
    with pytest.raises(kernel.TooFewPoints):
        kernel.farthest_first(np.ones((4, 2)), 2, 1)
    with pytest.raises(kernel.TooFewPoints):
        lloyd.farthest_first(frame(spark, TOY).where("false"), 2)


def test_ties_nan_and_empty_clusters(spark):
    points = frame(spark, [(0, 0), (2, 0)])
    near = A.assign(points, [(1, 0), (1, 0), (float("nan"), 0)])
    assert {r["cluster_id"] for r in near.collect()} == {0}
    stats = {r["cluster_id"]: r for r in A.centroids(near, 3, 2).collect()}
    assert stats[0]["n"] == 2 and stats[1]["n"] == 0 and all(math.isnan(v) for v in stats[1]["center"])
    none = A.assign(points, [(float("nan"), 0)]).collect()
    assert [r["cluster_id"] for r in none] == [None, None]
    assert grouping.greedy_groups([(0, [float("nan")], 1.0), (1, [0.0], 1.0), (2, [0.5], 0.1)]) == {0: 0, 1: 1, 2: 1}
    assert kernel.assign(np.array([[np.nan, np.nan], [1, 1]])).tolist() == [-1, 0]


def test_leaders_are_not_transitive():
    assert grouping.greedy_groups([(0, [0.0], 1.5), (1, [1.0], 9.0), (2, [2.0], 9.0)]) == {0: 0, 1: 0, 2: 1}


def test_move_keeps_means(spark):
    points = frame(spark, TOY)
    near = A.assign(points, [(0, 0), (10, 10)])
    state = A.centroids(near, 2, 2).select("cluster_id", "n", "center")
    after = {r["cluster_id"]: r for r in A.move(state, TOY[0], 0, 1).collect()}
    own = [p for i, p in enumerate(TOY) if i and p[0] < 5]
    other = [TOY[0]] + [p for p in TOY if p[0] >= 5]
    assert (after[0]["n"], after[1]["n"]) == (5, 7)
    assert np.allclose(after[0]["center"], np.mean(own, axis=0)) and np.allclose(after[1]["center"], np.mean(other, axis=0))


def test_initialisers(spark):
    points = frame(spark, TOY)
    for made in (inits.in_box(points, 3, 2, 7), inits.random_partition(points, 3, 2, 7), inits.random_split(points, 3, 2, 7), inits.random_mixture(points, 3, 2, 7, len(TOY))):
        rows = made.orderBy("cluster_id").collect()
        assert [r["cluster_id"] for r in rows] == [0, 1, 2]
        assert all(0 <= v <= 12 for r in rows for v in r["center"])
    with pytest.raises(ValueError):
        inits.in_box(points, 3, 2, 0)


def test_centers_and_means(spark):
    c = A.centers_frame(frame(spark, TOY), [(1, 0), (-2, 5), (3, 1)])
    assert [r["cluster_id"] for r in C.sort_centers(c).orderBy("rank").collect()] == [2, 0, 1]
    assert C.inter_centroid(c).first()["total"] == 34 + 5 + 41
    assert C.compare(c, c).first()["distance"] == 0
    assert C.dispersion(frame(spark, TOY)) == (10, 244.0)
    m = C.partial_means(frame(spark, TOY), 4, 2)
    assert C.farthest_mean(m, [0, 1, 2]).first()["chunk_id"] == 0
    assert C.farthest_mean(m, [0]).first()["chunk_id"] == 2


def test_memory_estimate(spark):
    found = {r["ratio"]: r["memory_mb"] for r in sweep.sweep(spark, 13_421_800, 10, 10, [1, 10], ["x"]).collect()}
    assert found == {r: math.ceil((13_421_800 // r) * (80 + 80 + 12) / 2**20 + 1.5) + 1 for r in (1, 10)}


def test_empty_points(spark):
    none = frame(spark, TOY).where("false")
    assert A.total_distance(A.assign(none, [(0, 0)])).first()["total"] == 0
    assert [r["n"] for r in A.member_counts(A.assign(none, [(0, 0)]), 2).collect()] == [0, 0]
    assert P.marks(none, 5).count() == 0
    assert A.summary(A.assign(none, [(0, 0)]), 1).count() == 2


def test_groups_in_blocks_are_groups_in_one_pass(spark):
    random.seed(9)
    rows = [(i, [random.gauss(0, 3), random.gauss(0, 3)] if i % 17 else [float("nan")] * 2, random.choice((0.0, 0.2, 1.0, 6.0))) for i in range(400)]
    frame_ = spark.createDataFrame(rows, "centroid_id long, center array<double>, var double").repartition(5)
    want = grouping.greedy_groups(rows)
    for most in (1000, 400, 399, 60, 7):
        assert {r["centroid_id"]: r["group_id"] for r in grouping.group_map(frame_, most).collect()} == want


def test_farthest_against_the_model(spark):
    random.seed(10)
    rows = [[random.choice((0, 1, 2, 3)) for _ in range(3)] for _ in range(300)] + [[float("nan")] * 3, [3, 3, 3], [3, 3, 3]]
    points = frame(spark, rows, 4).union(spark.createDataFrame([(500, None)], "row_id long, features array<double>"))
    found, valid = lloyd.farthest_first(points, 6), [r for r in rows if r[0] == r[0]]
    assert [i for i, _ in found] == [i if i < 300 else i + 1 for i in model.init(valid, 6, 1)] and found[0] == (1, rows[1])
    assert lloyd.farthest(points.where("row_id = 302"), [rows[0]])[0] == 302
    assert lloyd.farthest(points.where("row_id = 300"), [rows[0]]) is None
    with pytest.raises(kernel.TooFewPoints):
        lloyd.farthest_first(points.where("row_id > 300"), 3, first=301)


def test_main(spark, tmp_path):
    lines = ["\t".join(f"{v:.16f}" for v in r) for r in TOY]
    (tmp_path / "points.txt").write_text("\n".join(lines) + "\n")
    assert chunked.main([str(tmp_path / "points.txt"), "2", "12", "6", "2", str(tmp_path / "out")]) == 0
    found = sorted([float(v) for v in r["value"].split("\t") if v] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert np.allclose(found, [(0, 1), (32 / 3, 11)])
