"""Every core query with SQL against DuckDB on the smallest tables, and the entry module."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from cairn import queries as core
from cairn.sources import points as P
from tests import model

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_core_query(spark, db, name):
    found = core.queries()[name](spark, SF)
    want = db.execute(core.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql()) - {"lloyd_converged"}))
def test_core_query_without_sql(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def events_of(spark, path, values):
    rows = [(i, v, 0) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, value double, user_id long").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_total_distance_skips_only_unassigned_points(spark, tmp_path):
    """Centers 0, 10, 20 and 30; a point 200 away counts, a NaN and a null do not."""
    sf = events_of(spark, tmp_path, [0.0, 10.0, 20.0, 30.0, 13.0, 230.0, float("nan"), None])
    assert core.queries()["total_distance_all"](spark, sf).first()["total"] == 9 + 200**2


def test_copied_assignment_has_every_point(spark, tmp_path):
    sf = events_of(spark, tmp_path, [0.0, 10.0, 20.0, 30.0, 13.0, 230.0])
    found = core.queries()["copied_assignment_all"](spark, sf).orderBy("row_id").collect()
    assert [tuple(r) for r in found] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 1, 4), (5, 3, 5)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(core.queries()) <= set(__spark_entry__.queries())


def values_of(spark, name):
    return [list(r["features"]) for r in P.named(spark, SF, name).orderBy("row_id").collect()]


@pytest.mark.parametrize(("query", "name", "k"), [("single_kmeans", "customer2d", core.K), ("embedding_kmeans", "embed64", 10)])
def test_single_chunk_against_the_model(spark, query, name, k):
    x = values_of(spark, name)
    start = model.init(x, k, 1)
    centers, cluster, done = model.lloyd(x, [x[i] for i in start])
    found = core.queries()[query](spark, SF).orderBy("cluster_id").collect()
    assert [r["init_row"] for r in found] == start and {r["iterations"] for r in found} == {done}
    assert [r["n"] for r in found] == [cluster.count(j) for j in range(k)]
    sse = [sum(model.d2(p, centers[j]) for p, c in zip(x, cluster) if c == j) for j in range(k)]
    assert np.allclose([r["sse"] for r in found], sse, atol=1e-3)


def test_kmeans_of_kmeans_against_the_model(spark):
    x, k = values_of(spark, "events2d"), core.K
    t, means = len(x) // 4, []
    for c in range(4):
        part = x[c * t : (c + 1) * t]
        means += model.lloyd(part, [part[i] for i in model.init(part, k, c + 1)])[0]
    start = np.random.default_rng(0).choice(len(means), size=k, replace=False)
    want = model.lloyd(means, [means[i] for i in start])[0]
    found = core.queries()["kmeans_of_kmeans"](spark, SF).orderBy("cluster_id").collect()
    values = [[v for c, v in sorted(r.asDict().items()) if c != "cluster_id"] for r in found]
    assert np.allclose(np.array(values)[:, : len(want[0])], want, atol=1e-3)


def test_without_the_optional_subpackage(tmp_path):
    """Its two folders gone: the entry module gives the core queries, and every other module can be imported."""
    root = Path(__spark_entry__.__file__).resolve().parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e, bench, cairn.plans.chunked; from cairn import queries as c; assert set(e.queries()) == set(c.queries()) and set(e.oracle_sql()) == set(c.oracle_sql())"
    for gone in (False, True):
        if gone:
            (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, check=True)
