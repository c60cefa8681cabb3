import pytest
from pyspark.sql import functions as F

from cairn.functions import random, text, vectors
from cairn.operators import centers as C
from cairn.sources import logs
from cairn.sources import points as P


@pytest.mark.parametrize(
    ("s", "want"),
    [("1", 1), ("     1   ", 1), ("1A", 1), ("12,34,56", 12), ("  34 7", 34), ("-1E2ABCD", -100), ("-1X2ABCD", -1), (" 2E-1", 0.2), ("23.45", 23.45), ("-4.2E+2", -420), ("17d2", 1700), ("-14e-2", -0.14),
     ("e2", 0), ("-12.73e-9.23", -12.73 * 10**-9.23), (",;5", 5), ("- 3", -3), ("1e-30", 0), ("5.", 5), (".5", 0.5), ("", None), ("abc", None), ("-", None), ("5e", None), ("--5", None)],
)
def test_real(spark, s, want):
    found = spark.range(1).select(text.real(F.lit(s)).alias("v")).first()["v"]
    assert found is None if want is None else found == pytest.approx(want)


def test_reals_and_prefixes(spark):
    r = spark.range(1).select(text.reals(F.lit("1 2.5,x 3"), 3).alias("a"), text.prefix_real(F.lit("1A")).alias("b"), text.prefix_real(F.lit("x")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ([1.0, 2.5, None], 1.0, 0.0)


def test_characters(spark):
    def of(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert of(text.upper_ascii(F.lit("aé1"))) == "Aé1"
    assert of(text.equal_ignoring_case(F.lit("a"), F.lit("A"))) and not of(text.equal_ignoring_case(F.lit("a"), F.lit("b")))
    assert [of(text.digit(F.lit(c))) for c in ("7", "x", " ")] == [7, -1, -1]
    assert of(text.trimmed_length(F.lit("ab \n "))) == 2
    assert of(text.word_count(F.lit(" a\tb c\n\nd "))) == 3


def test_generator(spark):
    n = F.col("id") + 1
    rows = spark.range(3).select(random.state(12345, n).alias("s"), random.uniform(12345, n).alias("r"), random.uniform_int(12345, n, 9, -3).alias("i")).orderBy("id").collect()
    assert [r["s"] for r in rows] == [207482415, 1790989824, 2035175616]
    assert [r["r"] for r in rows] == pytest.approx([0.096616, 0.833995, 0.947702], abs=1e-6)
    s = 99
    for i in range(1, 1001):
        s = s * 16807 % 2147483647
    assert spark.range(1).select(random.state(99, F.lit(1000).cast("long")).alias("s")).first()["s"] == s
    draws = [r["i"] for r in spark.range(500).select(random.uniform_int(7, n, -2, 3).alias("i")).collect()]
    assert set(draws) == {-2, -1, 0, 1, 2, 3}


def test_vectors(spark):
    a, b = vectors.vector([1, -2, 3]), vectors.vector([2, 2, 2])
    r = spark.range(1).select(
        vectors.sq_distance(a, b).alias("d"), vectors.sq_distance(a, b, 3).alias("e"), vectors.dot(a, b).alias("o"), vectors.total(a).alias("t"), vectors.min_index(a).alias("m"),
        vectors.min_index(F.array().cast("array<double>")).alias("z"), vectors.any_negative(a).alias("n"), vectors.all_nonpositive(a).alias("p"), vectors.constant(2, -1).alias("c"),
        vectors.sq_distance(F.array_repeat(F.lit(1.0), 100), [0.0] * 100).alias("w"),
    ).first()
    assert (r["d"], r["e"], r["o"], r["t"], r["m"], r["z"], r["n"], r["p"], r["c"], r["w"]) == (18, 18, 4, 2, 1, -1, True, False, [-1, -1], 100)
    four = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert four.agg(F.sum("v")).first()[0] == 10
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "i int, j int, v double")
    assert {(r["i"], r["j"]): r["v"] for r in vectors.matmul(m, m).collect()} == {(0, 0): 7, (0, 1): 2, (1, 0): 3, (1, 1): 6}


def test_text_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1\t2\n\n# no\n3\tx\t\n1A\t-2e1\n")
    lines = P.numbered_lines(spark, str(tmp_path / "p.csv"))
    assert [r["row_id"] for r in lines.orderBy("row_id").collect()] == list(range(5))
    assert P.row_count(lines).first()["n_rows"] == 3
    assert P.column_count(lines, "\t").first()["n_columns"] == 2
    assert tuple(P.header(lines, "\t").first()) == (2, 3)
    kept = P.from_text(spark, str(tmp_path / "p.csv"), skip=True).orderBy("row_id").collect()
    assert [(r["row_id"], r["features"]) for r in kept] == [(0, [1, 2]), (1, [3, 0]), (2, [1, -20])]


def test_column_count_of_odd_files(spark):
    of = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "row_id long, value string")
    assert P.column_count(of("# a b")).first()["n_columns"] == 3
    assert P.column_count(of()).first()["n_columns"] == -1
    assert P.column_count(of("", "a b", "c")).first()["n_columns"] == 2


def test_many_files_keep_their_order(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part-{f}.txt").write_text("".join(f"{f}\t{i}\n" for i in range(50 * (f + 1))))
    rows = P.from_text(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [tuple(r["features"]) for r in rows] == [(f, i) for f in range(3) for i in range(50 * (f + 1))]
    assert [r["row_id"] for r in rows] == list(range(300))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, -2.0]), (0, [1.0, 3.25])], "row_id long, features array<double>")
    P.write_text(rows, str(tmp_path / "c"), "row_id")
    back = P.from_text(spark, str(tmp_path / "c")).orderBy("row_id").collect()
    assert [r["features"] for r in back] == [[1.0, 3.25], [0.5, -2.0]]
    assert {r["value"] for r in P.as_text(rows).collect()} == {"0.5000000000000000\t-2.0000000000000000\t", "1.0000000000000000\t3.2500000000000000\t"}
    assert [r["value"] for r in P.ints_as_text(rows, "row_id").collect()] == ["  1", "  0"]
    for e in (1.5, 2.5):
        P.log_error(spark, str(tmp_path / "e"), 10, 2, 3, e)
    assert spark.read.csv(str(tmp_path / "e")).count() == 2
    (tmp_path / "s.txt").write_text("1\n2\n3\n4\n")
    assert [r["center"] for r in C.read_solution(spark, str(tmp_path / "s.txt"), 2).orderBy("cluster_id").collect()] == [[1, 2], [3, 4]]


def test_logs(spark, tmp_path):
    (tmp_path / "l.csv").write_text('"AbsoluteTime","Phase","Step","Loop","Iteration","Frequency"\n1000,1,1,0,-1,2900000\n1500,*,*,*,*,5\n')
    read = logs.read(spark, str(tmp_path / "l.csv")).orderBy("AbsoluteTime").collect()
    assert read[0]["Phase"] == 1 and read[1]["Phase"] is None and read[0]["Read_Kbps"] is None
    (tmp_path / "s.csv").write_text("5,0.5,1.25\n")
    assert tuple(logs.read_scheduler(spark, str(tmp_path / "s.csv")).first()) == (5, 0.5, 1.25)
    made = logs.events(spark, [(100, 1, 1, 0, -1), (350, 1, 2, 0, 0)]).withColumn("run", F.lit(1))
    assert [r["duration_ms"] for r in logs.durations(made, "run").orderBy("AbsoluteTime").collect()] == [None, 250]
    both = logs.in_order(logs.stack(made, spark.createDataFrame([(200, 0.5)], "AbsoluteTime long, CPU_Usage double")))
    assert [r["AbsoluteTime"] for r in both.collect()] == [100, 200, 350]
    logs.append(made.drop("run"), str(tmp_path / "out"))
    assert logs.read(spark, str(tmp_path / "out")).count() == 2
