import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import whitening
from lettermill.llm.whitening import bidiagonal, directions, squared_singular_values, whiten

FOLDER = "/root/testdata/sf0.01"


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 9, 40):
        a = rng.standard_normal((3 * n, n))
        yield a
        yield np.round(a)
        yield a * 10.0 ** rng.uniform(-6, 6, n)
        yield np.vstack([np.eye(n)] * 3)
        yield np.hstack([a, np.zeros((3 * n, n)), a])


@pytest.mark.parametrize("a", list(matrices()))
def test_solver(a):
    n = a.shape[1]
    triangle = np.zeros((n, n))
    r = np.linalg.qr(a, mode="r")
    triangle[:len(r)] = r
    diagonal, above, right = bidiagonal(triangle)
    assert np.abs(right.T @ right - np.eye(n)).max() < 1e-13
    want = np.linalg.svd(triangle, compute_uv=False)
    assert np.abs(np.sqrt(squared_singular_values(diagonal, above)) - want).max() < 1e-14 * n * want[0] + 1e-300
    values, vectors = directions(triangle, 4)
    assert len(values) == min(4, int((want > 1e-12 * want[0]).sum()))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(triangle.T @ (triangle @ vectors) - vectors * values) < 1e-13 * n * want[0] ** 2


def test_small_values_keep_their_digits():
    diagonal = 10.0 ** -np.arange(0, 60, 6.0)
    above = diagonal[1:] * 1e-7
    assert squared_singular_values(diagonal, above) == pytest.approx(diagonal ** 2, rel=1e-10, abs=0)


def test_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x = np.array([[int(np.floor(256 * float(c))) for c in r["embedding"]] for r in rows])
    unique = np.unique(x, axis=0)
    n, sums = len(unique), unique.sum(axis=0)
    centred = (unique * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    want = (x * n - sums) / n @ vectors[:, order] / np.sqrt(values[order])
    got = whiten(table).orderBy("vec_id", "component").collect()
    assert [(r["vec_id"], r["component"]) for r in got] == [(r["vec_id"], c) for r in rows for c in range(1, 5)]
    white = np.array([r["whitened"] for r in got]).reshape(-1, 4)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    assert [r["deviation"] for r in got[::4]] == ((x * n - sums) ** 2).sum(axis=1).tolist()
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert [r["explained"] for r in got[:4]] == pytest.approx((values[order] / values.sum()).tolist(), rel=1e-12)


def test_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    few = whiten(table).orderBy("vec_id", "component").collect()
    many = whiten(table.repartition(9)).orderBy("vec_id", "component").collect()
    assert [abs(r["whitened"]) for r in many] == pytest.approx([abs(r["whitened"]) for r in few], abs=1e-9)


def test_odd_rows(spark):
    good = [(i, [float(i % 3), float(i % 5) / 256, 1.0]) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]),
           (None, [0.5, 0.5, 0.5]), (106, [0.5, 0.5, 0.5])]
    table = spark.createDataFrame(good + odd, "vec_id int, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("id", F.lit(0))
    rows = whiten(table).collect()
    assert len(rows) == 32 * 3 and {r["vec_id"] for r in rows} == {*range(30), None, 106} and {r["n"] for r in rows} == {16}
    assert all(r["identity_error"] < 1e-9 for r in rows)
    assert whiten(table.limit(0)).collect() == [] and whiten(table.filter("vec_id >= 100 and vec_id < 105")).collect() == []
    # All alike: no direction is left; on one line: one.
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id int, embedding array<float>")).collect() == []
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id int, embedding array<float>")).collect()
    assert len(line) == 9 and line[0]["explained"] == pytest.approx(1)
    huge = spark.createDataFrame([(1, [3e12, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 6.0])], "vec_id int, embedding array<double>")
    rows = {(r["vec_id"], r["component"]): r["deviation"] for r in whiten(huge).collect()}
    assert set(rows.values()) == {None} and len(rows) == 3 * 2 or rows[1, 1] is None
