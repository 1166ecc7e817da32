import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import top_k as tk
from lettermill.llm.queries import TOP_K_SQL, op3_exact_top_k


def best(rows, k=10, scale=1024):
    """Every query against every row."""
    whole = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(x * scale) for x in v]
        whole[i] = min(w, whole.get(i, w))
    out = []
    for q, v in whole.items():
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, tk.top_k(df, F.col("id") % 100 == 0, vector="embedding").select("query_id", "rank", "vec_id", "score").collect()))


def test_grouped_vectors(spark, monkeypatch):
    """Clusters, one vector that a third of all rows repeat, ties; small nodes, so that trees and blocks matter."""
    for name, value in (("SAMPLE", 64), ("BLOCK", 40), ("LEAF", 8), ("FAN", 4)):
        monkeypatch.setattr(tk, name, value)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(centres)]) for i in range(500)]
    rows += [(i, centres[0]) for i in range(500, 750)] + [(-i, [0.0] * 6) for i in range(0, 300, 100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(df) == best(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, -2.5]), (None, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []),
            (6, [0.5]), (7, [1e9, 1.0]), (100, [3.0, 4.0, 5.0]), (100, [3.0, 4.0, 5.0]), (100, [9.0, 9.0, 9.0]), (8, [0.0001, -0.0001])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    assert found(df) == best(rows)
    assert found(df.limit(0)) == [] and found(df.filter("vec_id = 0")) == []


def test_query_keeps_rows_of_one_id_as_its_sql_does(spark, monkeypatch, tmp_path):
    """A third of all rows have one id, some of them equal; queries repeat as well."""
    for name, value in (("SAMPLE", 64), ("BLOCK", 40), ("LEAF", 8), ("FAN", 4)):
        monkeypatch.setattr(tk, name, value)
    rng = random.Random(5)
    ids = [*range(300), *range(0, 300, 50), 100, 100, *[7] * 150]
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        wanted = con.execute(TOP_K_SQL).fetchall()
    got = op3_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and any(r[2] == 7 for r in wanted)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 5)), rng.normal(size=(400, 5))
    pending = [(tk.Node(a), tk.Node(b))]
    while pending:
        x, y = pending.pop()
        assert (a[x.places] @ b[y.places].T).max() <= tk.bound(x, y)
        pending += [(c, y) for c in x.children] + [(x, c) for c in y.children][:3]


@pytest.mark.parametrize("n", [1, 129, 1000])
def test_trees_cover_every_row_once(n):
    points = np.random.default_rng(n).normal(size=(n, 3))

    def leaves(node):
        assert (np.linalg.norm(points[node.places] - node.centre, axis=1) <= node.radius + 1e-12).all()
        return [node.places] if not node.children else [p for c in node.children for p in leaves(c)]

    assert sorted(np.concatenate(leaves(tk.Node(points)))) == list(range(n))


def test_vectors_are_never_broadcast(spark):
    """Packed rows repeat under a small estimate, so a broadcast of them would grow with the queries in the driver."""
    rows = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> sin(id * i)) AS embedding")
    ranked = tk.top_k(rows, F.col("id") % 100 == 0)
    assert ranked.count() == 300
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(line)), len(plan))
            assert not any("vectors" in x for x in plan[i:below]), plan[i:below]
    assert any("SortMergeJoin" in x for x in plan)
