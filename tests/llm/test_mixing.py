import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lettermill.llm import mixing
from lettermill.llm.mixing import Flight, _draws, mix

FOLDER = "/root/testdata/sf0.01"


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Shared by weight, what is above a cap reshared among the others until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    wanted, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = wanted - sum(cap * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        above = {s for s in free if rest * weight[s] / total > cap * sizes[s] + 1e-9}
        if not above:
            return {s: cap * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        capped |= above


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in docs.collect()]
    rows = mix(docs).collect()
    assert sorted((r["doc_id"], r["source"], r["size"]) for r in rows) == sorted(texts)
    sizes, numbers = Counter(), Counter()
    for _, source, size in texts:
        sizes[source] += size
        numbers[source] += 1
    want, taken, copies = targets(sizes), Counter(), Counter()
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert int(r["target"] / r["source_size"] + 1e-9) <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        copies[r["source"]] += r["copies"]
    for source, target in want.items():
        # Fifty documents a source, some of them long.
        assert abs(taken[source] - target) < 0.08 * target
        assert abs(copies[source] - target / sizes[source] * numbers[source]) < 2.01
    again = mix(docs.repartition(7, "text").select("source", "text", "doc_id", F.lit(1).alias("size"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_many_blocks_come_to_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BLOCK", 50)
    units = spark.range(5000).select(
        F.lit(0).cast("long").alias("place"), (F.col("id") % 97 + 1).alias("size"), F.xxhash64("id").alias("tie"), F.lit(0.3).alias("p"))
    drawn = mixing.balanced(units, per_block=50).collect()
    total = sum(r["size"] for r in units.collect())
    assert len(drawn) == 5000 and {r["p"] for r in drawn} == {0.0, 1.0}
    assert abs(sum(r["p"] * r["size"] for r in drawn) - 0.3 * total) <= 4 and abs(sum(r["p"] for r in drawn) - 1500) <= 2


def test_flight_keeps_totals_and_probabilities():
    sizes, p = [900, 40, 40, 37, 20, 11, 5, 5, 1, 0, 0], 0.35
    times, n = defaultdict(int), 4000
    for seed in range(n):
        flight, draws, taken = Flight(4), _draws(seed * 7919), []
        for i, size in enumerate(sizes):
            taken += flight.add([p, size, i], draws)
        taken += flight.settle(draws)
        left = flight.held
        assert len(left) <= 2
        assert sum(u[0] for u in taken + left) == pytest.approx(p * len(sizes), abs=1e-5)
        assert sum(u[0] * u[1] for u in taken + left) == pytest.approx(p * sum(sizes), abs=1e-2)
        for unit in taken + flight.land(draws):
            assert unit[0] in (0.0, 1.0)
            times[unit[2]] += unit[0]
    # Four standard deviations.
    assert all(abs(times[i] / n - p) < 0.031 for i in range(len(sizes)))


def test_odd_rows(spark):
    rows = [(None, "a b", None), (1, None, "s"), (2, "", "s"), (3, "x " * 30_000, "s"), (4, "   y", ""), (4, "   y", "")]
    rows += [(5, "one two three", "t")] * 40
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = mix(docs.withColumn("taken", F.lit("clash")).withColumn("p", F.lit(0)).withColumn("chunk", F.lit(1))).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    sizes = {r["source"]: r["source_size"] for r in out}
    assert sizes == {None: 2, "s": 30_000, "": 4, "t": 120}
    want = targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in out)
    copies = [r["copies"] for r in out if r["source"] == "t"]
    assert abs(sum(copies) - 40 * want["t"] / 120) < 1
    assert mix(docs.limit(0)).collect() == []
    assert {(r["size"], r["copies"], r["target"]) for r in mix(docs.filter("doc_id in (1, 2)")).collect()} == {(0, 0, 0.0)}


def test_many_equal_rows_and_sources(spark, monkeypatch):
    docs = spark.range(30_000).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 20_000, "hot").otherwise(
        F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"))
    whole = mix(docs).collect()
    monkeypatch.setattr(mixing, "FEW_BYTES", 0)
    assert sorted(map(tuple, mix(docs).collect())) == sorted(map(tuple, whole))
    want, taken = {r["source"]: r["target"] for r in whole}, Counter()
    for r in whole:
        taken[r["source"]] += r["taken"]
    assert len(whole) == 30_000 and all(abs(taken[s] - t) <= 3 for s, t in want.items())
