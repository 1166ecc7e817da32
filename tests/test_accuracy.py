import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions.similarity import edit_distance
from lettermill.operators import accuracy


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_edit_distance_matches_the_table():
    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choice("abcि") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abcि") for _ in range(rng.randint(0, 40)))
        assert edit_distance(a, b) == brute_distance(a, b)
    long = [str(rng.randint(0, 9)) for _ in range(300)]
    other = [w for w in long if rng.random() > 0.1] + ["x"]
    assert edit_distance(long, other) == brute_distance(long, other)


@pytest.mark.parametrize("reference,hypothesis,cer,wer", [
    ("same text", "same  text ", 0.0, 0.0), ("abcdefghij", "abcdefghiX", 0.1, 1.0), ("कि", "क", 0.5, 1.0), ("", "", 0.0, 0.0), ("", "x", 1.0, 1.0),
    ("ab", "abcdef", 2.0, 1.0), ("one two three", "one two four", 5 / 13, 1 / 3), ("café", "café", 0.0, 0.0)])
def test_rates(spark, reference, hypothesis, cer, wer):
    pair = spark.createDataFrame([(1, reference, hypothesis)], "sample_id int, reference string, hypothesis string")
    got = accuracy.score(pair).first()
    assert (round(got["cer"], 6), round(got["wer"], 6)) == (round(cer, 6), round(wer, 6))


def test_report_and_micro_average(spark):
    rows = [(1, "hi", "abcd", "abcx", None), (2, "hi", "ab", "ab", None), (3, "ta", "abcd", "", "timeout")]
    results = spark.createDataFrame(rows, "sample_id int, language string, reference string, hypothesis string, error string")
    report = accuracy.accuracy_report(results)
    assert {r["sample_id"]: r["cer"] for r in report.collect()} == {1: 0.25, 2: 0.0, 3: None}
    micro = {r["language"]: (r["images"], r["errors"], r["micro_cer"]) for r in accuracy.micro_cer(report).collect()}
    assert micro == {"hi": (2, 1, round(1 / 6, 6)), "all": (2, 1, round(1 / 6, 6))}
    nothing = accuracy.micro_cer(report.filter(F.col("sample_id") == 3)).collect()
    assert [(r["language"], r["micro_cer"]) for r in nothing] == [("all", None)]
