import time
import zlib

import pytest
from pyspark.sql import functions as F

from lettermill.llm import quality as q

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return q.train_quality(*tables)


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    rows = q.score_quality(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 60 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    good, bad = ([r["score"] for r in held if r["quality"] == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_held_out_labels_teach_nothing(tables, model):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(q.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert q.train_quality(docs, turned) == model


def test_scores_follow_the_rules(tables, model):
    import math

    docs, _ = tables
    stats = q.with_statistics(docs.select("doc_id", "text"), "text").collect()
    scores = {r["doc_id"]: r["score"] for r in q.score_quality(docs, model).collect()}
    assert 3 < len(model.rules) < 200
    for r in stats:
        total = model.intercept + sum(rule.weight for rule in model.rules if all(
            (r[f"s_{name}"] <= t) == below for name, below, t in rule.conditions))
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)))


def test_statistics(spark):
    df = spark.createDataFrame([("Aa aa b1\nAa aa b1\n\nX |!", ), (None,)], "text string")
    first, empty = q.with_statistics(df, "text").collect()
    assert first["s_repeat_share"] == pytest.approx(2 / 8) and first["s_distinct_share"] == pytest.approx(4 / 8)
    assert first["s_upper_share"] == pytest.approx(3 / 23) and first["s_same_lines"] == pytest.approx(1 - 2 / 3)
    assert set(empty) == {0.0}


def test_odd_tables(spark, tables, model):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "x", 1.0), (1, None, 2.0), (1, None, 2.0), (2, "y " * 200_000, 3.0)],
                                "doc_id long, text string, score double")
    rows = q.score_quality(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = q.keep_good(odd.withColumn("row", F.lit("clash")).withColumn("_words", F.lit(0)), model)
    good = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["predicted"])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == good
    assert kept.columns == [*odd.columns, "row", "_words"] and q.keep_good(docs.limit(0), model).collect() == []
    assert q.keep_good(docs, model).columns == docs.columns
    assert q.score_quality(docs.limit(0), model).collect() == []
    assert q.train_quality(docs, labels.limit(0)) == q.Model(0.0, ())
    only = q.train_quality(docs, labels.filter("quality = 1"))
    assert only.rules == () and only.intercept > 5


def test_keeping_is_linear_in_text_length(spark, model):
    """A score that the filter works out anew per rule, or an array built once more per word, takes minutes here."""
    texts = spark.createDataFrame([(i, "Word other, word. " * 6_667) for i in range(8)], "doc_id long, text string")
    kept = q.keep_good(texts, model)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("split(") <= 2 and "Generate explode" in plan
    started = time.perf_counter()
    kept.count()
    q.score_quality(texts, model).agg(F.sum("score")).collect()
    assert time.perf_counter() - started < 20
