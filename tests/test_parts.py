"""Registered streams over tables of several files."""

import __spark_entry__ as contract
from lettermill.operators import limits
from lettermill.plans.common import view
from lettermill.functions.text import word_count


def test_a_part_of_several_files_is_one_micro_batch(spark, tmp_path):
    documents = spark.range(600).selectExpr("id AS doc_id", "repeat('word ', 100) AS text", "'en' AS lang", "'src' AS source", "500L AS n_chars")
    documents.repartition(4, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    found = contract.queries()["b4_claim_budget_stream"](spark, str(tmp_path)).collect()
    claims = view(spark, str(tmp_path), "word_claim").withColumn("words", word_count("text"))
    assert {r["claim_id"]: r["granted"] for r in found} == {
        r["claim_id"]: r["granted"] for r in limits.claim_budget(claims, cap=3000).collect()}
