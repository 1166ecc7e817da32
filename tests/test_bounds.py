"""Short cuts give what the whole work would give."""

import random

from pyspark.sql import functions as F

from lettermill.functions.similarity import char_distance, edit_distance, word_distance
from lettermill.operators import ocr_results as results


def by_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_with_common_ends(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(60)]
    for a, b in zip(texts, texts[1:]):
        assert edit_distance("xx" + a + "yy", "xx" + b + "yy") == edit_distance(a, b) == by_table(a, b)
    rows = [("same", "same"), ("", ""), ("ab", "a"), (None, "a"), ("a", None), (None, None), ("a b", "a c")]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = pairs.orderBy("i").select(char_distance("a", "b").alias("c"), word_distance("a", "b").alias("w")).collect()
    assert [r["c"] for r in got] == [0, 0, 1, None, None, None, 1]
    assert [r["w"] for r in got] == [0, 0, 1, None, None, None, 1]


def test_archives_are_read_once_and_served_by_the_first_strategy(spark):
    entries = [
        (1, "m/page_000.json", 0, '{"markdown": "old"}'), (1, "n/page_000.json", 1, '{"markdown": "new"}'),
        (1, "m/page_002.json", 2, '{"body": "found"}'), (1, "m/page_001.json", 3, '{"n": 1}'), (1, "p/page_009.md", 4, "unused"),
        (2, "m/page_001.json", 0, "no json"), (2, "p/PAGE_005.TXT", 1, "five"), (2, "p/page_007.md", 2, " "), (2, "out.md", 3, "a\n---\nb"),
        (3, "out.md", 0, "a\f b \f"), (3, "small.md", 1, "x"), (4, "out.md", 0, "a\fb"), (5, "scan.png", 0, "x"), (6, "out.md", 0, "a\fb")]
    expected = spark.createDataFrame([(1, 3), (2, 2), (3, 2), (4, 3), (5, 1)], "archive_id int, expected_pages int")
    want = [(1, 1, "new", "page_json"), (1, 3, "found", "page_json"), (2, 1, "five", "page_text"),
            (3, 1, "a", "main_document"), (3, 2, "b", "main_document")]
    as_text = spark.createDataFrame(entries, "archive_id int, entry_name string, entry_pos int, content string")
    as_bytes = as_text.withColumn("content", F.when(F.col("entry_name") == "scan.png", F.unhex(F.lit("FFFE"))).otherwise(F.encode("content", "UTF-8")))
    for table in (as_text, as_bytes):
        parsed = results.parse_archives(table, expected)
        assert sorted(map(tuple, parsed.collect())) == want
        plan = parsed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("entry_name") and plan.count("Union") == 0 and plan.count("LogicalRDD") == 2
