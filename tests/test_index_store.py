import random

import pytest
from pyspark.sql import functions as F

from lettermill.operators import index_store, search as sr


@pytest.fixture(scope="module")
def letters(spark):
    rng = random.Random(5)
    rows = [(d, p, "".join(rng.choice("aabÇ 😀%") for _ in range(rng.randint(0, 60)))) for d in range(12) for p in (1, 2)]
    rows += [(20, 1, "aaaaaaaaaa"), (20, 2, None), (21, 1, ""), (21, 2, "x"), (22, 1, "xy")]
    docs = spark.createDataFrame([(d, f"o{d % 3}") for d in (*range(12), 20, 21, 22)], "document_id int, owner_id string")
    return docs, rows


def asked(rows, n=60):
    rng = random.Random(6)
    texts = [t for *_, t in rows if t and len(t) > 12]
    cuts = [(t, rng.randrange(len(t) - 2), rng.randint(2, 11)) for t in (rng.choice(texts) for _ in range(n))]
    qs = [t[at:at + size].upper() if size % 2 else t[at:at + size] for t, at, size in cuts]
    qs += ["aaaa", "aaaaaaaaaaa", "aaaaaaaaaa", "xy", "a", "%%", "zzz", "ab" * 90, "açx"]
    return [(i, f"o{i % 3}", q) for i, q in enumerate(qs)]


def brute(rows, queries):
    return sorted((i, d, p) for i, owner, q in queries if len(q) > 1 for d, p, t in rows
                  if f"o{d % 3}" == owner and t is not None and q.lower() in t.lower())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_gram_index_finds_every_substring_and_follows_edits(spark, letters, tmp_path):
    docs, rows = letters
    schema = "document_id int, page_no int, original_text string"
    queries = asked(rows)
    q = spark.createDataFrame([*queries, (999, "o1", None)], "query_id int, owner_id string, q string")
    sr.create_gram_index(spark.createDataFrame(rows, schema), docs, str(tmp_path))
    assert found(sr.match_gram_index(q, str(tmp_path))) == brute(rows, queries)

    changed = [(d, p, (t or "") + "aaab" if d % 2 else None) for d, p, t in rows if p == 1]
    sr.update_gram_index(spark.createDataFrame(changed, schema), docs, str(tmp_path))
    index_store.merge(spark, f"{tmp_path}/grams", "head")
    now = [*changed, *(r for r in rows if r[1] != 1)]
    assert found(sr.match_gram_index(q, str(tmp_path))) == brute(now, queries) != brute(rows, queries)


def test_store_keeps_current_and_writes_changed_buckets_only(spark, tmp_path):
    path, schema = str(tmp_path), "document_id int, page_no int, token string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    first = [(d, 1, w) for d in range(6) for w in ("alpha", "beta", f"w{d}")]
    index_store.create(make(first), path, "token", buckets=8)
    assert found(index_store.read(spark, path, buckets=8)) == sorted(first)

    second = [(0, 1, "gamma"), (7, 1, "alpha")]
    gone = spark.createDataFrame([(0, 1), (1, 1), (7, 1), (7, 1)], "document_id int, page_no int")
    assert index_store.apply_changes(make(second), gone, path, "token", buckets=8) == 1
    now = sorted([r for r in first if r[0] > 1] + second)
    assert found(index_store.read(spark, path, buckets=8)) == now
    bucket = lambda w: spark.createDataFrame([(w,)], "token string").select(index_store.bucket_of("token", 8)).first()[0]
    touched = sorted({bucket("gamma"), bucket("alpha")})
    written = spark.read.parquet(f"{path}/postings").filter("version = 1").select("bucket").distinct()
    assert sorted(r[0] for r in written.collect()) == touched

    merged = index_store.merge(spark, path, "token", buckets=8)
    assert bucket("alpha") in merged and set(merged) <= set(touched)
    assert found(index_store.read(spark, path, buckets=8)) == now and index_store.merge(spark, path, "token", buckets=8) == []
    assert index_store.apply_changes(make([]), spark.createDataFrame([(7, 1)], "document_id int, page_no int"), path, "token", buckets=8) == 3
    assert found(index_store.read(spark, path, buckets=8)) == [r for r in now if r[0] != 7]

    # A version without its last row was never finished.
    make([(9, 9, "alpha")]).withColumn("bucket", F.lit(bucket("alpha"))).write.partitionBy("bucket").parquet(f"{path}/postings/version=4")
    keys = spark.createDataFrame([("alpha",)], "token string")
    only = index_store.read(spark, path, keys, buckets=8)
    assert (9, 9, "alpha") not in found(only) and {bucket(t) for *_, t in found(only)} == {bucket("alpha")}
    index_store.apply_changes(make([(9, 9, "beta")]), spark.createDataFrame([(9, 9)], "document_id int, page_no int"), path, "token", buckets=8)
    assert [r for r in found(index_store.read(spark, path, buckets=8)) if r[0] == 9] == [(9, 9, "beta")]


def test_empty_store(spark, tmp_path):
    none = spark.createDataFrame([], "document_id int, page_no int, original_text string")
    docs = spark.createDataFrame([(1, "o1")], "document_id int, owner_id string")
    sr.create_gram_index(none, docs, str(tmp_path))
    q = spark.createDataFrame([(1, "o1", "abc"), (2, "o1", "ab")], "query_id int, owner_id string, q string")
    assert found(sr.match_gram_index(q, str(tmp_path))) == []


def test_search_uses_a_stored_gram_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "o1", "First", 1980, ["family"])], "document_id int, owner_id string, title string, year int, tags array<string>")
    pages = spark.createDataFrame([(1, 1, "Mixed CASE text", "nothing"), (1, 2, "other", "a mixed case")],
                                  "document_id int, page_no int, original_text string, translated_text string")
    q = spark.createDataFrame([(1, "o1", "mixed case", None, None, None)], "query_id int, owner_id string, q string, tag string, year int, limit int")
    sr.create_gram_index(pages, docs, str(tmp_path))
    plain, stored = (sorted(map(str, sr.search(q, pages, docs, grams_path=g).collect())) for g in (None, str(tmp_path)))
    assert plain == stored and len(plain) == 2


def test_matches_of_short_queries_are_not_shuffled(spark, letters, tmp_path):
    docs, rows = letters
    pages = spark.createDataFrame(rows, "document_id int, page_no int, original_text string")
    sr.create_gram_index(pages, docs, str(tmp_path))
    queries = [(1, "o0", "aa"), (2, "o0", "aaa"), (3, "o0", "aab"), (4, "o0", "aaaa")]
    matched = sr.match_gram_index(spark.createDataFrame(queries, "query_id int, owner_id string, q string"), str(tmp_path))
    # Nothing is aggregated above the union of the three kinds of queries.
    assert matched._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert found(matched) == brute(rows, queries)


def test_places_of_long_queries_are_not_shuffled(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(d, "o1") for d in range(30)], "document_id int, owner_id string")
    rows = [(d, 1, "abcabcabd" * 4) for d in range(30)]
    sr.create_gram_index(spark.createDataFrame(rows, "document_id int, page_no int, original_text string"), docs, str(tmp_path))
    queries = [(i, "o1", q) for i, q in enumerate(["abcab", "bcabd", "ABDA", "cabdabca", "abcabcabcab", "ab", "bda"] * 9)]
    q = spark.createDataFrame(queries, "query_id int, owner_id string, q string")
    for limit in (1_000_000, 2):
        monkeypatch.setattr(sr, "NARROW_ROWS", limit)
        matched = sr.match_gram_index(q, str(tmp_path))
        assert found(matched) == sorted((i, d, 1) for i, _, text in queries for d, _, t in rows if text.lower() in t)
        plan = matched._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan and "SortMergeJoin" not in plan.split("== Initial Plan ==")[0]
