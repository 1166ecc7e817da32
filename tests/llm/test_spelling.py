import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lettermill.llm import spelling
from lettermill.llm.spelling import group_spellings, near_words, one_edit, text_vocabulary


def neighbours(words):
    """By deleting one letter of every word: what is left meets."""
    words, near, shared = set(words), defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            shared[w[:i], w[i + 1:]].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in shared.values():
        for a in group:
            near[a] |= group - {a}
    return near


def brute_force(vocabulary):
    near, form = neighbours(vocabulary), {}
    for w, n in vocabulary.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-vocabulary[x], x))
            if vocabulary[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), vocabulary[form[w]] if w in form else None) for w, n in vocabulary.items()}


def counted(texts):
    found = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def results(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = counted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(want) > 2000 and results(group_spellings(text_vocabulary(docs))) == brute_force(want)


@pytest.mark.parametrize("parts", [7, 100_000])
def test_crowded_blocks(spark, monkeypatch, parts):
    """Two letters make dense blocks, cut into parts of seven words."""
    monkeypatch.setattr(spelling, "LIST_WORDS", parts)
    words = {f"{i:0{size}b}".replace("0", "a").replace("1", "b"): i % 17 + size for size in range(2, 8) for i in range(2 ** size)}
    table = spark.createDataFrame(list(words.items()), "word string, n int")
    assert results(group_spellings(table)) == {w: v for w, v in brute_force(words).items()}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.text("aàb\U0001f600é", min_size=2, max_size=7), st.integers(1, 50), max_size=60))
def test_any_letters(spark, words):
    table = spark.createDataFrame(list(words.items()), "word string, n int")
    assert results(group_spellings(table)) == brute_force(words)


def test_one_edit():
    def codes(s):
        return np.frombuffer(s.encode("utf-32-le"), "<u4")

    pairs = {("abc", "abc"): False, ("abc", "abd"): True, ("abc", "ab"): True, ("abc", "acb"): False, ("bc", "abc"): True, ("aab", "ab"): True, ("xyc", "abc"): False}
    assert {p: one_edit(codes(p[0]), codes(p[1])) for p in pairs} == pairs


def test_odd_rows(spark):
    long = "ab" * 20_000
    texts = [(None, "Straße Straße straße"), (1, None), (2, ""), (3, "strasse " * 9 + "strase " * 3), (4, f"{long} " * 3), (5, f"{long[1:]}\n{long}x {long}x {long}x " * 3),
             (6, "ÀÉÎÕÜ àéîõü " * 3), (6, "ÀÉÎÕÜ àéîõü " * 3), (7, "x×÷yz " * 4)]
    docs = spark.createDataFrame(texts, "doc_id int, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("key", F.lit(0))
    want = counted(texts)
    got = results(group_spellings(text_vocabulary(docs)))
    assert got == brute_force(want) and any(len(w) > 30_000 for w in got) and "x×÷yz" in got
    assert results(group_spellings(text_vocabulary(docs.limit(0)))) == {}
    odd = spark.createDataFrame([(None, 3), ("", 3), ("a", 3), ("abc", 1), ("abc", 2), ("abd", 6)], "word string, n int")
    assert results(group_spellings(odd)) == {"abc": ("abd", "abd", 3, 1, 6), "abd": (None, "abd", 6, 1, None)}


def test_counts_of_near_words_are_summed_before_the_shuffle(spark):
    table = spark.createDataFrame([("abcde", 3)], "word string, n long")
    plan = near_words(table)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(n_near" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
