"""Queries are matched on the rows of pages: matches aren't shuffled, whatever their number."""

import math
import random

import pytest

from lettermill.operators import search as sr

WORDS = ["ash", "birch", "cedar", "elm", "fir", "or"]


def brute(q, words):
    """(text rank, first hit) of a page, or None; ``words`` is None for a page without a translation."""
    clauses, pieces, text = [], [], words or []
    for piece in [*q.split("|"), "or"]:
        if piece == "or":
            clauses.append(pieces)
            pieces = []
            continue
        wanted = piece.strip('-"').split()
        starts = [i for i in range(len(text)) if text[i:i + len(wanted)] == wanted]
        pieces.append((piece.startswith("-"), len(starts) * len(wanted), starts[0] if starts else None))
    ok = []
    for pieces in clauses:
        if all((n > 0) != negated for negated, n, _ in pieces):
            wanted = [(n, first) for negated, n, first in pieces if not negated]
            ok.append((sum(math.log1p(n) for n, _ in wanted), min((first for _, first in wanted), default=0)))
    return (round(max(r for r, _ in ok), 6), min(f for _, f in ok)) if ok else None


@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_all_kinds_of_queries_as_by_brute_force(spark, monkeypatch, rows):
    """With few rows a broadcast the queries are matched in several parts."""
    monkeypatch.setattr(sr, "NARROW_ROWS", rows)
    rng = random.Random(4)
    pages = [(f"o{d % 2}", d, n, rng.choices(WORDS[:5], k=rng.randrange(9)) if rng.random() < 0.9 else None) for d in range(12) for n in (1, 2)]

    def piece(k):
        mark = "-" if rng.random() < 0.3 else ""
        return mark + (f'"{" ".join(rng.choices(WORDS[:5], k=k))}"' if k > 1 else rng.choice(WORDS[:5] + ["none"]))

    asked = ["ash", "ash|birch", "ash", '"ash birch"', "-ash", "-ash", '-"ash birch"|-elm', "ash|or|birch", "ash|or|-birch", "none", "-none", "none|or|elm", '"ash ash"']
    for _ in range(60):
        asked.append("|or|".join("|".join(piece(rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.choice([1, 2]))) for _ in range(rng.choice([1, 1, 2]))))
    queries = [(i, f"o{i % 2}", q.replace("|", " ")) for i, q in enumerate(asked)] + [(1000 + i, "o0", q.replace("|", " ")) for i, q in enumerate(asked)]
    table = spark.createDataFrame([(d, n, None if w is None else " ".join(w)) for _, d, n, w in pages], "document_id int, page_no int, translated_text string")
    docs = spark.createDataFrame([(d, f"o{d % 2}") for d in range(12)], "document_id int, owner_id string")
    terms = sr.parse_queries(spark.createDataFrame(queries, "query_id int, owner_id string, q string"), english=False)
    matched = sr.match_translated(terms, sr.build_index(table, docs, english=False), table.join(docs, "document_id"))
    got = [(r["query_id"], r["document_id"], r["page_no"], round(r["text_rank"], 6), r["first_hit"]) for r in matched.collect()]
    want = {(i, d, n, *found) for i, owner, _ in queries for o, d, n, words in pages if o == owner
            for found in [brute(asked[i % 1000], words)] if found}
    assert set(got) == want and len(got) == len(want) > 500


def test_matches_are_not_shuffled(spark):
    rows = [("o1", 1, page, place, word) for page in range(40) for place, word in enumerate(WORDS[: page % 6])]
    postings = spark.createDataFrame(rows, "owner_id string, document_id int, page_no int, position int, token string")
    pages = postings.select("owner_id", "document_id", "page_no").distinct()
    queries = [(i, "o1", q) for i, q in enumerate(["ash", "ash birch", "-elm", "ash or elm", "-ash or elm", '"ash birch"'] * 20)]
    terms = sr.parse_queries(spark.createDataFrame(queries, "query_id int, owner_id string, q string"), english=False)
    matched = sr.match_translated(terms, postings, pages)
    n = len(matched.collect())
    plan = matched._jdf.queryExecution().executedPlan()
    shuffled, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name == "Exchange":
                shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    # Pages and their lists of negations that they break, but none of the matches.
    assert n > 2500 and max(shuffled) <= 2 * 40


def test_search_neither_stores_nor_shuffles_what_is_found(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "o1", "First", 1980, ["family"])], "document_id int, owner_id string, title string, year int, tags array<string>")
    pages = spark.createDataFrame([(1, n, f"a page of ash and other trees, number {n}", "ash " * (1 + n // 60)) for n in range(120)],
                                  "document_id int, page_no int, original_text string, translated_text string")
    queries = spark.createDataFrame([(1, "o1", "ash", None, None, 50)], "query_id int, owner_id string, q string, tag string, year int, limit int")
    stored, pin = [], sr.pin
    monkeypatch.setattr(sr, "pin", lambda df: stored.append(pin(df)) or stored[-1])
    rows = sr.search(queries, pages, docs, english=False).collect()
    # 120 pages are found on both sides; only those within reach are kept with their text rank.
    kept = [df for df in stored if "text_rank" in df.columns]
    assert [df.count() for df in kept] == [60] and sorted(r["page_no"] for r in rows) == list(range(60, 110))
