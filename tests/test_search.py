import pytest
from pyspark.sql import functions as F

from lettermill.functions.similarity import trigram_similarity
from lettermill.functions.stemming import stem_word
from lettermill.operators import joins, search as sr


@pytest.mark.parametrize("word,stem", [
    ("consigned", "consign"), ("consigning", "consign"), ("consistency", "consist"), ("knackeries", "knackeri"), ("kneeling", "kneel"),
    ("happy", "happi"), ("skies", "sky"), ("dying", "die"), ("generously", "generous"), ("generate", "generat"), ("letters", "letter"),
    ("hopping", "hop"), ("hoping", "hope"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("this", "this"), ("relational", "relat"),
    ("rational", "ration"), ("agreed", "agre"), ("feed", "feed"), ("news", "news"), ("inning", "inning"), ("by", "by"), ("say", "say"),
    ("monastery", "monasteri"), ("controlling", "control"), ("communism", "communism"), ("adoption", "adopt"), ("cease", "ceas")])
def test_stems(word, stem):
    assert stem_word(word) == stem


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(1, "o1", "First", 1980, ["family"]), (2, "o1", "Second", 1981, ["work"]), (3, "o2", "Other", 1980, ["family"])],
                                 "document_id int, owner_id string, title string, year int, tags array<string>")
    pages = spark.createDataFrame(
        [(1, 1, "यह पहला पत्र है", "The quick brown foxes were jumping over the lazy dog in spring."), (1, 2, "दूसरा 100% पन्ना", "A brown dog sleeps; quick notes follow."),
         (2, 1, "Mixed CASE text", "Nothing of interest here."), (2, 2, None, None), (3, 1, "यह पहला पत्र है", "The quick brown fox of somebody else.")],
        "document_id int, page_no int, original_text string, translated_text string")
    return docs, pages


def hits(spark, corpus, q, english=True, **more):
    docs, pages = corpus
    row = {"query_id": 1, "owner_id": "o1", "q": q, "tag": None, "year": None, "limit": None, **more}
    queries = spark.createDataFrame([tuple(row.values())], "query_id int, owner_id string, q string, tag string, year int, limit int")
    return [(r["document_id"], r["page_no"], r["matched_in"]) for r in
            sr.search(queries, pages, docs, english=english).orderBy("place").collect()]


@pytest.mark.parametrize("q,found", [
    ("fox jump", {(1, 1)}), ("brown dog", {(1, 1), (1, 2)}), ('"brown dog"', {(1, 2)}), ('"quick brown"', {(1, 1)}), ("brown -lazy", {(1, 2)}),
    ("lazy or notes", {(1, 1), (1, 2)}), ("lazy spring or interest", {(1, 1), (2, 1)}), ("-brown", {(2, 1), (2, 2)}), ("the", set()),
    ("पहला पत्र", {(1, 1)}), ("mixed case", {(2, 1)}), ("100%", {(1, 2)}), ("0%", {(1, 2)}), ("%%", set()), ("x", set())])
def test_search_forms(spark, corpus, q, found):
    assert {(d, p) for d, p, _ in hits(spark, corpus, q)} == found


@pytest.mark.parametrize("q,terms", [
    ("or", {(0, "or")}), ("OR", {(0, "or")}), ("or fox", {(0, "or"), (0, "fox")}), ("fox or", {(0, "fox"), (0, "or")}),
    ("fox or dog", {(0, "fox"), (1, "dog")}), ("or or fox", {(0, "or"), (1, "fox")}), ("fox or or", {(0, "fox"), (1, "or")}),
    ("or or or", {(0, "or"), (1, "or")}), ("a or b or c", {(0, "a"), (1, "b"), (2, "c")}), ('"or" or -or', {(0, "or"), (1, "or")})])
def test_or_is_a_word_unless_it_stands_between_two(spark, q, terms):
    queries = spark.createDataFrame([(1, "o1", q)], "query_id int, owner_id string, q string")
    assert {(r["clause"], r["token"]) for r in sr.parse_queries(queries, english=False).collect()} == terms


def test_search_filters_scope_and_limits(spark, corpus):
    assert {d for d, *_ in hits(spark, corpus, "dog", tag="work")} == set()
    assert {d for d, *_ in hits(spark, corpus, "dog", year=1980)} == {1}
    assert len(hits(spark, corpus, "brown", limit=1)) == 1
    assert hits(spark, corpus, "brown", limit=51) == [] and hits(spark, corpus, "q" * 201) == []
    assert {d for d, *_ in hits(spark, corpus, "fox", owner_id="o2")} == {3}
    assert hits(spark, corpus, "पत्र")[0][2] == "ORIGINAL" and hits(spark, corpus, "fox")[0][2] == "TRANSLATED"


def test_large_query_batches_take_the_join_path(spark, corpus, monkeypatch):
    docs, pages = corpus
    owned = pages.join(docs.select("document_id", "owner_id"), "document_id")
    queries = spark.createDataFrame([(1, "o1", "पत्र"), (2, "o1", "CASE"), (3, "o2", "है")], "query_id int, owner_id string, q string")
    small = sorted(tuple(r) for r in sr.match_original(queries, owned).collect())
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sr, "is_small", lambda df: False)
    assert sorted(tuple(r) for r in sr.match_original(queries, owned).collect()) == small == [(1, 1, 1), (2, 2, 1), (3, 3, 1)]


def test_stored_index_reads_only_wanted_buckets(spark, corpus, tmp_path):
    docs, pages = corpus
    postings = sr.build_index(pages, docs)
    sr.write_index(postings, str(tmp_path), buckets=8)
    wanted = spark.createDataFrame([("brown",), ("dog",)], "token string")
    read = sr.read_index(spark, str(tmp_path), wanted, buckets=8)
    key = lambda df: sorted(tuple(r) for r in df.filter("token IN ('brown', 'dog')").select(*postings.columns).collect())
    assert key(read) == key(postings)
    assert read.count() < postings.count()


def test_trigram_similarity(one):
    assert one(trigram_similarity(F.lit("word"), F.lit("word"))) == 1.0
    assert round(one(trigram_similarity(F.lit("word"), F.lit("two words"))), 6) == round(4 / 11, 6)
    assert one(trigram_similarity(F.lit(None).cast("string"), F.lit("x"))) == 0.0


def test_snippets(one):
    text = "a" * 100 + "needle" + "b" * 300
    assert one(sr.snippet_original(F.lit(text), F.lit("needle"))) == text[40:240]
    assert one(sr.snippet_original(F.lit(text), F.lit("NEEDLE"))) == text[:200]
    words = " ".join(f"w{i}" for i in range(60))
    assert one(sr.snippet_translated(F.lit(words), F.lit(20))) == " ".join(f"w{i}" for i in range(12, 37))


def test_small_means_few_rows_and_few_bytes(spark):
    df = spark.createDataFrame([("a" * 1000, [1, 2], 5), (None, None, None)], "`x.y` string, b array<int>, c int")
    assert joins.is_small(df) and joins.is_small(df, rows=2, size=1100)
    assert not joins.is_small(df, rows=1) and not joins.is_small(df, size=1000)
    assert joins.is_small(df.limit(0), rows=0, size=0)


def test_common_words_are_looked_up_only_where_the_rarest_leads(spark):
    rows = [("o1", 1, page, 0, "letter") for page in range(100)] + [("o1", 1, 7, 1, "monsoon"), ("o1", 1, 8, 1, "monsoon"), ("o1", 1, 8, 2, "river")]
    postings = spark.createDataFrame(rows, "owner_id string, document_id int, page_no int, position int, token string")
    pages = postings.select("owner_id", "document_id", "page_no").distinct()

    def asked(q):
        return sr.parse_queries(spark.createDataFrame([(1, "o1", q)], "query_id int, owner_id string, q string"), english=False)

    for q, looked_up, matched in [("letter monsoon", 4, {7, 8}), ("monsoon letter -river", 5, {7}), ('"letter monsoon"', 4, {7, 8}),
                                  ("letter absent", 0, set()), ("letter -river", 101, set(range(100)) - {8}), ("-letter", 100, set()),
                                  ("monsoon river or absent letter", 2, {8}), ("monsoon or river -monsoon", 4, {7, 8})]:
        assert sr._hits(asked(q), postings).count() == looked_up, q
        assert {r["page_no"] for r in sr.match_translated(asked(q), postings, pages).collect()} == matched, q


def test_only_pages_within_reach_are_compared(spark):
    docs = spark.createDataFrame([(1, "o1", "First", 1980, ["family"])], "document_id int, owner_id string, title string, year int, tags array<string>")
    # Sixty pages with the word twice, two hundred with it once; of these one is close enough to overtake.
    texts = [(1, i, "a page with many other words " * 3 + str(i), "dog dog") for i in range(60)] + [
        (1, i, "dog" if i == 99 else f"long text about something else altogether, number {i}", "dog") for i in range(60, 260)]
    pages = spark.createDataFrame(texts, "document_id int, page_no int, original_text string, translated_text string")
    queries = spark.createDataFrame([(1, "o1", "dog", None, None, 50), (2, "o1", "dog", None, None, 3), (3, "o1", "dog", None, None, None), (4, "o1", "dog", "work", None, None)],
                                    "query_id int, owner_id string, q string, tag string, year int, limit int")
    compared = []
    reach = sr._within_reach
    sr._within_reach = lambda *args: compared.append(reach(*args)) or compared[-1]
    try:
        rows = sr.search(queries, pages, docs).collect()
    finally:
        sr._within_reach = reach
    # One query is ranked for the three that differ in their limit, over the pages that can be among its best.
    assert {r["page_no"] for r in compared[0].collect()} == {*range(60), 99} and compared[0].count() == 61
    found = lambda q: [r["page_no"] for r in sorted(rows, key=lambda r: r["place"]) if r["query_id"] == q]
    assert found(1)[0] == 99 and len(found(1)) == 50 and found(2) == found(1)[:3] and found(3) == found(1)[:20] and found(4) == []


def test_queries_of_one_text_are_matched_once(spark, corpus, monkeypatch):
    docs, pages = corpus
    owned = pages.join(docs.select("document_id", "owner_id"), "document_id")
    queries = spark.createDataFrame([(i, "o1", "Mixed CASE" if i % 2 else "mixed case") for i in range(50)], "query_id int, owner_id string, q string")
    tried = []
    monkeypatch.setattr(sr, "is_small", lambda df: tried.append(df.collect()) or True)
    assert sorted(tuple(r) for r in sr.match_original(queries, owned).collect()) == [(i, 2, 1) for i in range(50)]
    # Candidates have the first eight characters, not only three.
    assert [(r["q"], r["gram"]) for r in tried[0]] == [("mixed case", "mixed ca")]


@pytest.mark.parametrize("small", [True, False])
def test_queries_of_all_lengths_are_found_as_by_brute_force(spark, monkeypatch, small):
    texts = {i: ("ab ABa\nbä" * 3)[i % 7:][:i] + "पत्र 100% है"[: i % 5] for i in range(24)}
    pages = spark.createDataFrame([("o1", i, 1, t) for i, t in texts.items()] + [("o2", 99, 1, texts[20]), ("o1", 98, 1, None)],
                                  "owner_id string, document_id int, page_no int, original_text string")
    asked = {100 * n + k: (texts[20] * 2)[k:k + n].upper() for n in range(1, 14) for k in range(6)}
    queries = spark.createDataFrame([(i, "o1", q) for i, q in asked.items()] + [(5000, "o1", None)], "query_id int, owner_id string, q string")
    monkeypatch.setattr(sr, "is_small", lambda df: small)
    expected = {(i, d) for i, q in asked.items() if len(q) >= 2 for d, t in texts.items() if q.lower() in t.lower()}
    rows = sr.match_original(queries, pages).collect()
    assert {(r["query_id"], r["document_id"]) for r in rows} == expected and len(rows) == len(expected) > 200
