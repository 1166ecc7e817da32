"""Registered queries of search.

The SQL checks use plain words: stop words and stems are a Python rule of ours.
"""

import uuid

from pyspark.sql import functions as F

from lettermill.functions.similarity import trigram_similarity
from lettermill.operators import index_store, search as sr
from lettermill.plans.common import documents_with_tags, table, view, views
from lettermill.session import scratch_dir

QUERIES, ORACLES = {}, {}

WORD = "'[\\p{L}\\p{M}\\p{N}]+'"

# Two words of each conversation's first turn, asked by its owner.
OPENING = "regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1)"
# The word "or" is an operator, which the plain SQL check does not read.
OPENING = f"regexp_replace(regexp_replace({OPENING}, '(?i) or$', ' our'), '(?i)^or ', 'our ')"
ASK = f"""SELECT conv_id AS query_id, concat('owner', CAST(conv_id % 7 AS STRING)) AS owner_id,
  CASE conv_id % 4 WHEN 3 THEN substr({OPENING}, 1, 2) WHEN 2 THEN upper({OPENING}) ELSE {OPENING} END AS q,
  CASE WHEN conv_id % 5 = 1 THEN 'family' END AS tag, CAST(CASE WHEN conv_id % 5 = 2 THEN 1980 + conv_id % 10 END AS INT) AS year,
  CAST(CASE conv_id % 9 WHEN 1 THEN 3 WHEN 2 THEN 60 END AS INT) AS max_hits"""


def queries(s, d):
    asked = s.sql(ASK + " FROM {source} WHERE turn = 0", source=table(s, d, "conversations"))
    return asked.withColumnRenamed("max_hits", "limit")


ASKED = f"asked AS ({ASK} FROM conversations WHERE turn = 0), valid AS (SELECT * FROM asked WHERE length(q) BETWEEN 2 AND 200)"


def owned_pages(s, d):
    return view(s, d, "page").join(view(s, d, "document").select("document_id", "owner_id"), "document_id")


TOKENS = f"""posting AS (SELECT owner_id, document_id, page_no, unnest(range(len(ws))) AS position, unnest(ws) AS token
  FROM (SELECT owner_id, document_id, page_no, regexp_extract_all(lower(translated_text), {WORD}) AS ws
        FROM page JOIN document USING (document_id) WHERE translated_text IS NOT NULL))"""
QUERIES["q1_build_index"] = lambda s, d: sr.build_index(view(s, d, "page"), view(s, d, "document"), english=False)
ORACLES["q1_build_index"] = f"{views('document', 'page')}, {TOKENS} SELECT owner_id, document_id, page_no, CAST(position AS INT) AS position, token FROM posting"
QUERIES["q1_build_index_english"] = lambda s, d: sr.build_index(view(s, d, "page"), view(s, d, "document"))

QUERIES["q1_build_gram_index"] = lambda s, d: sr.build_gram_index(view(s, d, "page"), view(s, d, "document"))
ORACLES["q1_build_gram_index"] = f"""{views('document', 'page')}
SELECT DISTINCT owner_id, document_id, page_no, substr(t, i, n) AS gram
FROM (SELECT owner_id, document_id, page_no, t, n, unnest(range(1, length(t) - n + 2)) AS i
      FROM (SELECT *, lower(original_text) AS t FROM page JOIN document USING (document_id) WHERE original_text IS NOT NULL),
           (VALUES (2), (3)) v(n))"""

WEB_FORM = """CASE conv_id % 4 WHEN 0 THEN concat('"', a, ' ', b, '"') WHEN 1 THEN concat(a, ' or ', b)
  WHEN 2 THEN concat(a, ' -', b) ELSE concat('-', a) END"""
WORDS_OF_TURN = """SELECT conv_id, split(regexp_replace(text, '[^A-Za-z ]', ''), ' +') AS ws FROM {source} WHERE turn = 0"""


def web_queries(s, d):
    """Phrases, alternatives and negations of the first two words of each conversation."""
    ws = s.sql(WORDS_OF_TURN, source=table(s, d, "conversations")).selectExpr(
        "conv_id", "element_at(ws, 1) AS a", "try_element_at(ws, 2) AS b").filter("a <> '' AND b <> ''")
    return ws.selectExpr("conv_id AS query_id", "concat('owner', CAST(conv_id % 7 AS STRING)) AS owner_id", f"{WEB_FORM} AS q")


WEB = f"""asked AS (SELECT conv_id, concat('owner', conv_id % 7) AS owner_id, lower(ws[1]) AS a, lower(ws[2]) AS b, conv_id % 4 AS form
  FROM (SELECT conv_id, regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +') AS ws FROM conversations WHERE turn = 0)
  WHERE ws[1] <> '' AND ws[2] <> '')"""
QUERIES["q2_parse_queries"] = lambda s, d: sr.parse_queries(web_queries(s, d), english=False).select(
    "query_id", "clause", "negated", "offset", "token", "piece_terms", "needed")
ORACLES["q2_parse_queries"] = f"""WITH {WEB}
SELECT conv_id AS query_id, CASE WHEN form = 1 AND w = 1 THEN 1 ELSE 0 END AS clause,
       (form = 2 AND w = 1) OR form = 3 AS negated, CASE WHEN form = 0 THEN w ELSE 0 END AS offset,
       CASE w WHEN 0 THEN a ELSE b END AS token, CASE WHEN form = 0 THEN 2 ELSE 1 END AS piece_terms,
       CASE WHEN form = 3 THEN 0 ELSE 1 END AS needed
FROM asked, (VALUES (0), (1)) v(w) WHERE form <> 3 OR w = 0"""
QUERIES["q2_parse_queries_english"] = lambda s, d: sr.parse_queries(web_queries(s, d))

QUERIES["q3_match_translated"] = lambda s, d: sr.match_translated(
    sr.parse_queries(web_queries(s, d), english=False),
    sr.build_index(view(s, d, "page"), view(s, d, "document"), english=False), owned_pages(s, d)).select(
    "query_id", "document_id", "page_no")
ORACLES["q3_match_translated"] = f"""{views('document', 'page')}, {WEB},
words AS (SELECT document_id, page_no, owner_id, concat(' ', array_to_string(regexp_extract_all(lower(coalesce(translated_text, '')), {WORD}), ' '), ' ') AS t
          FROM page JOIN document USING (document_id))
SELECT conv_id AS query_id, document_id, page_no FROM asked JOIN words USING (owner_id)
WHERE CASE form WHEN 0 THEN contains(t, concat(' ', a, ' ', b, ' '))
                WHEN 1 THEN contains(t, concat(' ', a, ' ')) OR contains(t, concat(' ', b, ' '))
                WHEN 2 THEN contains(t, concat(' ', a, ' ')) AND NOT contains(t, concat(' ', b, ' '))
                ELSE NOT contains(t, concat(' ', a, ' ')) END"""

QUERIES["q4_match_original"] = lambda s, d: sr.match_original(queries(s, d), owned_pages(s, d))
ORACLES["q4_match_original"] = f"""{views('document', 'page')}, {ASKED}
SELECT query_id, document_id, page_no FROM asked JOIN document d USING (owner_id) JOIN page USING (document_id)
WHERE length(q) >= 2 AND contains(lower(original_text), lower(q))"""



def gram_index(s, d):
    path = f"{scratch_dir(s)}/gram-index-{uuid.uuid4().hex}"
    sr.create_gram_index(view(s, d, "page"), view(s, d, "document"), path)
    return path


QUERIES["q4_match_gram_index"] = lambda s, d: sr.match_gram_index(queries(s, d), gram_index(s, d))
ORACLES["q4_match_gram_index"] = ORACLES["q4_match_original"]

# Pages edited after the index was built: some get another text, some lose theirs.
AMENDED = """CASE page_no % 4 WHEN 1 THEN concat('amended ', coalesce(translated_text, 'anew'), ' again')
  WHEN 2 THEN CAST(NULL AS STRING) ELSE translated_text END AS translated_text"""


def index_kept_current(s, d):
    """The index after two changes, one merge and one more change of the same pages."""
    docs, pages = view(s, d, "document"), view(s, d, "page")
    path = f"{scratch_dir(s)}/index-{uuid.uuid4().hex}"
    index_store.create(sr.build_index(pages, docs, english=False), path, "token")
    amended = pages.selectExpr("document_id", "page_no", AMENDED)

    def change(part):
        index_store.apply_changes(sr.build_index(part, docs, english=False), part, path, "token")

    change(amended.filter("page_no % 4 = 1").withColumn("translated_text", F.lit("first draft")))
    change(amended.filter("page_no % 4 = 2"))
    index_store.merge(s, path, "token")
    change(amended.filter("page_no % 4 = 1"))
    return index_store.read(s, path)


QUERIES["q1_index_kept_current"] = index_kept_current
AMENDED_TOKENS = TOKENS.replace("lower(translated_text)", "lower(t)").replace(
    "FROM page JOIN document USING (document_id) WHERE translated_text IS NOT NULL",
    f"FROM (SELECT document_id, page_no, {AMENDED.replace('AS translated_text', 'AS t').replace('STRING', 'VARCHAR')} FROM page) "
    "JOIN document USING (document_id) WHERE t IS NOT NULL")
ORACLES["q1_index_kept_current"] = f"""{views('document', 'page')}, {AMENDED_TOKENS}
SELECT owner_id, document_id, page_no, CAST(position AS INT) AS position, token FROM posting"""

GRAMS = lambda x: (f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), {WORD}), "  # noqa: E731
                   "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))")
SIMILARITY = ("CASE WHEN len(list_distinct(list_concat(ga, gb))) > 0 THEN len(list_intersect(ga, gb)) "
              "/ len(list_distinct(list_concat(ga, gb))) ELSE 0.0 END")
QUERIES["q5_trigram_similarity"] = lambda s, d: view(s, d, "page").select(
    "document_id", "page_no", F.round(trigram_similarity("original_text", "translated_text"), 6).alias("similarity"))
ORACLES["q5_trigram_similarity"] = f"""{views('page')}
SELECT document_id, page_no, round(CASE WHEN original_text IS NULL OR translated_text IS NULL THEN 0.0 ELSE {SIMILARITY} END, 6) AS similarity
FROM (SELECT *, {GRAMS('original_text')} AS ga, {GRAMS('translated_text')} AS gb FROM page)"""

MATCHED = f"""{views('document', 'page')}, {ASKED}, {TOKENS},
terms AS (SELECT query_id, owner_id, unnest(range(len(ws))) AS piece, unnest(ws) AS token, len(ws) AS needed
          FROM (SELECT query_id, owner_id, regexp_extract_all(lower(q), {WORD}) AS ws FROM valid
                WHERE coalesce(max_hits, 20) BETWEEN 1 AND 50)),
pieces AS (SELECT query_id, needed, piece, document_id, page_no, count(*) AS n, min(position) AS first_hit
           FROM terms JOIN posting USING (owner_id, token) GROUP BY ALL),
translated AS (SELECT query_id, document_id, page_no, sum(ln(1 + n)) AS text_rank, min(first_hit) AS first_hit
               FROM pieces GROUP BY query_id, document_id, page_no, needed HAVING count(*) = needed)"""
QUERIES["q6_text_rank"] = lambda s, d: sr.match_translated(
    sr.parse_queries(sr.validate_queries(queries(s, d)).filter("reject_reason IS NULL"), english=False),
    sr.build_index(view(s, d, "page"), view(s, d, "document"), english=False), owned_pages(s, d)).select(
    "query_id", "document_id", "page_no", F.round("text_rank", 6).alias("text_rank"))
ORACLES["q6_text_rank"] = f"{MATCHED} SELECT query_id, document_id, page_no, round(text_rank, 6) AS text_rank FROM translated"

QUERIES["q7_snippet_original"] = lambda s, d: view(s, d, "page").select(
    "document_id", "page_no", sr.snippet_original("original_text", F.lit("en")).alias("snippet"))
ORACLES["q7_snippet_original"] = f"""{views('page')}
SELECT document_id, page_no, substr(coalesce(original_text, ''), CAST(greatest(1, strpos(coalesce(original_text, ''), 'en') - 60) AS BIGINT), 200) AS snippet
FROM page"""

FRAGMENT = lambda hit: (
    f"rtrim(array_to_string(list_slice(regexp_extract_all(translated_text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+[^\\p{{L}}\\p{{M}}\\p{{N}}]*'), "
    f"greatest(1, {hit} + 1 - 8), greatest(1, {hit} + 1 - 8) + 24), ''))")
QUERIES["q8_snippet_translated"] = lambda s, d: view(s, d, "page").filter("translated_text IS NOT NULL").select(
    "document_id", "page_no", sr.snippet_translated("translated_text", F.col("page_no") * 4).alias("snippet"))
ORACLES["q8_snippet_translated"] = f"""{views('page')}
SELECT document_id, page_no, {FRAGMENT('page_no * 4')} AS snippet FROM page WHERE translated_text IS NOT NULL"""

QUERIES["q9_filter_tag_year"] = lambda s, d: sr.filter_tag_year(documents_with_tags(s, d), "family", 1984).select("document_id")
ORACLES["q9_filter_tag_year"] = f"{views('document')} SELECT document_id FROM document WHERE tag = 'family' AND year = 1984"

QUERIES["q10_validate_queries"] = lambda s, d: sr.validate_queries(queries(s, d)).select("query_id", "limit", "reject_reason")
ORACLES["q10_validate_queries"] = f"""WITH {ASKED}
SELECT query_id, coalesce(max_hits, 20) AS "limit", CASE WHEN length(q) NOT BETWEEN 2 AND 200 THEN 'bad_length'
       WHEN coalesce(max_hits, 20) NOT BETWEEN 1 AND 50 THEN 'bad_limit' END AS reject_reason FROM asked"""

QUERIES["q10_search"] = lambda s, d: sr.search(
    queries(s, d), view(s, d, "page"), documents_with_tags(s, d), english=False).withColumn("tags", F.array_join("tags", ","))
ORACLES["q10_search"] = f"""{MATCHED},
original AS (SELECT query_id, document_id, page_no FROM valid JOIN document USING (owner_id) JOIN page USING (document_id)
             WHERE coalesce(max_hits, 20) BETWEEN 1 AND 50 AND contains(lower(original_text), lower(q))),
found AS (SELECT query_id, document_id, page_no, coalesce(text_rank, 0) AS text_rank, first_hit, t.query_id IS NOT NULL AS hit
          FROM translated t FULL JOIN original o USING (query_id, document_id, page_no)),
scoped AS (SELECT f.*, v.q, coalesce(max_hits, 20) AS max_hits, d.title, d.year, d.tag, p.original_text, p.translated_text,
                  {GRAMS('p.original_text')} AS ga, {GRAMS('v.q')} AS gb
           FROM found f JOIN valid v USING (query_id) JOIN document d USING (document_id) JOIN page p USING (document_id, page_no)
           WHERE (v.tag IS NULL OR v.tag = d.tag) AND (v.year IS NULL OR v.year = d.year)),
ranked AS (SELECT *, round(text_rank + CASE WHEN original_text IS NULL THEN 0.0 ELSE {SIMILARITY} END, 6) AS rank FROM scoped),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, page_no, document_id) AS place FROM ranked)
SELECT query_id, place, document_id, title, year, tag AS tags, page_no,
       CASE WHEN hit THEN 'TRANSLATED' ELSE 'ORIGINAL' END AS matched_in,
       CASE WHEN hit THEN {FRAGMENT('first_hit')}
            ELSE substr(original_text, CAST(greatest(1, strpos(original_text, q) - 60) AS BIGINT), 200) END AS snippet, rank
FROM placed WHERE place <= max_hits"""
QUERIES["q10_search_english"] = lambda s, d: sr.search(
    queries(s, d), view(s, d, "page"), documents_with_tags(s, d)).withColumn("tags", F.array_join("tags", ","))
