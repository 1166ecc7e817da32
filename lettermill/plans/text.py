"""Registered queries of the text functions."""

from pyspark.sql import functions as F

from lettermill.functions import keys, language, ranges
from lettermill.functions import text as T
from lettermill.operators.chunks import explode_chunks
from lettermill.plans.common import (
    chunk_ctes, content_hash, hard_ctes, sentence_list, strip, table, view, views, word_count,
)

QUERIES, ORACLES = {}, {}

QUERIES["t1_word_count"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", T.word_count("text").alias("words"))
ORACLES["t1_word_count"] = f"SELECT doc_id, CAST({word_count('text')} AS INT) AS words FROM documents"

QUERIES["t2_sentences"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", F.posexplode(T.sentences("text")).alias("sentence_no", "sentence"))
ORACLES["t2_sentences"] = f"""
SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS sentence_no, unnest(s) AS sentence
FROM (SELECT doc_id, {sentence_list('text')} AS s FROM documents)"""


def t3_hard_split(s, d):
    sentences = QUERIES["t2_sentences"](s, d).filter(F.length("sentence") > 60)
    return sentences.select("doc_id", "sentence_no",
                            F.posexplode(T.hard_split("sentence", 60)).alias("piece_no", "piece"))


QUERIES["t3_hard_split"] = t3_hard_split
ORACLES["t3_hard_split"] = f"""
WITH RECURSIVE sx AS ({ORACLES['t2_sentences'].replace('sentence_no', 'si')}),
{hard_ctes(60, 'doc_id')}
SELECT doc_id, si AS sentence_no, CAST(unnest(range(len(ps))) AS INT) AS piece_no, unnest(ps) AS piece FROM pieces"""

QUERIES["t4_chunk"] = lambda s, d: table(s, d, "documents").withColumn("c", T.chunk("text")).select(
    "doc_id", F.size("c").alias("chunks"), F.array_join("c", "|").alias("joined"))
ORACLES["t4_chunk"] = f"""
WITH RECURSIVE {chunk_ctes('documents', 'doc_id', 'text', T.TRANSLATE_LIMIT)}
SELECT doc_id, CAST(count(chunk) AS INT) AS chunks, coalesce(string_agg(chunk, '|' ORDER BY chunk_index), '') AS joined
FROM documents LEFT JOIN chunks USING (doc_id) GROUP BY doc_id"""


def t5_explode_chunks(s, d):
    pages = view(s, d, "page").select("document_id", "page_no", "original_text")
    return explode_chunks(pages, "original_text", 120)


PAGE_CHUNKS = chunk_ctes("(SELECT * FROM page WHERE original_text IS NOT NULL)", "document_id, page_no",
                         "original_text", 120)
QUERIES["t5_explode_chunks"] = t5_explode_chunks
ORACLES["t5_explode_chunks"] = f"""
{views('page', recursive=True)}, {PAGE_CHUNKS}
SELECT document_id, page_no, chunk_index, chunk FROM chunks"""

QUERIES["t6_content_hash"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", T.content_hash("text").alias("text_hash"))
ORACLES["t6_content_hash"] = f"SELECT doc_id, {content_hash('text')} AS text_hash FROM documents"

QUERIES["t7_translate_key"] = lambda s, d: t5_explode_chunks(s, d).select(
    "document_id", "page_no", "chunk_index",
    keys.translate_key(F.concat_ws("/", "document_id", "page_no"), "chunk_index", "chunk").alias("call_key"))
ORACLES["t7_translate_key"] = f"""
{views('page', recursive=True)}, {PAGE_CHUNKS}
SELECT document_id, page_no, chunk_index,
       concat(document_id, '/', page_no, ':TRANSLATE:-:', chunk_index, ':', {content_hash('chunk')}) AS call_key
FROM chunks"""


def t8_speech_key(s, d):
    docs = table(s, d, "documents")
    chunks = docs.select("doc_id", "source", "lang", F.posexplode(T.chunk("text", T.SPEECH_LIMIT))
                         .alias("chunk_index", "chunk"))
    code = F.concat("lang", F.lit("-IN"))
    return chunks.select("doc_id", "chunk_index", keys.speech_key("source", code, "chunk").alias("call_key"),
                         keys.speech_cache_key("source", keys.speech_hash(code, "chunk")).alias("cache_key"))


VOICE = "concat(lang, '-IN|shubh|bulbul:v3|22050|', chunk)"
QUERIES["t8_speech_key"] = t8_speech_key
ORACLES["t8_speech_key"] = f"""
WITH RECURSIVE {chunk_ctes('documents', 'doc_id, source, lang', 'text', T.SPEECH_LIMIT)}
SELECT doc_id, chunk_index, concat('TTS:', source, ':', {content_hash(VOICE)}) AS call_key,
       concat('tts-cache/', source, '/', {content_hash(VOICE)}, '.wav') AS cache_key FROM chunks"""

SPELLINGS = "CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN upper(lang) WHEN 2 THEN concat(' ', lang, '-IN ') ELSE 'ta-IN' END"
CODES = ", ".join(f"'{c}'" for c in language.TRANSLATABLE)
SPOKEN = ", ".join(f"'{c}'" for c in language.SPEAKABLE)
BASE = "split_part(lower(trim(language)), '-', 1)"

QUERIES["t9_normalize_language"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", F.expr(SPELLINGS).alias("language")).select(
    "doc_id", "language", language.normalize_language("language").alias("normalized"))
ORACLES["t9_normalize_language"] = f"""
SELECT doc_id, language, CASE WHEN {BASE} IN ({CODES}) THEN concat({BASE}, '-IN') END AS normalized
FROM (SELECT doc_id, {SPELLINGS} AS language FROM documents)"""

QUERIES["t10_language_capabilities"] = lambda s, d: language.language_capabilities(
    view(s, d, "document").select("document_id", "language"))
ORACLES["t10_language_capabilities"] = f"""
{views('document')}
SELECT document_id, language, CASE WHEN {BASE} IN ({CODES}) THEN concat({BASE}, '-IN') END AS normalized,
       {BASE} IN ({CODES}) AS is_known, {BASE} IN ({SPOKEN}) AS supports_speech, {BASE} = 'en' AS is_english
FROM document"""

RANGE_TEXTS = """CASE doc_id % 7
  WHEN 0 THEN concat(CAST(doc_id % 20 + 1 AS STRING), '-', CAST(doc_id % 20 + 10 AS STRING))
  WHEN 1 THEN concat(' ', CAST(doc_id % 9 + 1 AS STRING), ',', CAST(doc_id % 5 + 1 AS STRING), ',7 ')
  WHEN 2 THEN concat(CAST(doc_id % 20 + 10 AS STRING), '-', CAST(doc_id % 10 AS STRING))
  WHEN 3 THEN concat('p', CAST(doc_id AS STRING)) WHEN 4 THEN '0-3' WHEN 5 THEN '3,,4' ELSE CAST(doc_id + 1 AS STRING) END"""


def ranges_of(s, d):
    return table(s, d, "documents").select("doc_id", F.expr(RANGE_TEXTS).alias("page_range")).withColumn(
        "r", ranges.parse_page_range("page_range"))


RANGE_SQL = f"""
parsed AS (
  SELECT doc_id, page_range, n, page_range LIKE '%-%' AS dashed,
         CASE WHEN page_range LIKE '%-%' THEN n[1] ELSE list_min(n) END AS a,
         CASE WHEN page_range LIKE '%-%' THEN n[2] ELSE list_max(n) END AS b
  FROM (SELECT doc_id, page_range, CASE WHEN regexp_full_match(trim(page_range), '[0-9]+-[0-9]+|[0-9]+(,[0-9]+)*')
               THEN list_transform(regexp_extract_all(page_range, '[0-9]+'), lambda x: CAST(x AS INT)) END AS n
        FROM (SELECT doc_id, {RANGE_TEXTS} AS page_range FROM documents))),
ranged AS (SELECT *, CASE WHEN n IS NULL THEN 'malformed' WHEN a < 1 THEN 'below_one' WHEN b < a THEN 'inverted' END AS reason
           FROM parsed)"""
QUERIES["t11_parse_page_range"] = lambda s, d: ranges_of(s, d).select(
    "doc_id", "page_range", F.col("r.first").alias("first_page"), F.col("r.last").alias("last_page"), "r.reason")
ORACLES["t11_parse_page_range"] = f"""WITH {RANGE_SQL}
SELECT doc_id, page_range, CASE WHEN reason IS NULL THEN a END AS first_page,
       CASE WHEN reason IS NULL THEN b END AS last_page, reason FROM ranged"""

QUERIES["t12_range_arithmetic"] = lambda s, d: ranges_of(s, d).filter("r.reason IS NULL").select(
    "doc_id", ranges.range_size("r.first", "r.last").alias("pages"),
    ranges.range_contains("r.first", "r.last", F.lit(7)).alias("has_page_7"),
    ranges.absolute_page_no("r.first", F.lit(2)).alias("second_page"))
ORACLES["t12_range_arithmetic"] = f"""WITH {RANGE_SQL}
SELECT doc_id, b - a + 1 AS pages, 7 BETWEEN a AND b AS has_page_7, a + 1 AS second_page FROM ranged WHERE reason IS NULL"""

QUERIES["t13_truncate_error"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", T.truncate_error("text").alias("last_error"))
ORACLES["t13_truncate_error"] = "SELECT doc_id, substr(text, 1, 2000) AS last_error FROM documents"

QUERIES["t14_escape_like"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", T.escape_like("text").alias("escaped"))
ORACLES["t14_escape_like"] = r"""
SELECT doc_id, replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM documents"""

QUERIES["t15_normalise_for_scoring"] = lambda s, d: table(s, d, "documents").select(
    "doc_id", T.normalise_for_scoring("text").alias("normalised"))
SCORED = lambda x: strip(f"regexp_replace(nfc_normalize({x}), '[\\t-\\r ]+', ' ', 'g')")
ORACLES["t15_normalise_for_scoring"] = f"SELECT doc_id, {SCORED('text')} AS normalised FROM documents"

QUERIES["t16_object_keys"] = lambda s, d: view(s, d, "page").select(
    "document_id", "page_no",
    keys.page_image_key("document_id", "page_no", F.when(F.col("page_no") % 2 == 0, "image/png").otherwise("image/jpeg"))
    .alias("image_key"),
    keys.page_track_key("document_id", F.lit("en"), "page_no").alias("track_key"),
    keys.document_track_key("document_id", F.lit("orig")).alias("document_key"))
ORACLES["t16_object_keys"] = f"""
{views('page')}
SELECT document_id, page_no,
       format('documents/{{}}/pages/{{:03d}}.{{}}', document_id, page_no, CASE WHEN page_no % 2 = 0 THEN 'png' ELSE 'jpg' END) AS image_key,
       format('documents/{{}}/audio/en/{{:03d}}.wav', document_id, page_no) AS track_key,
       format('documents/{{}}/audio/orig.wav', document_id) AS document_key
FROM page"""

