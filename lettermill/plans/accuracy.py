"""Registered queries of OCR accuracy."""

from pyspark.sql import functions as F

from lettermill.operators import accuracy
from lettermill.operators import ocr_results as results
from lettermill.plans.common import view, views
from lettermill.plans.ocr import NAMED
from lettermill.plans.text import SCORED

QUERIES, ORACLES = {}, {}

# The SQL engine's edit distance counts bytes. Mapping the accented letters of the test
# texts to unused one-byte characters, one to one, keeps distances and makes them comparable.
ACCENTED = "éèêçóñüäößíÉÈÊÇÓÑÜÄÖÍ"
ONE_BYTE = "".join(chr(c) for c in (*range(1, 9), *range(14, 27)))
assert len(ACCENTED) == len(ONE_BYTE)

PAIRS = f"""{views('ocr_pair')},
scored AS (SELECT sample_id, language, CAST(levenshtein(translate(r, '{ACCENTED}', '{ONE_BYTE}'), translate(h, '{ACCENTED}', '{ONE_BYTE}')) AS BIGINT) AS errors,
                  length(r) AS reference_chars
           FROM (SELECT sample_id, language, {SCORED('reference')} AS r, {SCORED('hypothesis')} AS h FROM ocr_pair))"""
QUERIES["a1_cer"] = lambda s, d: accuracy.score_characters(view(s, d, "ocr_pair")).select(
    "sample_id", "errors", "reference_chars", F.round("cer", 6).alias("cer"))
ORACLES["a1_cer"] = f"""{PAIRS}
SELECT sample_id, errors, reference_chars,
       round(CASE WHEN reference_chars = 0 THEN CASE WHEN errors = 0 THEN 0.0 ELSE 1.0 END ELSE errors / reference_chars END, 6) AS cer
FROM scored"""

QUERIES["a2_wer"] = lambda s, d: accuracy.score_words(view(s, d, "ocr_pair")).select(
    "sample_id", "word_errors", "reference_words", F.round("wer", 6).alias("wer"))


def results_with_failures(s, d):
    return view(s, d, "ocr_pair").withColumn("error", F.expr("CASE WHEN sample_id % 10 = 9 THEN 'timeout' END"))


QUERIES["a3_accuracy_report"] = lambda s, d: accuracy.accuracy_report(results_with_failures(s, d))

QUERIES["a4_micro_cer"] = lambda s, d: accuracy.micro_cer(accuracy.score_characters(view(s, d, "ocr_pair")))
ORACLES["a4_micro_cer"] = f"""{PAIRS}
SELECT CASE WHEN grouping(language) = 1 THEN 'all' ELSE language END AS language, count(*) AS images,
       CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(reference_chars) AS BIGINT) AS reference_chars,
       CASE WHEN sum(reference_chars) > 0 THEN round(sum(errors) / sum(reference_chars), 6) END AS micro_cer
FROM scored GROUP BY ROLLUP (language)"""


def a5_text_provenance(s, d):
    entries = view(s, d, "ocr_entry").select(
        F.expr("archive_id * 10 + ordinal").alias("archive_id"), F.lit("metadata/page_001.json").alias("entry_name"),
        F.lit(0).alias("entry_pos"), F.col("json").alias("content"))
    texts = results.pages_from_json(entries).select("archive_id", "text")
    return results.text_provenance(entries, texts).select("archive_id", "text_source")


QUERIES["a5_text_provenance"] = a5_text_provenance
ORACLES["a5_text_provenance"] = f"""{views('ocr_entry')}
SELECT archive_id * 10 + ordinal AS archive_id, concat('metadata/page_001.json -> ',
  CASE WHEN json->>'$.markdown' = t AND json_type(json, '$.markdown') = 'VARCHAR' THEN 'markdown'
       WHEN json->>'$.text' = t THEN 'text' WHEN json->>'$.result.text' = t THEN 'result.text'
       WHEN json->>'$.id' = t THEN 'id' ELSE 'body' END) AS text_source
FROM (SELECT *, {NAMED} AS t FROM ocr_entry) WHERE t IS NOT NULL"""
