"""Character and word error rates of OCR output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.similarity import char_distance, error_rate, word_distance
from lettermill.functions.text import normalise_for_scoring


def _spread(pairs: DataFrame, key: str) -> DataFrame:
    """Scoring costs far more than moving a text, so long texts are dealt out evenly first."""
    return pairs.repartition(key)


def _scores(ready: DataFrame, words: bool) -> DataFrame:
    reference, hypothesis = F.col("_reference"), F.col("_hypothesis")
    if words:
        names, distance = ("word_errors", "reference_words", "wer"), word_distance(reference, hypothesis)
        length = F.when(reference.isNotNull(), F.regexp_count(reference, F.lit("\\S+")))
    else:
        names, distance, length = ("errors", "reference_chars", "cer"), char_distance(reference, hypothesis), F.length(reference)
    counted = ready.withColumns({names[0]: distance, names[1]: length})
    return counted.withColumn(names[2], error_rate(names[0], names[1]))


def _normalised(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "_reference": normalise_for_scoring("reference"), "_hypothesis": normalise_for_scoring("hypothesis")})


def score_characters(pairs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Add ``errors``, ``reference_chars`` and ``cer``."""
    return _scores(_normalised(_spread(pairs, key)), words=False).drop("_reference", "_hypothesis")


def score_words(pairs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Add ``word_errors``, ``reference_words`` and ``wer``."""
    return _scores(_normalised(_spread(pairs, key)), words=True).drop("_reference", "_hypothesis")


def score(pairs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Both rates, from texts normalised once."""
    both = _scores(_scores(_normalised(_spread(pairs, key)), words=False), words=True)
    return both.drop("_reference", "_hypothesis")


def accuracy_report(results: DataFrame) -> DataFrame:
    """One row per image. A row with ``error`` is listed without scores."""
    failed = F.col("error").isNotNull()
    scored = score(results.withColumns({c: F.when(~failed, F.col(c)) for c in ("reference", "hypothesis")}))
    return scored.drop("reference", "hypothesis")


def micro_cer(scored: DataFrame) -> DataFrame:
    """Total errors over total reference characters per language, and over all.

    Unscored rows are skipped by the sums and not by a filter, which would score twice.
    """
    rolled = scored.select("language", "errors", "reference_chars").rollup("language").agg(
        F.grouping("language").alias("_all"), F.count("errors").alias("images"),
        F.sum("errors").cast("bigint").alias("errors"),
        F.sum(F.when(F.col("errors").isNotNull(), F.col("reference_chars"))).cast("bigint").alias("reference_chars"))
    rate = F.when(F.col("reference_chars") > 0, F.round(F.col("errors") / F.col("reference_chars"), 6))
    label = F.when(F.col("_all") == 1, "all").otherwise(F.col("language"))
    kept = rolled.filter((F.col("images") > 0) | (F.col("_all") == 1))
    return kept.select(label.alias("language"), "images", "errors", "reference_chars", rate.alias("micro_cer"))
