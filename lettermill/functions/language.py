"""Language codes and what each supports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import TRIM_CHARS, as_column

# Codes that can be translated, and those of them that can be spoken.
TRANSLATABLE = (
    "as", "bn", "brx", "doi", "en", "gu", "hi", "kn", "kok", "ks", "mai", "ml", "mni",
    "mr", "ne", "od", "pa", "sa", "sd", "ta", "te", "ur",
)
SPEAKABLE = ("bn", "en", "gu", "hi", "kn", "ml", "mr", "od", "pa", "ta", "te")
ENGLISH = "en"


def base_code(value: Column | str) -> Column:
    """Lower-case code without region."""
    return F.split_part(F.lower(F.btrim(as_column(value), F.lit(TRIM_CHARS))), F.lit("-"), F.lit(1))


def is_known_language(value: Column | str) -> Column:
    return F.coalesce(base_code(value).isin(*TRANSLATABLE), F.lit(False))


def supports_speech(value: Column | str) -> Column:
    return F.coalesce(base_code(value).isin(*SPEAKABLE), F.lit(False))


def is_english(value: Column | str) -> Column:
    return F.coalesce(base_code(value) == ENGLISH, F.lit(False))


def normalize_language(value: Column | str) -> Column:
    """``xx-IN`` for a known code in any case or with any region, null for others."""
    base = base_code(value)
    return F.when(base.isin(*TRANSLATABLE), F.concat(base, F.lit("-IN")))


def language_capabilities(df, language: str = "language"):
    """Add the normalised code and what the language supports."""
    return df.withColumns({
        "normalized": normalize_language(language),
        "is_known": is_known_language(language),
        "supports_speech": supports_speech(language),
        "is_english": is_english(language),
    })
