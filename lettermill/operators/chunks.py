"""Pages to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import TRANSLATE_LIMIT, chunk


def explode_chunks(pages: DataFrame, text: str = "original_text", limit: int = TRANSLATE_LIMIT) -> DataFrame:
    """One row per chunk with its 0-based index; the page text itself is not carried along."""
    rest = [c for c in pages.columns if c != text]
    return pages.select(*rest, F.posexplode(chunk(text, limit)).alias("chunk_index", "chunk"))
