"""Keys of paid calls and of stored objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import as_column, content_hash

# The voice in use.
SPEAKER = "shubh"
SPEECH_MODEL = "bulbul:v3"
SAMPLE_RATE = 22050


def translate_key(page_id, index, chunk) -> Column:
    """Key of one translated chunk. Page and position are part of it."""
    return F.concat_ws(
        ":", as_column(page_id).cast("string"), F.lit("TRANSLATE"), F.lit("-"),
        as_column(index).cast("string"), content_hash(chunk),
    )


def speech_hash(language, chunk, speaker=SPEAKER, model=SPEECH_MODEL, rate=SAMPLE_RATE) -> Column:
    """Hash of what is spoken and how, shared by the call key and the cached object's name."""
    spoken = F.concat_ws("|", as_column(language), F.lit(speaker), F.lit(model), F.lit(str(rate)), as_column(chunk))
    return content_hash(spoken)


def speech_key(owner, language, chunk, speaker=SPEAKER, model=SPEECH_MODEL, rate=SAMPLE_RATE) -> Column:
    """Key of one spoken chunk: never shared between owners, the same at any position."""
    return F.concat_ws(":", F.lit("TTS"), as_column(owner), speech_hash(language, chunk, speaker, model, rate))


def page_image_key(document_id, page_no, content_type) -> Column:
    extension = F.when(as_column(content_type) == "image/png", "png").otherwise("jpg")
    return F.format_string("documents/%s/pages/%03d.%s", as_column(document_id).cast("string"),
                           as_column(page_no), extension)


def page_track_key(document_id, track, page_no) -> Column:
    return F.format_string("documents/%s/audio/%s/%03d.wav", as_column(document_id).cast("string"),
                           as_column(track), as_column(page_no))


def document_track_key(document_id, track) -> Column:
    return F.format_string("documents/%s/audio/%s.wav", as_column(document_id).cast("string"), as_column(track))


def speech_cache_key(owner, hashed) -> Column:
    return F.format_string("tts-cache/%s/%s.wav", as_column(owner), as_column(hashed))
