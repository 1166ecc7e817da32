import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lettermill.functions import keys, language, ranges
from lettermill.functions import text as T


@pytest.mark.parametrize("text,count", [
    ("one two  three", 3), ("a\nb\tc", 3), ("नमस्ते यह एक पत्र", 4), ("   ", 0), ("", 0), (" ", 0), (" a b", 2),
    (" x ", 1), (None, 0)])
def test_word_count(one, text, count):
    assert one(T.word_count(F.lit(text).cast("string"))) == count


def test_sentences_end_at_danda_marks_and_lines(one):
    assert one(T.sentences(F.lit("पहला वाक्य। दूसरा॥ Third? Fourth!  \n\n fifth 3.14 end"))) == [
        "पहला वाक्य।", "दूसरा॥", "Third?", "Fourth!", "fifth 3.14 end"]


def brute_chunks(text, limit):
    """Straight reading of the rule, one character list at a time."""
    import re

    out, current = [], ""
    for sentence in (s.strip(T.STRIP_CHARS) for s in re.split(r"(?<=[।॥.?!])[\t-\r ]+|\n+", text)):
        if not sentence:
            continue
        if len(sentence) > limit:
            out += [current] if current else []
            current, rest = "", sentence
            while len(rest) > limit:
                cut = rest[: limit + 1].rfind(" ")
                cut = cut if cut > 0 else limit
                out.append(rest[:cut].strip(T.STRIP_CHARS))
                rest = rest[cut:].lstrip(T.STRIP_CHARS)
            out += [rest] if rest else []
        elif current and len(current) + 1 + len(sentence) > limit:
            out.append(current)
            current = sentence
        else:
            current = f"{current} {sentence}" if current else sentence
    return out + ([current] if current else [])


def test_chunk_matches_brute_force(spark):
    rng = random.Random(7)
    alphabet = ["a", "bb", "ccc", "dddddddddddddddddddddddd", "é", "क", " ", "  ", ". ", "? ", "। ", "\n", "\n\n", " ", "\t"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 50, "word " * 20, "First one. Second one! Third one?", "x" * 20 + " " + "y" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for limit in (5, 20, 37):
        got = {r["id"]: r["c"] for r in df.select("id", T.chunk("text", limit).alias("c")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == brute_chunks(text, limit), (limit, text)


def test_hard_split(one):
    assert one(T.hard_split(F.lit("alpha beta  gamma"), 6)) == ["alpha", "beta", "gamma"]
    assert one(T.hard_split(F.lit("z" * 25), 10)) == ["z" * 10, "z" * 10, "z" * 5]


def test_content_hash_ignores_form_and_edges(one):
    composed, decomposed = "café", "café"
    expected = hashlib.sha256(composed.encode()).hexdigest()
    assert one(T.content_hash(F.lit(composed))) == expected
    assert one(T.content_hash(F.lit(f" {decomposed}\n"))) == expected
    assert one(T.content_hash(F.lit(None).cast("string"))) is None


def test_nfc_agrees_with_unicode_tables(spark):
    texts = ["क़", "ẹ́", "가", "plain", "Å", "ö", "àb", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.nfc("t")).collect()]
    assert got == [unicodedata.normalize("NFC", t) if t is not None else None for t in texts]


def test_keys_depend_on_what_they_should(one):
    chunk = F.lit("text")
    assert one(keys.translate_key(F.lit("p1"), F.lit(0), chunk)) != one(keys.translate_key(F.lit("p1"), F.lit(1), chunk))
    assert one(keys.translate_key(F.lit("p1"), F.lit(0), chunk)) != one(keys.translate_key(F.lit("p2"), F.lit(0), chunk))
    assert one(keys.speech_key(F.lit("o1"), F.lit("hi-IN"), chunk)) != one(keys.speech_key(F.lit("o2"), F.lit("hi-IN"), chunk))
    assert one(keys.speech_key(F.lit("o1"), F.lit("hi-IN"), chunk)) != one(keys.speech_key(F.lit("o1"), F.lit("ta-IN"), chunk))
    assert one(keys.page_image_key(F.lit(7), F.lit(3), F.lit("image/png"))) == "documents/7/pages/003.png"


@pytest.mark.parametrize("code,expected", [("hi", "hi-IN"), (" TA-in ", "ta-IN"), ("fr", None), ("", None), (None, None)])
def test_normalize_language(one, code, expected):
    assert one(language.normalize_language(F.lit(code).cast("string"))) == expected


def test_language_capabilities(one):
    assert one(language.supports_speech(F.lit("as"))) is False
    assert one(language.supports_speech(F.lit("ta-IN"))) is True
    assert one(language.is_english(F.lit("EN-us"))) is True
    assert one(language.is_known_language(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize("text,first,last,reason", [
    ("11-12", 11, 12, None), ("5-5", 5, 5, None), ("9,3,7", 3, 9, None), ("4", 4, 4, None), ("0-3", None, None, "below_one"),
    ("7-2", None, None, "inverted"), ("a-b", None, None, "malformed"), ("1-", None, None, "malformed"),
    ("99999999999-1", None, None, "malformed")])
def test_parse_page_range(one, text, first, last, reason):
    got = one(ranges.parse_page_range(F.lit(text)))
    assert (got["first"], got["last"], got["reason"]) == (first, last, reason)


def test_escape_like(one):
    assert one(T.escape_like(F.lit("50%_a\\b"))) == "50\\%\\_a\\\\b"
