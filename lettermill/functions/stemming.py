"""English word stems by the published Porter2 (Snowball English) rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The English stop words of full-text search.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now
""".split())

# Suffix tables of the algorithm.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
UNCHANGED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful",
    "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ness": "", "ful": "",
}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "al", "er", "ic")

VOWEL = "[aeiouy]"
_REGION = re.compile(f"{VOWEL}[^aeiouy]")
_SHORT_END = re.compile(f"(?:[^aeiouy]{VOWEL}[^aeiouywxY]|^{VOWEL}[^aeiouy])$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    prefix = re.match("gener|commun|arsen", word)
    first = prefix.end() if prefix else (m.end() if (m := _REGION.search(word)) else len(word))
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    if not suffix or not re.search(VOWEL, word[: -len(suffix)]):
        return word
    word = word[: -len(suffix)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
        return word[:-1]
    return word + "e" if r1 >= len(word) and _SHORT_END.search(word) else word


def _derived(word: str, r1: int, r2: int) -> str:
    special = ("ogi", "li")
    suffix = _longest(word, (*STEP_2, *special))
    if suffix and len(word) - len(suffix) >= r1:
        stem = word[: -len(suffix)]
        if suffix in STEP_2:
            word = stem + STEP_2[suffix]
        elif suffix == "ogi" and stem.endswith("l"):
            word = word[:-1]
        elif suffix == "li" and stem[-1:] in tuple("cdeghkmnrt"):
            word = stem
    suffix = _longest(word, (*STEP_3, "ative"))
    if suffix and len(word) - len(suffix) >= r1:
        if suffix in STEP_3:
            word = word[: -len(suffix)] + STEP_3[suffix]
        elif len(word) - len(suffix) >= r2:
            word = word[: -len(suffix)]
    suffix = _longest(word, (*STEP_4, "ion"))
    if suffix and len(word) - len(suffix) >= r2:
        stem = word[: -len(suffix)]
        if suffix != "ion" or stem.endswith(("s", "t")):
            word = stem
    if word.endswith("e"):
        short = _SHORT_END.search(word[:-1])
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not short):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word


@lru_cache(maxsize=100_000)
def stem_word(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(f"(^|{VOWEL})y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in UNCHANGED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    return _derived(word, r1, r2).lower()


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")
