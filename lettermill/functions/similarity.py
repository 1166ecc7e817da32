"""Trigram similarity and edit-distance rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lettermill.functions.text import as_column

# One code point is taken per match, so that no gram starts inside of one.
GRAM = "(?s)(?=(.{%d}))."

# From this length on a band of the distance table is cheaper than whole columns.
BANDED = 2000


def grams(value: Column | str, n: int = 3) -> Column:
    """All overlapping n-grams of a text, in order, in one linear pass."""
    return F.regexp_extract_all(as_column(value), F.lit(GRAM % n), 1)


def trigrams(value: Column | str) -> Column:
    """Distinct trigrams of lower-case words, each padded by two blanks in front and one behind."""
    words = F.regexp_extract_all(F.lower(as_column(value)), F.lit("[\\p{L}\\p{M}\\p{N}]+"), 0)
    padded = F.transform(words, lambda w: grams(F.concat(F.lit("  "), w, F.lit(" "))))
    return F.array_distinct(F.flatten(padded))


def gram_similarity(left: Column | str, right: Column | str, short_right: bool = False) -> Column:
    """Shared over all of two sets of trigrams; 0 for null or when neither has any.

    With ``short_right`` the few grams on the right are looked up one by one, which is
    cheaper than building a set of the left ones.
    """
    left, right = as_column(left), as_column(right)
    if short_right:
        shared = F.size(F.filter(right, lambda gram: F.array_contains(left, gram)))
    else:
        shared = F.size(F.array_intersect(left, right))
    both = F.size(left) + F.size(right)
    # Inside the lambda the shared count is a variable, so it is worked out once.
    ratio = F.get(F.transform(F.array(shared), lambda s: s / (both - s)), 0)
    return F.coalesce(F.when(left.isNotNull() & right.isNotNull() & (both > 0), ratio), F.lit(0.0))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    # As a lambda variable each set of grams is made once, although it is used several times.
    both = F.array(F.struct(trigrams(a).alias("left"), trigrams(b).alias("right")))
    return F.get(F.transform(both, lambda pair: gram_similarity(pair["left"], pair["right"])), 0)


def _places(a: Sequence) -> dict[object, int]:
    """For each symbol, the places it has as the bits of a number."""
    where: dict = {}
    for i, symbol in enumerate(a):
        where.setdefault(symbol, []).append(i)
    masks = {}
    for symbol, places in where.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        masks[symbol] = int.from_bytes(bits, "little")
    return masks


def _banded_distance(size: int, masks: dict[object, int], b: Sequence, most: int) -> int:
    """The edit distance if it is at most ``most``, otherwise a larger number than that.

    An alignment that costs no more strays at most ``below`` and ``above`` from the diagonal. The bits
    of a step are the cells of that band alone, which moves down by one cell a step (Hyyrö's method).
    """
    below, above = (most + size - len(b)) // 2, (most - size + len(b)) // 2
    width = below + above + 1
    full, last = (1 << width) - 1, width - 1
    up, down, found = full ^ ((1 << above) - 1), 0, below
    near: dict = {}
    first, turn = -above, size - below
    for i, symbol in enumerate(b):
        # Cut out every so often what the next steps can see of each symbol's places.
        if i % width == 0:
            near, first = {}, i - above
        if symbol not in near:
            mask = masks.get(symbol, 0)
            near[symbol] = (mask >> first if first >= 0 else mask << -first) & ((1 << 2 * width) - 1)
        match = near[symbol] >> (i % width) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | (full ^ (diagonal | up)), diagonal & up
        if i < turn:
            found += not diagonal >> last
        else:
            place = last - 1 - (i - turn)
            found += (right >> place & 1) - (left >> place & 1)
        shifted = diagonal >> 1
        up, down = left | (full ^ (shifted | right)), shifted & right
    return found


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences by the published bit-parallel method of Myers.

    One column of the distance table is a pair of integers as wide as ``a``, so the cost is
    len(b) steps on len(a) bits. Long sequences are first compared in a band of the table, which
    is doubled until the distance lies within it.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    masks = _places(a)
    if len(a) >= BANDED:
        most = max(len(a) // 16, abs(len(a) - len(b)) + 64)
        while most <= len(a) // 2:
            found = _banded_distance(len(a), masks, b, most)
            if found <= most:
                return found
            most *= 2
    full = (1 << len(a)) - 1
    up, down = full, 0
    for symbol in b:
        match = masks.get(symbol, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right, left = down | (full ^ (diagonal | up)), diagonal & up
        right, left = right << 1 & full | 1, left << 1 & full
        up, down = left | (full ^ (diagonal | right)), right & diagonal
    # The last column starts at len(b); its steps up and down lead to the answer.
    return len(b) + up.bit_count() - down.bit_count()


# Not Arrow: that hands over ten thousand rows at a time, however long their texts; this hands over a hundred.
@F.udf(returnType=IntegerType(), useArrow=False)
def _char_distance(a: str | None, b: str | None) -> int | None:
    return None if a is None or b is None else edit_distance(a, b)


@F.udf(returnType=IntegerType(), useArrow=False)
def _word_distance(a: str | None, b: str | None) -> int | None:
    return None if a is None or b is None else edit_distance(a.split(), b.split())


def char_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """Code-point edit distance of texts already normalised for scoring.

    The built-in ``levenshtein`` fills the whole table cell by cell, which takes many times
    longer on page-long texts.
    """
    return _unless_equal(_char_distance, as_column(reference), as_column(hypothesis))


def word_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance over white-space separated words."""
    return _unless_equal(_word_distance, as_column(reference), as_column(hypothesis))


def _unless_equal(distance, a: Column, b: Column) -> Column:
    """Equal texts are answered here and don't travel to Python."""
    differ = a != b
    return F.when(a == b, 0).otherwise(distance(F.when(differ, a), F.when(differ, b)))


def error_rate(errors: Column | str, length: Column | str) -> Column:
    """Errors over reference length; an empty reference scores 0 or 1."""
    e, n = as_column(errors), as_column(length)
    return F.when(n == 0, F.when(e == 0, 0.0).otherwise(1.0)).otherwise(e / n)
