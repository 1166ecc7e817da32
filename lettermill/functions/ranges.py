"""Page ranges: ``a-b`` or a comma list, inclusive and 1-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import as_column, strip


def parse_page_range(value: Column | str) -> Column:
    """Struct ``first, last, reason``; the bounds are null when ``reason`` is set."""
    text = strip(value)
    listed = F.when(text.rlike("^[0-9]+-[0-9]+$"), F.split(text, "-")).when(
        text.rlike("^[0-9]+(,[0-9]+)*$"), F.split(text, ","))
    numbers = F.transform(listed, lambda n: n.try_cast("int"))
    dashed = text.contains("-")
    first = F.when(dashed, numbers[0]).otherwise(F.array_min(numbers))
    last = F.when(dashed, numbers[1]).otherwise(F.array_max(numbers))
    reason = (
        F.when(numbers.isNull() | F.exists(numbers, lambda n: n.isNull()), "malformed")
        .when(first < 1, "below_one")
        .when(last < first, "inverted")
    )
    return F.struct(
        F.when(reason.isNull(), first).alias("first"),
        F.when(reason.isNull(), last).alias("last"),
        reason.alias("reason"),
    )


def format_page_range(first, last) -> Column:
    return F.concat_ws("-", as_column(first).cast("string"), as_column(last).cast("string"))


def range_size(first, last) -> Column:
    return as_column(last) - as_column(first) + 1


def range_contains(first, last, page_no) -> Column:
    return as_column(page_no).between(as_column(first), as_column(last))


def absolute_page_no(first, index) -> Column:
    return as_column(first) + as_column(index) - 1
