"""Small column helpers shared by every report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace a browser strips, which Spark's trim (spaces only) would keep.
WHITESPACE = " \t\n\r\x0b\x0c\u00a0\ufeff"


def rounded(x: Column, digits: int) -> Column:
    """Round half up on the decimal value, so 1.005 gives 1.01; returns double. Decimals from the
    seventh on are rounded away first."""
    return F.round(x.cast("decimal(38,6)"), digits).cast("double")


def exact_sum(x: Column) -> Column:
    """Sum of a double with up to 6 decimals, independent of row and partition order: decimals
    are summed. Further decimals of a value are rounded away."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def exact_avg(x: Column) -> Column:
    """Mean of a double with up to 6 decimals, independent of row and partition order."""
    return exact_sum(x) / F.count(x)


def ratio(part: Column, whole: Column) -> Column:
    """part/whole as double; null when whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def flagged_count(flag: Column) -> Column:
    return F.count_if(flag)


def month_of(x: Column) -> Column:
    return F.trunc(x, "month")


def clamp(x: Column, low: float, high: float) -> Column:
    """x held between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def constant_list(values: Sequence[str]) -> Column:
    """A constant array, built from one literal that Spark folds."""
    return F.split(F.lit("|".join(values)), "[|]")


def pick(values: Sequence[str], index: Column) -> Column:
    """The value at a zero-based index."""
    return F.element_at(constant_list(values), index.cast("int") + 1)


def padded_id(prefix: str, width: int, number: Column) -> Column:
    """PREFIX-000042; longer numbers are kept whole."""
    return F.format_string(f"{prefix}-%0{width}d", number.cast("long"))


def default_text(x: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def preview(text: Column, length: int) -> Column:
    """At most ``length`` characters, marked with ... when cut. For display only."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("...")))\
        .otherwise(text)


def title_case(code: Column) -> Column:
    """first_code_word -> First Code_word: only the first underscore becomes a space."""
    return F.initcap(F.regexp_replace(code, "^([^_]*)_", "$1 "))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text), F.lit("")) == ""


def dotted_quad(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.concat_ws(".", *[x.cast("int").cast("string") for x in (a, b, c, d)])


def days_after(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


def at_second(day: Column, second: Column) -> Column:
    """Timestamp at a second of a day."""
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + second.cast("long"))


def as_payload(*columns: Column) -> Column:
    """JSON text of the given columns."""
    return F.to_json(F.struct(*columns))
