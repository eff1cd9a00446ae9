"""Shared value rules: comparison forms, undefined numbers, time units.

Undefined is NULL inside the engine, never NaN: Spark orders NaN above every
number, so a NaN ratio would pass ``>=`` tests it has to fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks trimmed around identifiers before they are compared.
BLANKS = " \t\r\n"


def normal(c: str | Column) -> Column:
    """The comparison form of ids, filenames, splits and statuses; blank is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def finite(c: str | Column) -> Column:
    """The number itself, or NULL where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def millis(c: str | Column) -> Column:
    """Whole milliseconds of seconds, to the nearest; NULL for what is no number."""
    return F.round(finite(c) * 1000).cast("long")


def prob_units(c: str | Column) -> Column:
    """A probability in ten-thousandths, or NULL if it is no number from 0 to 1."""
    p = finite(c)
    return F.when((p >= 0) & (p <= 1), F.round(p * 10000).cast("int"))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is 0 or either side is undefined."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def holds(c: Column) -> Column:
    """A condition over possibly undefined numbers: undefined does not hold."""
    return F.coalesce(c, F.lit(False))


def fold_id(scheme: str | Column, fold: str | Column) -> Column:
    """What identifies a fold: its number, or for leave-one-out the subject in it."""
    scheme = F.col(scheme) if isinstance(scheme, str) else scheme
    text = F.lower(F.col(fold) if isinstance(fold, str) else fold)
    number = F.regexp_extract(text, r"(\d+)(?:\.0*)?\s*$", 1)
    subject = F.regexp_extract(text, r"([a-z]+\d+)", 1)
    number = F.nullif(number, F.lit("")).try_cast("long").cast("string") if hasattr(Column, "try_cast") else F.nullif(number, F.lit(""))
    return F.when(normal(scheme) == "loo", F.nullif(subject, F.lit(""))).otherwise(number)
