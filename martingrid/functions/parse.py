"""Strict reading of numbers: the whole text is the number (no line end after it either), or the result is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a whole text, and the same as expressions that find nothing less.
U64_FORM = r"[0-9]{1,20}"
DOUBLE_FORM = r"-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
U64, DOUBLE = rf"\A{U64_FORM}\z", rf"\A{DOUBLE_FORM}\z"


def parse_u64(text: Column) -> Column:
    """An unsigned 64-bit number as decimal(20,0): digits only, no sign, spaces or rest."""
    number = F.when(text.rlike(U64), text).try_cast("decimal(20,0)")
    return F.when(number < F.lit(str(1 << 64)).cast("decimal(20,0)"), number)


def parse_size(text: Column) -> Column:
    """A count that fits a long."""
    number = parse_u64(text)
    return F.when(number < F.lit(str(1 << 63)).cast("decimal(20,0)"), number).try_cast("long")


def parse_finite(text: Column) -> Column:
    """A double in plain or exponent form that is finite."""
    number = F.when(text.rlike(DOUBLE), text).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)
