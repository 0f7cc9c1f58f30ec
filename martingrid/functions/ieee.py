"""The 64 bits of a double, and little-endian bytes, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: bits of the fraction, and what is added to exponents.
FRACTION, BIAS = 52, 1023


def double_bits(x: Column) -> Column:
    """The bits of a double as a long; -0 has its sign, every NaN the same bits (quiet, positive, no payload), null stays null.

    Spark takes the call for not deterministic and forms it wherever it is named: name
    it once in a select, and read that column.
    """
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double"))
    return F.when(x.isNotNull(), bits.cast("long"))


def little_endian(n: Column, size: int = 8) -> Column:
    """The lowest ``size`` bytes of a long, the lowest first, as hexadecimal digits; ``n`` is read several times."""

    def swapped(x: Column, bits: int, mask: int) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(mask)), bits).bitwiseOR(F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(mask)))

    halves = swapped(swapped(n.cast("long"), 8, 0x00FF00FF00FF00FF), 16, 0x0000FFFF0000FFFF)
    digits = F.lpad(F.hex(F.shiftleft(halves, 32).bitwiseOR(F.shiftrightunsigned(halves, 32))), 16, "0")
    return digits if size == 8 else F.substring(digits, 1, 2 * size)
