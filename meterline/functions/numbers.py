"""Lenient numbers: whatever is not a number counts as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of non-finite numbers that count as numbers, and
# numbers in digits, which may overflow.
_NON_FINITE = r"^[\x00-\x20]*[+-]?(?:NaN|Infinity)[\x00-\x20]*$|[0-9]"


def lenient_double(text: Column) -> Column:
    """Text to double; null, blank, ``null`` and anything unreadable give 0.0."""
    return double_or_zero(text.try_cast("double"), text)


def lenient_int(text: Column) -> Column:
    """Text to int: read as a double, round halves up, keep the low 32 bits.

    ``1.5`` gives 2 and ``-2.5`` gives -2; NaN gives 0. Numbers beyond 64 bits
    saturate first, so infinity gives -1.
    """
    return half_up_int(lenient_double(text))


def double_or_zero(number: Column, text: Column) -> Column:
    """Second half of ``lenient_double``, for a ``number`` already cast from ``text``.

    The cast trims white space and control characters by itself. It also takes
    ``inf`` and ``nan`` in any case, which are not numbers here; text such as
    ``1e999``, which overflows to infinity, is. Finite numbers take the first way.
    """
    finite = F.abs(number) < F.lit(float("inf"))
    return F.coalesce(F.when(finite | text.rlike(_NON_FINITE), number), F.lit(0.0))


def half_up_int(number: Column) -> Column:
    """Second half of ``lenient_int``, for a number that is not null."""
    whole = F.floor(number)
    rounded = F.when(number - whole < 0.5, whole).otherwise(F.ceil(number))
    return F.shiftright(F.shiftleft(rounded, 32), 32).cast("int")


CONTROL_AND_SPACE = "".join(chr(code) for code in range(0x21))


def trim_control(text: Column) -> Column:
    """Strip spaces, tabs and other control characters from both ends."""
    return F.trim(text, F.lit(CONTROL_AND_SPACE))
