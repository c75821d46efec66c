"""Aggregates that say on which date an extreme was reached.

Of several such dates the earliest counts, whatever the order of the input.  The value
and the date make one number, which orders the rows: a long for integers and rounded
returns, else a decimal of the bits of the double.  Both keep the aggregation buffer at a
fixed width, so that Spark aggregates by hash, before the shuffle already; a struct as the
order would make it sort all rows first.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as s

_DATE_BITS = 23  # days since 1970 up to the year 9999, with their sign
_DATE_SHIFT = 2 ** (_DATE_BITS - 1)
_NO_DATE = _DATE_SHIFT - 1  # after all dates
_DECIMAL_STEP = Decimal(10**8)
_LOWEST = -1022  # the least exponent of a double with all its digits


def first_by(value: Column | str, major: Column, minor: Column, minor_bits: int) -> Column:
    """``value`` of the row that comes first by the integers ``major``, then ``minor``.

    ``minor``, with its sign, always fits into ``minor_bits`` bits.  A ``major`` too
    large for the rest of a long goes into a decimal, which is exact but slow.  The
    smallest ``major`` of the group tells which of the two holds the first row.
    """
    limit = 2 ** (62 - minor_bits)
    fits = F.abs(major) < limit
    short = F.min_by(value, F.when(fits, major * 2**minor_bits + minor))
    long = F.min_by(value, F.when(~fits, s.packed(major, minor, minor_bits // 3)))
    return F.when(F.abs(F.min(major)) < limit, short).otherwise(long)


def date_of_min_count(value: str, date: str = s.DATE) -> Column:
    """Earliest date on which an integer column was smallest."""
    return first_by(date, F.col(value), F.unix_date(date), _DATE_BITS)


def date_of_max_count(value: str, date: str = s.DATE) -> Column:
    """Earliest date on which an integer column was largest."""
    return first_by(date, -F.col(value), F.unix_date(date), _DATE_BITS)


def ordered_bits(value: Column | str) -> Column:
    """A bigint that orders like a double: 0 for both zeros, NaN above all.

    It is the sign and the 63 other bits of the number, found by arithmetic that is exact:
    division by a power of two and multiplication by 2**52 round nothing.
    """
    value = F.col(value) if isinstance(value, str) else value
    size = F.abs(value)
    finite = size < float("inf")  # not so for NaN, which is above all numbers
    guess = F.greatest(F.floor(F.log2(F.when(finite & (size > 0), size))), F.lit(_LOWEST))
    power = F.pow(F.lit(2.0), guess)  # the logarithm may be off by a little
    exponent = guess + F.when(size >= power * 2, 1).when((size < power) & (guess > _LOWEST), -1).otherwise(0)
    digits = (size / F.pow(F.lit(2.0), exponent) * float(2**52)).cast("bigint")
    bits = (exponent - _LOWEST) * 2**52 + digits
    bits = F.when(size == 0, 0).when(finite, bits).when(F.isnan(size), 2**63 - 1).otherwise(2047 * 2**52)
    return F.when(value < 0, -bits).when(value.isNotNull(), bits)


def _tenthousandths(value: Column) -> tuple[Column, Column]:
    """Whether a double is a modest multiple of 1/10000, as rounded returns are, and how many."""
    units = F.round(value * 10000.0)
    return (units / 10000.0 == value) & (F.abs(units) < float(2 ** (62 - _DATE_BITS))), units


def _date_of(value: str, date: str, sign: int) -> Column:
    """Date of the smallest value, or with -1 as ``sign`` of the largest.

    Returns with four decimals and the date fit into one long.  Other numbers go by their
    bits into a decimal.  Which of the two holds the extreme follows from the extreme.
    """
    number = F.col(value).cast("double")
    modest, units = _tenthousandths(number)
    days = F.coalesce(F.unix_date(date), F.lit(_NO_DATE)) + _DATE_SHIFT
    short = F.min(F.when(modest, units.cast("bigint") * (sign * 2**_DATE_BITS) + days))

    def packed(x: Column) -> Column:
        return (ordered_bits(x) * sign).cast("decimal(19,0)") * _DECIMAL_STEP

    # Within a function of an array the long expression is evaluated and not compiled, which
    # for returns, of which few or none come here, takes longer than all the rest.
    bits = F.get(F.transform(F.array(number), packed), F.lit(0))
    long = F.min(F.when(~modest, bits + days.cast("decimal(8,0)")))
    extreme = F.min(number) if sign > 0 else F.max(number)
    last = F.pmod(long, F.lit(_DECIMAL_STEP)).cast("bigint")
    found = F.when(_tenthousandths(extreme)[0], F.pmod(short, F.lit(2**_DATE_BITS))).otherwise(last) - _DATE_SHIFT
    return F.date_from_unix_date(F.when(found != _NO_DATE, found).cast("int"))


def date_of_min(value: str, date: str = s.DATE) -> Column:
    """Earliest date on which a double column was smallest; null if that row has none."""
    return _date_of(value, date, 1)


def date_of_max(value: str, date: str = s.DATE) -> Column:
    """Earliest date on which a double column was largest; null if that row has none."""
    return _date_of(value, date, -1)
