"""Text rendering of names and numbers in reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round by one multiplication, one floor and one division: the same double in every engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent_text(share: Column) -> Column:
    """``100·share`` with two decimals, rounding the binary value itself, exact ties to even.

    ``format_string`` rounds the shortest decimal text of the double half up, which
    differs on values such as 33.125.  Here the fraction is counted in units of 2^-62 and
    multiplied by 100 in two 31-bit halves, so every comparison is between integers.
    """
    mask = F.lit((1 << 31) - 1).cast("bigint")
    half = F.lit(1 << 30).cast("bigint")
    value = share * F.lit(100.0)
    whole = F.floor(value)
    fraction = (value - whole) * F.lit(float(1 << 62))
    units = fraction.cast("bigint")
    low = units.bitwiseAND(mask) * 100
    high = F.shiftright(units, 31) * 100 + F.shiftright(low, 31)
    cents = F.shiftright(high, 31)
    rest = high.bitwiseAND(mask)
    beyond = (low.bitwiseAND(mask) > 0) | (fraction > units)
    up = (rest > half) | ((rest == half) & (beyond | (cents % 2 == 1)))
    total = whole * 100 + cents + up.cast("bigint")
    return F.concat(
        F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0")
    )


def last_word(name: Column) -> Column:
    """Text after the last space; a name without a space is returned whole."""
    return F.split_part(name, F.lit(" "), F.lit(-1))
