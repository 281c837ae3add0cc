"""Number formatting."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column, ties_to_even: bool = True) -> Column:
    """Text of ``x`` with one decimal, rounded from the exact binary value.

    10x is formed as 8x + 2x together with the rounding error of that sum, so
    that a value just below a tie is not taken for the tie.  Ties go to the even
    digit, or away from zero.
    """
    a = F.abs(x.cast("double"))
    p = a * 10
    error = a * 2 - (p - a * 8)
    whole = F.floor(p)
    side = (p - whole - 0.5) + error
    at_tie = (whole % 2 == 1) if ties_to_even else F.lit(True)
    tenths = (whole + F.when((side > 0) | ((side == 0) & at_tie), 1).otherwise(0)).cast("long")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)
