"""Decimal rounding of doubles, decided on the exact binary value.

``F.round`` and ``F.bround`` decide ties on the shortest decimal text of a
double, so 2.675 becomes 2.68 although the double lies below 2.675.  Here the
value is split into its float part and the rest; the products of both with the
small scale are exact, and so is the comparison with the midpoint.  All of it is
plain arithmetic and stays inside whole-stage codegen.  The value appears several
times in the result, so callers compute it as a column of its own first.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col

# Below any non-zero distance from a midpoint, above zero.
_TINY = 1e-300


def _distance(x: Column, n: Column, scale: float) -> Column:
    """``2 * scale * x - (2 * n + 1)`` with the right sign, and zero only at the midpoint."""
    high = x.cast("float").cast("double")
    twice = F.lit(2.0 * scale)
    return (high * twice - (n * F.lit(2.0) + F.lit(1.0))) + (x - high) * twice


def round_2(value: Column | str) -> Column:
    """Two decimals, exact ties to even; for values from 0 up to about 1e13."""
    x = as_col(value)
    n = F.floor(x * F.lit(100.0)).cast("double")
    # An odd n goes up at the midpoint too.
    up = _distance(x, n, 100.0) > (n % F.lit(2.0)) * F.lit(-_TINY)
    return (n + up.cast("double")) / F.lit(100.0)


def text_1(value: Column | str) -> Column:
    """One decimal as text, exact ties upward; for values from 0 up to about 1e14."""
    x = as_col(value)
    n = F.floor(x * F.lit(10.0)).cast("double")
    up = _distance(x, n, 10.0) >= 0
    return ((n + up.cast("double")) / F.lit(10.0)).cast("decimal(20,1)").cast("string")


def hundredths(units: Column | str, shift: Column) -> Column:
    """``100 * units / 2**shift`` for whole units, rounded with ties to even."""
    scaled = as_col(units) * F.lit(100).cast("bigint")
    one = F.lit(1).cast("bigint")
    half = F.call_function("shiftleft", one, shift - F.lit(1))
    odd = F.call_function("shiftright", scaled, shift).bitwiseAND(one)
    return F.call_function("shiftright", scaled + (half - one) + odd, shift)
