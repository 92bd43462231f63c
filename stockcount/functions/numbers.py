"""Rounding on binary doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**26)


def decimals(col: Column | str, digits: int) -> Column:
    """Rounds the exact binary value, ties to even.

    ``round`` and ``format_string`` look at the shortest decimal text of a double, so 0.345 (which is
    stored slightly below) would go up. The value is split in two parts whose products with a power
    of ten are exact, which decides on which side of the midpoint it lies. Meant for magnitudes
    below about a thousand and at most six digits.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    a, factor = F.abs(c), F.lit(float(10**digits))
    hi = F.floor(a * F.lit(_SPLIT)).cast("double") / F.lit(_SPLIT)
    lo = a - hi
    near = F.floor(a * factor + F.lit(0.5)).cast("double")
    odd = near % F.lit(2.0) != 0
    below = (hi * factor - (near - F.lit(0.5))) + lo * factor
    above = (hi * factor - (near + F.lit(0.5))) + lo * factor
    fixed = (
        F.when((below < 0) | ((below == 0) & odd), near - F.lit(1.0))
        .when((above > 0) | ((above == 0) & odd), near + F.lit(1.0))
        .otherwise(near)
    )
    return F.signum(c) * fixed / factor
