"""Column expressions on text and small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from stockcount.scale import fits

#: The characters that separate words, and the pattern of a run of them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a narrow table that may be broadcast.
FEW_ROWS = 500_000


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null or blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def hashed(items: Column) -> Column:
    return F.transform(items, lambda x: F.xxhash64(x))


def grams(hashes: str, width: int) -> Column:
    """Hash of each run of ``width`` neighbours; ``hashes`` names a column, so that it is computed once."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, width)]))


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if a count finds few rows; joined by shuffling beyond. Narrow rows only."""
    return F.broadcast(df) if fits(df, most) else df


def hash_bound(count: int, wanted: int, least: int) -> int:
    """The 64-bit hash up to which about ``wanted`` of ``count`` rows lie; never below ``least``, the first hash there is."""
    return max(least, min((1 << 63) - 1, (wanted << 64) // max(count, 1) - (1 << 63)))


def private(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the caller can't clash with those an operator adds."""
    return df.select(*[F.col(n) for n in names])
