"""Words, lines and small helpers as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after lower-casing: digits, a-z and all beyond ASCII
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z only; letters beyond ASCII keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(items: Column, size: int) -> Column:
    """A 64-bit hash of each run of ``size`` (a power of two) consecutive items, by doubling: log2(size) passes instead of slices."""
    def doubled(hashes: Column, step: int) -> Column:
        pairs = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step)))
        return let(hashes, pairs if 2 * step == size else lambda h: doubled(pairs(h), 2 * step))

    return doubled(F.transform(items, lambda x: F.xxhash64(x)), 1)
