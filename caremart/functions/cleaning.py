"""Column functions for cleaning claims text (P2, P3, P17) and exact money math.

Everything here returns a ``Column`` made of built-in expressions, so it stays
inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text markers that mean "missing" in claims extracts, and
# the two date layouts found in them.
NULL_SENTINELS = ("NULL", "")
ISO_DATE = "yyyy-MM-dd"
US_DATE = "M/d/yyyy"

# Money is summed as a decimal of eight places, so totals are exact and do not
# depend on how rows are split over tasks.  A ninth decimal place would be
# rounded; an amount of 1e20 or more raises an error.
MONEY = "decimal(28,8)"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_sentinel(c: str | Column, sentinels: Sequence[str] = NULL_SENTINELS) -> Column:
    """Null, ``"NULL"`` or ``""`` -> null; other values unchanged."""
    c = _c(c)
    return F.when(c.isin(*sentinels), F.lit(None)).otherwise(c)


def parse_date(c: str | Column, formats: Sequence[str] = (ISO_DATE, US_DATE)) -> Column:
    """First format that parses; unparseable text -> null (never raises).

    Sentinel text is nulled first: it can never parse, and skipping it keeps
    the parser off its (slow) failure path for the most common bad value.
    """
    c = _c(c)
    c = null_sentinel(c)
    parsed = [F.try_to_date(c, f) for f in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def safe_long(c: str | Column) -> Column:
    """``try_cast(x AS BIGINT)``; bad text -> null."""
    return _c(c).try_cast("bigint")


def safe_double(c: str | Column) -> Column:
    """``try_cast(x AS DOUBLE)``."""
    return _c(c).try_cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """x / y with x/0 -> null (pre-ANSI division semantics)."""
    return F.try_divide(_c(num), _c(den))


def money_sum(c: str | Column) -> Column:
    """Exact sum of an amount column, returned as double."""
    return F.sum(_c(c).cast(MONEY)).cast("double")


def money_round_sum(c: str | Column, digits: int = 2) -> Column:
    """Exact sum rounded half-up to ``digits`` decimals, returned as double."""
    return F.round(F.sum(_c(c).cast(MONEY)), digits).cast("double")


def money_avg(c: str | Column) -> Column:
    """Average of an amount column (nulls ignored) from the exact sum."""
    return F.try_divide(money_sum(c), F.count(_c(c)))


def fixed_avg(c: str | Column, digits: int = 14) -> Column:
    """Order-independent average of a non-money double (e.g. a rate).

    A double sum depends on the order rows are added, so the same query can
    differ in its last bits between runs or cluster shapes.  Each value is
    rounded to ``digits`` decimals and accumulated as a whole number of those
    units in a decimal (no overflow at any row count); the mean is within
    half a unit of the exact one and identical however the rows are split.
    """
    c = _c(c)
    scale = 10.0 ** digits
    units = F.round(c * F.lit(scale)).cast("decimal(38,0)")
    return F.try_divide(F.sum(units).cast("double"), F.count(c) * F.lit(scale))


def flag(cond: Column) -> Column:
    """0/1 indicator; a null condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
