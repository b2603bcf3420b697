"""SQL text helpers for oracle statements (ANSI SQL that DuckDB runs).

They spell, in SQL, the same exact arithmetic the DataFrame operators use:
money sums in decimal(18,4), averages from those sums, x/0 -> null.
"""

from __future__ import annotations


def msum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def mavg(x: str) -> str:
    return f"({msum(x)} / NULLIF(COUNT({x}), 0))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"


def iavg(x: str) -> str:
    """Average of an integer column (exact integer sum / count)."""
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def mdy(x: str) -> str:
    """Parse ``M/d/yyyy`` text; bad text -> null."""
    return f"CAST(try_strptime({x}, '%m/%d/%Y') AS DATE)"


def iso(x: str) -> str:
    """Parse ``yyyy-MM-dd`` text; bad text -> null."""
    return f"CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)"


def any_date(x: str) -> str:
    return f"COALESCE({iso(x)}, {mdy(x)})"


def favg(x: str, digits: int = 14) -> str:
    """Average of a double accumulated in units of 10^-digits (order-independent)."""
    scale = f"1e{digits}"
    return (f"(CAST(SUM(CAST(round({x} * {scale}) AS DECIMAL(38,0))) AS DOUBLE) "
            f"/ NULLIF(COUNT({x}) * {scale}, 0))")
