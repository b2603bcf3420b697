"""Row-level snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.functions.bands import SCHEMES, age_band


def paid_claims_snapshot(claims: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` paid claims (paid > 0) by claim id, four columns.

    The filter and the four-column projection reach the scan; the ordered
    limit runs as a per-task top-``n``.
    """
    return (claims.where(F.col("paid_amount") > 0)
            .select("claim_id", "ProviderID", "billed_amount", "paid_amount")
            .orderBy("claim_id").limit(n))


def age_bands(claims: DataFrame, age: str = "AGE") -> DataFrame:
    """Every claim's age under each banding scheme."""
    return claims.select("claim_id", age, *[age_band(age, s).alias(f"band_{s}") for s in SCHEMES])
