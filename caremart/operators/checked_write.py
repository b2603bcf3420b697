"""Quality checks in the job that stores a table (K2, K4).

The rows are read once: while they are written, ``Observation`` s count them, and rows that lack a
required value go to a folder of their own, so readers of the table never see them and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

REJECTED = "rejected"


@dataclass(frozen=True)
class CheckedWrite:
    """What a checked write stored and counted."""

    accepted: DataFrame
    rejected: DataFrame
    metrics: Mapping[str, int]


def write_checked(df: DataFrame, path: str, required: Sequence[str], counted: Sequence[str] = ()) -> CheckedWrite:
    """Store ``df`` below ``path``, apart by whether all ``required`` columns have a value.

    Metrics: ``rows``, ``rejected``, ``missing_<c>`` of every required column and ``present_<c>`` of every
    column in ``counted`` (the counts of K2 and K4).
    """
    if not required:
        raise ValueError("at least one column must be required")
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    seen = Observation()
    marked = df.withColumn(REJECTED, lacks).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(REJECTED).alias("rejected"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required],
        *[F.count(F.col(c)).alias(f"present_{c}") for c in counted])
    marked.write.partitionBy(REJECTED).parquet(path)
    stored = df.sparkSession.read.schema(marked.schema).parquet(path)
    return CheckedWrite(stored.where(f"NOT {REJECTED}").drop(REJECTED), stored.where(REJECTED).drop(REJECTED), dict(seen.get))
