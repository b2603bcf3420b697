"""Data-quality checks (K1-K5).

Each check returns the offending rows or a small summary as a DataFrame, so
it runs distributed and composes with writes; callers count or show it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caremart.functions.cleaning import parse_date
from caremart.operators.scd import OPEN_END


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """K1: keys that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


def missing_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """K2: rows where any required column is null."""
    cond = F.col(columns[0]).isNull()
    for c in columns[1:]:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """K3: rows per value of a column (nulls form their own group)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def period_overlaps(df: DataFrame, key: str, start: str, end: str, id_col: str,
                    half_open: bool = False) -> DataFrame:
    """K5: rows whose validity period overlaps an earlier period of the same key.

    Rows of one key are ordered by (start, id).  A row overlaps when some
    earlier row ends on or after its start (a null end is open); with
    ``half_open`` periods are ``[start, end)``, so an earlier row must end
    after the start (SCD2 record validity: a version closed on the day the
    next one starts does not overlap it).  Computed
    without holding a key's rows in one task:

    1. per (key, start day): the latest end, and the smallest id among rows
       that reach their own start (any earlier same-day row of that kind
       overlaps every later one);
    2. a running maximum of the latest end over *distinct start days* of a
       key - at most one row per calendar day, however many rows the key has;
    3. rows joined back on (key, start day).
    """
    s = parse_date(F.col(start)) if dict(df.dtypes)[start] == "string" else F.col(start)
    e = parse_date(F.col(end)) if dict(df.dtypes)[end] == "string" else F.col(end)
    e = F.coalesce(e, F.lit(OPEN_END))
    rows = df.withColumns({"__s": s, "__e": e})

    def reaches(end_col, start_col):
        return end_col > start_col if half_open else end_col >= start_col

    days = (rows.groupBy(key, "__s")
            .agg(F.max("__e").alias("__day_end"),
                 F.min(F.when(reaches(F.col("__e"), F.col("__s")), F.col(id_col))).alias("__first_id")))
    w = Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__prev_end", F.max("__day_end").over(w))
    j = rows.join(days, [key, "__s"], "inner")
    overlap = (reaches(F.col("__prev_end"), F.col("__s"))
               | (F.col(id_col) > F.col("__first_id")))
    return j.where(overlap).select(*df.columns)
