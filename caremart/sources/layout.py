"""Claims stored by service month.

The text date of a claim is parsed once, when the table is written: ``service_day`` is the typed
date, ``service_year`` and ``service_month`` name its folder.  A date range then reads the folders it
touches (``PartitionFilters``) and compares typed days inside them.  Claims whose date is missing or
unreadable lie in a folder of their own, which no range touches.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.functions.cleaning import parse_date
from caremart.functions.predicates import all_of, in_date_range, to_date_value
from caremart.session import set_conf

DAY, YEAR, MONTH = "service_day", "service_year", "service_month"
LAYOUT_COLUMNS = (DAY, YEAR, MONTH)


def with_month(df: DataFrame, date_col: str = "date_of_service") -> DataFrame:
    """The frame with its typed day and the two folder columns."""
    return df.withColumn(DAY, parse_date(date_col)).withColumns({YEAR: F.year(DAY), MONTH: F.month(DAY)})


CODEC = "zstd"  # claims are wide and much alike: fewer bytes than with the session's codec
OPEN_MONTHS = 100  # folders that a task writes at a time before it sorts the rest of its rows


def open_folders(spark: SparkSession):
    """Writes inside keep a file open per folder instead of sorting a task's whole rows by folder first."""
    return set_conf(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_MONTHS)})


def write_gathered(df: DataFrame, path: str, date_col: str = "date_of_service") -> None:
    """As ``write_by_month``, for rows that lie together by month already: no exchange and no sort."""
    with open_folders(df.sparkSession):
        with_month(df, date_col).write.option("compression", CODEC).partitionBy(YEAR, MONTH).parquet(path)


def write_by_month(df: DataFrame, path: str, date_col: str = "date_of_service") -> None:
    """Write ``df`` below ``path``, a folder a month.

    ``rebalance`` gathers a month into few files of the advisory size and splits a month that
    holds much more than the others, so neither tiny files nor one giant task come out.
    """
    with_month(df, date_col).hint("rebalance", YEAR, MONTH).write.partitionBy(YEAR, MONTH).parquet(path)


def has_months(df: DataFrame) -> bool:
    return set(LAYOUT_COLUMNS) <= set(df.columns)


def day_of(df: DataFrame, date_col: str = "date_of_service") -> Column:
    """The typed date: stored where the frame has it, else parsed from the text."""
    return F.col(DAY) if has_months(df) else parse_date(date_col)


def in_days(df: DataFrame, start=None, end=None, date_col: str = "date_of_service") -> Column:
    """P15 for a frame that may be stored by month: ``start <= day <= end``, with the same bounds on
    the folder columns."""
    if not has_months(df):
        return in_date_range(date_col, start, end)
    conds = [in_date_range(F.col(DAY), start, end, parse=False)]
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            conds += _folders(to_date_value(bound), after)
    return all_of(conds)


def _folders(bound: _dt.date, after: bool) -> list[Column]:
    """Conditions on whole years and months alone; the first one is all that a catalog needs to prune."""
    number = F.col(YEAR) * 12 + F.col(MONTH)
    at = bound.year * 12 + bound.month
    return [F.col(YEAR) >= bound.year, number >= at] if after else [F.col(YEAR) <= bound.year, number <= at]
