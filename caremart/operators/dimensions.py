"""Fact-to-dimension joins.

A point-in-time join is an equi-join on the business key with the date range
as a residual condition, so Spark plans it as a hash or sort-merge join (never
a nested loop).  Dimension sides are small per key; AQE's skew handling
splits a hot fact key across tasks and replicates its few dimension rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.operators.asof import as_of
from caremart.functions.cleaning import money_avg, money_sum, parse_date, safe_double
from caremart.functions.predicates import to_date_value
from caremart.sources.layout import day_of, in_days

OPEN_END = "9999-12-31"
UNREADABLE = _dt.date(1000, 1, 1)  # in place of an end that is no date: before every service date


def left_dimension(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                   columns: dict[str, str] | None = None) -> DataFrame:
    """Left join a dimension on one key, keeping ``columns`` (name -> alias)."""
    d = dim.select(F.col(dim_key).alias("__dk"),
                   *[F.col(c).alias(a) for c, a in (columns or {}).items()])
    return fact.join(d, fact[fact_key] == d["__dk"], "left").drop("__dk")


def as_of_join(fact: DataFrame, dim: DataFrame, fact_key, dim_key, fact_date,
               start: str, end: str, how: str = "left", open_end_null: bool = False,
               half_open: bool = False, current_only: str | None = None) -> DataFrame:
    """Attach the dimension row whose validity period holds the fact date.

    ``fact_key`` / ``dim_key`` / ``fact_date`` are column names or Columns of
    their own side.  Text dates are compared as dates.  ``open_end_null``
    treats a null end as open; ``half_open`` uses ``[start, end)``;
    ``current_only`` names a boolean column restricting the dimension to
    current rows.
    """
    f = fact.alias("__f")
    # the period is parsed once per dimension row, before the join
    since, until = (parse_date(c) if dict(dim.dtypes)[c] == "string" else F.col(c) for c in (start, end))
    if open_end_null:
        until = F.coalesce(until, F.lit(to_date_value(OPEN_END)))
    d = dim.where(F.col(current_only)) if current_only else dim
    d = d.withColumns({"__since": since, "__until": until}).alias("__d")
    fk = F.col(f"__f.{fact_key}") if isinstance(fact_key, str) else fact_key
    dk = F.col(f"__d.{dim_key}") if isinstance(dim_key, str) else dim_key
    fd = F.col(f"__f.{fact_date}") if isinstance(fact_date, str) else fact_date
    cond = (fk == dk) & (fd >= F.col("__d.__since")) & (
        fd < F.col("__d.__until") if half_open else fd <= F.col("__d.__until"))
    return f.join(d, cond, how).drop("__since", "__until")


def claims_with_dimensions(claims: DataFrame, eligibility: DataFrame, providers: DataFrame,
                           since="2024-01-01", max_bytes: int | None = None) -> DataFrame:
    """Claims since a date with the member's eligibility at the service
    date (point in time) and the provider's current attributes."""
    c = claims.where(in_days(claims, since)).withColumn("__dos", day_of(claims))
    e = eligibility.select(
        F.col("member_id").cast("string").alias("__emember"),
        "eligibility_status", "eligibility_start_date", "eligibility_end_date")
    periods = ("eligibility_start_date", "eligibility_end_date")
    # a missing end leaves the claim unmatched, as an inner comparison does
    j = as_of(c, e.where(F.col(periods[1]).isNotNull()), F.col("member_id"), F.col("__dos"), F.col("__emember"),
              parse_date(periods[0]), F.coalesce(parse_date(periods[1]), F.lit(UNREADABLE)),
              ["eligibility_status", *periods], max_bytes=max_bytes)
    j = left_dimension(j, providers, "ProviderID", "provider_id",
                       {"name": "provider_name", "specialty": "provider_specialty",
                        "practice_location": "practice_location", "is_pcp": "is_pcp"})
    return j.select(
        "claim_id", "member_id",
        safe_double("billed_amount").alias("billed_amount"),
        safe_double("paid_amount").alias("paid_amount"),
        "date_of_service", "Type_of_Service",
        "eligibility_status", "eligibility_start_date", "eligibility_end_date",
        "provider_name", "provider_specialty", "practice_location", "is_pcp")


def eligibility_impact(cwd: DataFrame) -> DataFrame:
    """Claims by eligibility status and service."""
    return (cwd.groupBy("eligibility_status", "Type_of_Service")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 money_sum("billed_amount").alias("total_billed"),
                 money_avg("billed_amount").alias("avg_billed"))
            .orderBy("eligibility_status", "Type_of_Service"))


def location_impact(cwd: DataFrame) -> DataFrame:
    """Claims by provider location and specialty; most billed first."""
    return (cwd.groupBy("practice_location", "provider_specialty")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 money_sum("billed_amount").alias("total_billed"),
                 F.countDistinct("member_id").alias("unique_patients"))
            .orderBy(F.col("total_billed").desc(), "practice_location", "provider_specialty"))
