"""Age banding.

Four schemes are in use.  All are native ``CASE`` chains, so they compile into
the surrounding stage; the SQL function registered by ``register_functions``
is a SQL UDF that Catalyst inlines the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Band labels of each scheme (exact text is part of the output).
BASIC = ("Unknown", "Pediatric", "Adult", "Senior")
DETAILED = ("Unknown", "Invalid", "Pediatric (0-17)", "Young Adult (18-34)", "Adult (35-54)",
            "Mature Adult (55-64)", "Senior (65+)")
DECADE = ("Under 18", "18-34", "35-54", "55-64", "65+")

SCHEMES = ("basic", "basic_lenient", "detailed", "decade")


def age_band(age: str | Column, scheme: str = "basic") -> Column:
    """Age band of ``age`` under ``scheme``.

    * ``basic``: null Unknown; <18 Pediatric; <65 Adult; else Senior.
    * ``basic_lenient``: as basic, but null falls through to Senior.
    * ``detailed``: null Unknown; <0 or >120 Invalid; 0-17, 18-34, 35-54,
      55-64, 65+ with descriptive labels.
    * ``decade``: <18 Under 18; 18-34; 35-54; 55-64; everything else,
      null included, 65+.
    """
    a = F.col(age) if isinstance(age, str) else age
    if scheme == "basic":
        return (F.when(a.isNull(), BASIC[0]).when(a < 18, BASIC[1])
                .when(a < 65, BASIC[2]).otherwise(BASIC[3]))
    if scheme == "basic_lenient":
        return F.when(a < 18, BASIC[1]).when(a < 65, BASIC[2]).otherwise(BASIC[3])
    if scheme == "detailed":
        return (F.when(a.isNull(), DETAILED[0])
                .when((a < 0) | (a > 120), DETAILED[1])
                .when(a < 18, DETAILED[2])
                .when(a <= 34, DETAILED[3])
                .when(a <= 54, DETAILED[4])
                .when(a <= 64, DETAILED[5])
                .otherwise(DETAILED[6]))
    if scheme == "decade":
        return (F.when(a < 18, DECADE[0]).when(a.between(18, 34), DECADE[1])
                .when(a.between(35, 54), DECADE[2]).when(a.between(55, 64), DECADE[3])
                .otherwise(DECADE[4]))
    raise ValueError(f"unknown age-band scheme {scheme!r}; expected one of {SCHEMES}")


def age_band_sql(arg: str, scheme: str = "detailed") -> str:
    """The ``detailed`` (or other) scheme as SQL text over expression ``arg``."""
    if scheme == "detailed":
        d = DETAILED
        return (f"CASE WHEN {arg} IS NULL THEN '{d[0]}' WHEN {arg} < 0 OR {arg} > 120 THEN '{d[1]}' "
                f"WHEN {arg} < 18 THEN '{d[2]}' WHEN {arg} <= 34 THEN '{d[3]}' "
                f"WHEN {arg} <= 54 THEN '{d[4]}' WHEN {arg} <= 64 THEN '{d[5]}' ELSE '{d[6]}' END")
    if scheme == "decade":
        d = DECADE
        return (f"CASE WHEN {arg} < 18 THEN '{d[0]}' WHEN {arg} BETWEEN 18 AND 34 THEN '{d[1]}' "
                f"WHEN {arg} BETWEEN 35 AND 54 THEN '{d[2]}' WHEN {arg} BETWEEN 55 AND 64 THEN '{d[3]}' "
                f"ELSE '{d[4]}' END")
    if scheme == "basic":
        b = BASIC
        return (f"CASE WHEN {arg} IS NULL THEN '{b[0]}' WHEN {arg} < 18 THEN '{b[1]}' "
                f"WHEN {arg} < 65 THEN '{b[2]}' ELSE '{b[3]}' END")
    if scheme == "basic_lenient":
        b = BASIC
        return f"CASE WHEN {arg} < 18 THEN '{b[1]}' WHEN {arg} < 65 THEN '{b[2]}' ELSE '{b[3]}' END"
    raise ValueError(f"unknown age-band scheme {scheme!r}")


def register_functions(spark: SparkSession, name: str = "age_group", scheme: str = "detailed") -> str:
    """make the banding callable from SQL as ``age_group(AGE)``.

    Registered as a SQL function (not a Python UDF): Catalyst inlines its body,
    so SQL users get the same codegen'd plan as the DataFrame API.
    """
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(age INT) RETURNS STRING "
              f"RETURN {age_band_sql('age', scheme)}")
    return name
