"""Point-in-time lookup whose cost doesn't grow with the versions of a key.

A range join compares every fact with every version of its key.  Here each key's calendar is worked out
first: its fact days (each once, however many facts share it) and its version starts are put in one
order, and every fact day takes the last version that started.  That is one row per key and day, made
by mergeable aggregates, so a key never has more rows than there are calendar days.  Facts then
join their (key, day) by equality: a key with a third of all facts is spread over its days, and no pair
of a fact and a wrong version is ever formed.

Keys whose periods overlap have several versions on a day; their days (not their facts) are compared with
their versions, so every valid version is found, as a range join finds it.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.operators.joins import bounded_broadcast

LAST_DAY = _dt.date(9999, 12, 31)


def _valid(day: Column, since: Column, until: Column, half_open: bool) -> Column:
    return (day >= since) & ((day < until) if half_open else (day <= until))


def day_versions(days: DataFrame, versions: DataFrame, half_open: bool) -> DataFrame:
    """(key, day, row) of each distinct ``(key, day)`` and the versions valid on it.

    ``versions`` has key, since, until (never null) and row (a struct).
    """
    days = days.where(F.col("key").isNotNull() & F.col("day").isNotNull()).distinct()
    lasting = (F.col("since") < F.col("until")) if half_open else (F.col("since") <= F.col("until"))
    versions = versions.where(F.col("key").isNotNull() & lasting)

    # keys with two versions on one day: a second one from a start, or one that starts before another ends
    earlier = Window.partitionBy("key").orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    starts = versions.groupBy("key", "since").agg(F.count(F.lit(1)).alias("n"), F.max("until").alias("until"))
    reached = F.max("until").over(earlier)
    meets = (reached > F.col("since")) if half_open else (reached >= F.col("since"))
    tangled = (starts.withColumn("meets", meets).where((F.col("n") > 1) | F.col("meets")).select("key").distinct())
    tangled, _ = bounded_broadcast(tangled)

    line = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = versions.join(tangled, "key", "left_anti")
    marks = (plain.select("key", F.col("since").alias("day"), F.struct("until", "row").alias("version"), F.lit(False).alias("asked"))
             .unionByName(days.select("key", "day", F.lit(None).cast(plain.select(F.struct("until", "row").alias("v")).schema["v"].dataType)
                                      .alias("version"), F.lit(True).alias("asked")))
             .groupBy("key", "day").agg(F.max_by("version", F.col("version").isNotNull()).alias("version"), F.max("asked").alias("asked")))
    found = (marks.withColumn("version", F.last("version", ignorenulls=True).over(line))
             .where(F.col("asked") & ((F.col("day") < F.col("version.until")) if half_open else (F.col("day") <= F.col("version.until"))))
             .select("key", "day", F.col("version.row").alias("row")))
    knots = versions.join(tangled, "key", "left_semi").alias("v")
    knotted = (days.join(tangled, "key", "left_semi").alias("d")
               .join(knots, (F.col("d.key") == F.col("v.key")) & _valid(F.col("d.day"), F.col("v.since"), F.col("v.until"), half_open))
               .select("d.key", "d.day", "v.row"))
    return found.unionByName(knotted)


def as_of(facts: DataFrame, versions: DataFrame, fact_key: Column, fact_day: Column, key: Column, since: Column, until: Column,
          columns: Sequence[str], how: str = "left", half_open: bool = False, max_bytes: int | None = None) -> DataFrame:
    """The facts with ``columns`` of the version valid on their day (a null ``until`` is open).

    A version table within the broadcast threshold is sent to the facts, which then stay where they are;
    beyond it the lookup goes by (key, day).  Both give the same rows.
    """
    kept = versions.select(key.alias("key"), since.cast("date").alias("since"),
                           F.coalesce(until.cast("date"), F.lit(LAST_DAY)).alias("until"), F.struct(*columns).alias("row"))
    kept, small = bounded_broadcast(kept, max_bytes)
    rows = facts.withColumns({"__key": fact_key, "__day": fact_day})
    if small:
        found = kept.select(F.col("key").alias("__k"), F.col("since").alias("__s"), F.col("until").alias("__u"), F.col("row").alias("__row"))
        cond = (F.col("__key") == F.col("__k")) & _valid(F.col("__day"), F.col("__s"), F.col("__u"), half_open)
        joined = rows.join(F.broadcast(found), cond, how).drop("__k", "__s", "__u")
    else:
        found = day_versions(rows.select(F.col("__key").alias("key"), F.col("__day").alias("day")), kept, half_open)
        joined = rows.join(found.select(F.col("key").alias("__key"), F.col("day").alias("__day"), F.col("row").alias("__row")),
                           ["__key", "__day"], how)
    return joined.select(*facts.columns, *[F.col("__row").getField(c).alias(c) for c in columns])
