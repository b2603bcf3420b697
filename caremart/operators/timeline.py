"""Interval splitting: place changes among the stored versions of their keys by start date.

A type 2 table holds, per key, versions with a start and an end.  A change says what holds from
its start on.  Wherever it falls, also before versions that are stored already, it splits the
version in force there: that one ends at the change's start, the change ends where the next
version starts, and only the last version of a key is current.

Work per key is on *steps*: one row per key and start day, made by mergeable aggregates, so a
key never has more steps than there are calendar days, however many rows it has.  Windows run over
these narrow rows.  The table itself is scanned twice (the batch's keys; the new ends) and not
shuffled when the batch is small enough to broadcast.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.operators.joins import bounded_broadcast, bounded_like

FIRST_DAY = "0001-01-01"  # where a missing start is placed
LAST_DAY = _dt.date(9999, 12, 31)


@dataclass(frozen=True)
class Versions:
    """How a table keeps its versions.

    ``order`` ranks facts that share a key and a start (the greater one holds); ``open_end`` is the
    stored end of a current row; ``keep_repeats`` keeps a change that equals the version in force at
    its start (a change with the values *and* the start of the one that holds there is never kept); ``number`` is
    the column with the versions' numbers, if any.
    """

    key: str
    start: str
    end: str
    current: str
    values: tuple[str, ...]
    order: tuple[str, ...]
    open_end: _dt.date | None = None
    keep_repeats: bool = False
    number: str | None = None

    def until(self) -> Column:
        return F.coalesce(F.col(self.end).cast("date"), F.lit(LAST_DAY))


def _at(start: str | Column) -> Column:
    return F.coalesce(F.col(start) if isinstance(start, str) else start, F.lit(FIRST_DAY)).cast("date")


def placed(table: DataFrame, changes: DataFrame, v: Versions, start: str | Column | None = None,
           mark: Column | None = None) -> tuple[DataFrame, bool]:
    """The changes that become versions, with their place in their key's timeline.

    Columns: the key, ``row`` (the change), ``at``, ``next_at`` (null for the last version),
    ``nth`` (among the key's new versions), ``first`` (nothing of the key starts earlier),
    ``known`` (the table has the key), ``number`` (the key's greatest stored one, or null),
    ``marked`` (``mark`` is true for a stored row of the key).  Returned as a stored, measured frame and whether it may be
    broadcast.  Null keys are left out; of changes with one key and start the greatest by ``order``
    counts, and none that ranks below the stored version which holds from that start.
    """
    new = changes.where(F.col(v.key).isNotNull())
    asked, small = bounded_broadcast(new.select(
        v.key, _at(start if start is not None else v.start).alias("at"),
        F.struct(*v.order).alias("order"), F.struct(*v.values).alias("values"), F.struct(*new.columns).alias("row")))
    holds = F.struct((F.col("until") > F.col("at")).alias("live"), F.struct(*v.order).alias("order"),
                     F.struct(*v.values).alias("values"), "until")
    used = [c for c in dict.fromkeys((*v.order, *v.values)) if c != v.key]
    number = F.col(v.number) if v.number else F.lit(None).cast("int")
    stored = (table.join(bounded_like(asked.select(v.key).distinct(), small), v.key, "left_semi")
              .select(v.key, *used, _at(v.start).alias("at"), v.until().alias("until"), number.alias("number"),
                      (F.lit(False) if mark is None else mark).alias("marked"))
              .groupBy(v.key, "at").agg(F.max(holds).alias("stored"), F.max("number").alias("number"), F.max("marked").alias("marked")))
    change = asked.groupBy(v.key, "at").agg(F.max(F.struct("order", "values", "row")).alias("new"))
    steps = (stored.select("*", F.lit(None).cast(change.schema["new"].dataType).alias("new"))
             .unionByName(change, allowMissingColumns=True)
             .groupBy(v.key, "at").agg(*[F.max(c).alias(c) for c in ("stored", "number", "marked", "new")]))

    # what is in force behind each step, and before it; a stored row that ended at its own start holds nothing
    line = Window.partitionBy(v.key).orderBy("at")
    live = F.coalesce(F.col("stored.live"), F.lit(False))
    ranks = F.col("new").isNotNull() & (~live | (F.col("new.order") >= F.col("stored.order")))
    behind = F.when(ranks, F.struct(F.col("new.values").alias("values"), F.lit(LAST_DAY).alias("until"))) \
        .when(live, F.struct("stored.values", "stored.until"))
    steps = (steps.withColumns({"live": live, "ranks": ranks, "behind": behind})
             .withColumn("earlier", F.last("behind", ignorenulls=True)
                         .over(line.rowsBetween(Window.unboundedPreceding, -1))))
    same_start = F.col("live") & F.col("stored.values").eqNullSafe(F.col("new.values"))
    in_force = (~F.col("live") & (F.col("earlier.until") > F.col("at"))
                & F.col("earlier.values").eqNullSafe(F.col("new.values")))
    same = same_start if v.keep_repeats else same_start | F.coalesce(in_force, F.lit(False))
    kept = F.col("ranks") & ~same
    whole = Window.partitionBy(v.key)
    steps = (steps.withColumns({"kept": kept, "known": F.max(F.col("stored").isNotNull()).over(whole),
                                "number": F.max("number").over(whole),
                                "marked": F.coalesce(F.max("marked").over(whole), F.lit(False))})
             .where(F.col("kept") | F.col("live"))
             .withColumns({"next_at": F.lead("at").over(line), "first": F.lag("at").over(line).isNull() & ~F.col("live")}))
    found = (steps.where("kept").withColumn("nth", F.row_number().over(line))
             .select(v.key, F.col("new.row").alias("row"), "at", "next_at", "nth", "first", "known", "number", "marked"))
    return bounded_broadcast(found)


def closed_by(table: DataFrame, found: DataFrame, small: bool, v: Versions) -> DataFrame:
    """The table's rows, each ended where the first new version from its own start on starts.

    Also has ``__led`` : an earlier version was placed before the key's first one.
    """
    # the new starts of a key: at most one per calendar day, and no more than the batch has rows
    starts = bounded_like(found.groupBy(v.key).agg(F.array_sort(F.collect_list("at")).alias("__starts"),
                                                   F.max("first").alias("__led")), small)
    first = F.get(F.filter("__starts", lambda x: x >= _at(v.start)), F.lit(0))
    return (table.join(starts, v.key, "left")
            .withColumn("__close", F.when(first < v.until(), first))
            .withColumns({v.end: F.coalesce("__close", F.col(v.end)),
                          v.current: F.when(F.col("__close").isNotNull(), F.lit(False)).otherwise(F.col(v.current)),
                          "__led": F.coalesce("__led", F.lit(False))})
            .drop("__starts", "__close"))


def spans(found: DataFrame, v: Versions) -> dict[str, Column]:
    """Start, end and currency of the new versions."""
    return {v.end: F.coalesce("next_at", F.lit(v.open_end)).cast("date"), v.current: F.col("next_at").isNull()}


def columns_of(found: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in names]
