"""Predicates and row rewrites.

Filters are plain Column predicates so Catalyst can push them into the scan
(or, for parsed text dates, evaluate them right after it).  Key sets that are
frames are applied with semi-joins, never by collecting keys to the driver.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caremart.functions.cleaning import parse_date

def to_date_value(value) -> _dt.date:
    """Driver-side bound parsing: ISO or ``M/d/yyyy`` text, or a date."""
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    if isinstance(value, str):
        for fmt in ("%Y-%m-%d", "%m/%d/%Y"):
            try:
                return _dt.datetime.strptime(value.strip(), fmt).date()
            except ValueError:
                pass
    raise ValueError(f"not a date (expected YYYY-MM-DD or M/d/yyyy): {value!r}")


def in_date_range(c: str | Column, start=None, end=None, parse: bool = True) -> Column:
    """``start <= c <= end`` on dates; text columns are parsed first."""
    col = F.col(c) if isinstance(c, str) else c
    d = parse_date(col) if parse else col
    conds = []
    if start is not None:
        conds.append(d >= F.lit(to_date_value(start)))
    if end is not None:
        conds.append(d <= F.lit(to_date_value(end)))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """AND of membership, range and equality predicates.

    ``{col: [v, ...]}`` -> IN; ``{col: {"min": a, "max": b}}`` -> both bounds
    (either may be absent); ``{col: v}`` -> equality.  A ``None`` value is
    skipped; a bound of 0 is still applied.
    """
    conds = []
    for name, value in (filters or {}).items():
        c = F.col(name)
        if value is None:
            continue
        if isinstance(value, (list, tuple, set, frozenset)):
            conds.append(c.isin(*list(value)))
        elif isinstance(value, Mapping):
            if value.get("min") is not None:
                conds.append(c >= F.lit(value["min"]))
            if value.get("max") is not None:
                conds.append(c <= F.lit(value["max"]))
        else:
            conds.append(c == F.lit(value))
    return df.filter(all_of(conds)) if conds else df


def filter_keys(df: DataFrame, key: str, values, keep: bool = True) -> DataFrame:
    """Rows whose ``key`` is (or with ``keep=False`` is not) in ``values``.

    ``values`` may be a literal list (IN, pushed to the scan; for lists that a driver holds anyway) or a
    frame with a ``key`` column (semi/anti join, so the key set never visits the driver).
    Null keys in ``values`` match nothing, at any length and in either form;
    rows with a null key are therefore dropped by ``keep`` and kept without.
    """
    if isinstance(values, DataFrame):
        keys = values.select(F.col(key)).where(F.col(key).isNotNull())
        return df.join(keys, on=key, how="left_semi" if keep else "left_anti")
    values = [v for v in values if v is not None]
    cond = F.col(key).isin(*values)
    return df.filter(cond if keep else ~cond | F.col(key).isNull())


def rewrite_by_key(df: DataFrame, key: str, column: str, mapping) -> DataFrame:
    """Set ``column`` to ``mapping[key]`` where the key is mapped.

    A small dict becomes a ``CASE`` over literals.  A mapping given as a frame
    (``key``, ``column``) is left-joined with a match marker, so a key mapped
    to null is rewritten to null instead of falling back to the old value.
    """
    if isinstance(mapping, DataFrame):
        # a key mapped several times takes its greatest value, so rows never multiply
        m = mapping.groupBy(key).agg(F.max(column).alias("__new")).withColumn("__hit", F.lit(True))
        out = df.join(m, on=key, how="left")
        return out.withColumn(column, F.when(F.col("__hit"), F.col("__new"))
                              .otherwise(F.col(column))).drop("__new", "__hit").select(*df.columns)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(key) == F.lit(k), F.lit(v)) if expr is None
                else expr.when(F.col(key) == F.lit(k), F.lit(v)))
    if expr is None:
        return df
    return df.withColumn(column, expr.otherwise(F.col(column)))


def update_where(df: DataFrame, cond: Column | str, assignments: Mapping[str, object]) -> DataFrame:
    """``UPDATE df SET col = value, ... WHERE cond`` as a projection."""
    pred = F.expr(cond) if isinstance(cond, str) else cond
    new = {}
    for name, value in assignments.items():
        v = value if isinstance(value, Column) else F.lit(value)
        new[name] = F.when(pred, v).otherwise(F.col(name)).cast(df.schema[name].dataType)
    return df.withColumns(new)
