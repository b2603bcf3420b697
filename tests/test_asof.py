"""Point-in-time lookups: both ways against brute force, and the plan of the one for large tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caremart.operators import scd
from caremart.operators.asof import as_of

DAY0 = dt.date(2021, 1, 1)


def _rows(seed, overlapping):
    rnd = random.Random(seed)
    versions, facts = [], []
    for key in "abcde":
        at = 0
        for n in range(6):
            size = rnd.randint(0, 9)
            until = None if n == 5 and key != "b" else at + size
            versions.append((key, at, until, f"{key}{n}"))
            at += size + rnd.choice([0, 0, 3]) - (rnd.choice([0, 4]) if overlapping and key in "ad" else 0)
            at = max(at, 0)
    versions += [(None, 0, None, "null"), ("e", 5, 2, "never")]
    facts = [(i, "a" if i % 3 == 0 else rnd.choice("abcdez"), rnd.randint(-2, 45)) for i in range(300)]
    facts += [(900, None, 3), (901, "a", None)]
    return versions, facts


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("half_open", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_both_ways_equal_brute_force(spark, overlapping, half_open, how):
    versions, facts = _rows(3 + overlapping, overlapping)
    day = lambda c: F.date_add(F.lit(DAY0), F.col(c))
    v = spark.createDataFrame(versions, "k string, s int, e int, name string").select("k", day("s").alias("s"), day("e").alias("e"), "name")
    f = spark.createDataFrame(facts, "id int, k string, d int").select("id", "k", day("d").alias("d"))
    want = set()
    for i, k, d in facts:
        hits = [n for q, s, e, n in versions if k is not None and q == k and d is not None and d >= s and (e is None or (d < e if half_open else d <= e))]
        want |= {(i, n) for n in hits or ([None] if how == "left" else [])}
    for limit in (None, -1):
        got = as_of(f, v, F.col("k"), F.col("d"), F.col("k"), F.col("s"), F.col("e"), ["name"], how, half_open, limit)
        assert got.columns == ["id", "k", "d", "name"]
        rows = [(r["id"], r["name"]) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_large_dimensions_are_joined_by_key_and_day(spark):
    kind = "provider_key int, provider_id string, start_date date, end_date date"
    dim = spark.createDataFrame([(i, "P", DAY0 + dt.timedelta(i), DAY0 + dt.timedelta(i + 1)) for i in range(200)]
                                + [(1000 + i, f"Q{i}", DAY0, None) for i in range(50)], kind)
    facts = spark.range(3000).select(F.col("id").alias("claim"), F.when(F.col("id") % 3 == 0, "P").otherwise(
        F.concat(F.lit("Q"), F.col("id") % 60)).alias("provider_id"), F.date_add(F.lit(DAY0), (F.col("id") % 250).cast("int")).alias("claim_date"))
    keyed = scd.assign_dim_key(facts, dim, max_bytes=-1)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 1 and "__day" in joins[0] and ">=" not in joins[0]
    plain = scd.assign_dim_key(facts, dim)
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, plain.collect()))
    # the hot provider's facts are dealt by day as well
    spread = facts.where("provider_id = 'P'").groupBy(F.pmod(F.hash("provider_id", "claim_date"), F.lit(8))).count().count()
    assert spread == 8
