"""Refreshed reports equal full runs, and a refresh opens only what changed."""

import os
import random

from pyspark.sql import functions as F

from caremart.operators import reports
from caremart.operators.enrich import enhance_claims
from caremart.operators.refresh import ReportStates
from caremart.plans.registry import wh
from caremart.sources.layout import LAYOUT_COLUMNS
from caremart.sources.versions import VersionedTable
from tests.conftest import SF_SMALL, rows


def _write(df, path, mode):
    (df.coalesce(1).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("service_year", "service_month").parquet(path))


def _same(states, claims):
    full = enhance_claims(claims.drop(*LAYOUT_COLUMNS))
    for mine, whole in ((states.gender_report(), reports.gender_report(full)), (states.race_report(), reports.race_report(full)),
                        (states.state_report(), reports.state_report(full))):
        assert sorted(mine.columns) == sorted(whole.columns)
        assert rows(mine.select(*whole.columns)) == rows(whole)


def test_append_correct_and_delete(spark, tmp_path):
    claims = wh(spark, SF_SMALL).claims_by_month
    undated = claims.limit(40).withColumns({"date_of_service": F.lit("soon"), "service_day": F.lit(None).cast("date"),
                                            "service_year": F.lit(None).cast("int"), "service_month": F.lit(None).cast("int")})
    undated = undated.withColumn("member_id", F.when(F.col("AGE") % 2 == 0, F.col("member_id")))
    early = claims.where("service_year < 1996")
    path = f"file://{tmp_path}/claims"
    _write(early.unionByName(undated), path, "append")
    states = ReportStates(spark, path, f"file://{tmp_path}/state")
    first, read = states.refresh()
    assert 0 in read and len(read) == 13 and first.number == 1
    _same(states, spark.read.parquet(path))
    assert states.refresh() == (first, [])

    # a month that did not change is not opened: its file is broken, with its size and time kept
    folder = tmp_path / "claims/service_year=1995/service_month=2"
    name = next(f for f in folder.iterdir() if f.name.endswith(".parquet"))
    whole, stat = name.read_bytes(), name.stat()
    name.write_bytes(bytes(len(whole)))
    os.utime(name, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    _write(claims.where("service_year = 1996 AND service_month <= 2"), path, "append")
    april = early.where("service_month = 4").withColumn("billed_amount", F.col("billed_amount") + 10).where("AGE > 20")
    _write(april.withColumn("member_id", F.concat(F.lit("n"), "member_id")), path, "overwrite")
    _, read = states.refresh()
    assert read == [1995 * 12 + 4, 1996 * 12 + 1, 1996 * 12 + 2]
    name.write_bytes(whole)
    os.utime(name, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    _same(states, spark.read.parquet(path))

    # a month that is gone no longer counts
    gone = tmp_path / "claims/service_year=1995/service_month=7"
    for f in gone.iterdir():
        f.unlink()
    gone.rmdir()
    _, read = states.refresh()
    assert read == []
    _same(states, spark.read.parquet(path))
    # members are numbered once, from 0, without gaps
    numbers = sorted(r["number"] for r in states.members.read().collect())
    assert numbers == list(range(len(numbers)))
    assert states.members.read().select("member_id").distinct().count() == len(numbers)


def test_members_beyond_one_bitmap(spark, tmp_path):
    """Several bitmaps a value: distinct members over 32,768 are still exact."""
    rnd = random.Random(1)
    claims = wh(spark, SF_SMALL).claims_by_month.limit(400)
    many = claims.crossJoin(spark.range(150)).withColumn("member_id", F.concat("claim_id", F.lit("-"), (F.col("id") % rnd.choice([97, 101])).cast("string"))).drop("id")
    path = f"file://{tmp_path}/claims"
    _write(many, path, "append")
    states = ReportStates(spark, path, f"file://{tmp_path}/state")
    states.refresh()
    assert states.states.read().select("bucket").distinct().count() > 1
    _same(states, spark.read.parquet(path))
    assert isinstance(states.members, VersionedTable)
