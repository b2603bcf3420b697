import os
import tempfile

from caremart.operators import scd
from caremart.streaming import apply_change_stream, latest_version
from tests.test_scd import COVER, PLAN, cover, started


def _folders():
    root = tempfile.mkdtemp(prefix="caremart-stream-")
    return tuple(os.path.join(root, d) for d in ("feed", "table", "ckpt"))


def test_change_stream_builds_versions(spark):
    feed, target, ckpt = _folders()
    cover(spark, (70, 62, "2020-05-01", None, "Deferred"), (71, 88, "2021-07-01", None, "Active")).write.parquet(f"{feed}/part1")
    stream = spark.readStream.schema(COVER).parquet(os.path.join(feed, "*"))
    q = apply_change_stream(stream, target, started(spark), ckpt, mode="scd2", as_of="2021-09-30", as_of_ts="2021-09-30 00:00:00")
    q.awaitTermination(120)
    out = latest_version(spark, target)
    assert sorted((r.member_id, r.eligibility_id) for r in out.where("is_current_record").collect()) == [
        (61, 501), (62, 70), (63, 503), (88, 71)]
    assert out.count() == 5 and scd.change_summary(out).count() == 3


def test_change_stream_scd1(spark):
    feed, target, ckpt = _folders()
    initial = spark.createDataFrame([("X1", "Quay Clinic", "Dock 4", 10), ("X2", "Hill House", "Summit", 20)], PLAN)
    spark.createDataFrame([("X2", "Hillside", "Summit", 99), ("X8", "Fen Ward", "Marsh", 5)], PLAN).write.parquet(f"{feed}/part1")
    stream = spark.readStream.schema(PLAN).parquet(os.path.join(feed, "*"))
    q = apply_change_stream(stream, target, initial, ckpt, mode="scd1", key="provider_id", update_columns=["name"])
    q.awaitTermination(120)
    out = {r.provider_id: tuple(r) for r in latest_version(spark, target).collect()}
    assert set(out) == {"X1", "X2", "X8"} and out["X2"] == ("X2", "Hillside", "Summit", 20)
