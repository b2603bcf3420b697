import pytest
from pyspark.sql import functions as F

from caremart.operators import scd
from caremart.sources import load_or_init_scd2, preview, register_view, write_path, write_table
from caremart.sources.tables import Warehouse
from tests.conftest import SF_SMALL, rows
from tests.test_scd import cover, started


def test_write_table_self_overwrite(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    t = write_table(df, "cm_t_providers")
    # rewrite the table from itself: staged, then copied into place
    t2 = write_table(t.withColumn("v", F.upper("v")), "cm_t_providers")
    assert rows(t2) == [(1, "A"), (2, "B")]


def test_load_or_init_and_views(spark):
    base = started(spark).select("eligibility_id", "member_id", "eligibility_start_date", "eligibility_status")
    cur = load_or_init_scd2(spark, "cm_t_elig_scd2", base, scd.scd2_init)
    assert "is_current_record" in cur.columns and cur.count() == 3
    write_table(cur, "cm_t_elig_scd2")
    again = load_or_init_scd2(spark, "cm_t_elig_scd2", base.limit(1), scd.scd2_init)
    assert again.count() == 3
    register_view(again, "cm_t_view")
    assert spark.table("cm_t_view").count() == 3


def test_warehouse_tables_and_preview(spark, tmp_path):
    w = Warehouse(spark, SF_SMALL)
    assert w.table("workspace.default.claims").count() == w.claims.count()
    assert w.fact_pharm.columns == w.pharmacy_claims.columns
    p = preview(w.claims, 3, ["claim_id"]).collect()
    assert [r.claim_id for r in p] == sorted(r.claim_id for r in p)
    back = write_path(w.providers, str(tmp_path / "prov"))
    assert back.count() == w.providers.count()


def test_whole_scd_runs_chain(spark):
    base = started(spark).select(*cover(spark).columns)
    batch = cover(spark, (800, 61, "2021-02-01", None, "Terminated"), (801, 92, "2021-03-01", None, "Active"))
    stored, summary = scd.run_scd2(spark, "cm_t_run_elig", base, batch, as_of="2021-09-30")
    assert stored.count() == 3 + 2
    assert {r.change_reason: r["count"] for r in summary.collect()}["New Enrollment"] == 1
    # a second run with the same batch adds nothing
    again, _ = scd.run_scd2(spark, "cm_t_run_elig", base, batch, as_of="2021-12-31")
    assert again.count() == 5
    prov = spark.createDataFrame([("PR1", "a"), ("PR2", "b")], "provider_id string, name string")
    write_table(prov, "cm_t_run_prov")
    chg = spark.createDataFrame([("PR2", "b2"), ("PR3", "c")], "provider_id string, name string")
    out, s = scd.run_scd1(spark, "cm_t_run_prov", chg)
    assert rows(out) == [("PR1", "a"), ("PR2", "b2"), ("PR3", "c")]
    first = s.first()
    assert (first.total_after, first.new_records, first.updated_records) == (3, 1, 1)


def test_whole_runs_commit_versions(spark, tmp_path):
    from caremart.sources.versions import VersionedTable

    base = started(spark).select(*cover(spark).columns)
    table = VersionedTable(spark, f"file://{tmp_path}/elig")
    batch = cover(spark, (800, 61, "2021-02-01", None, "Terminated"), (801, 92, "2021-03-01", None, "Active"))
    first = scd.run_scd2_versions(table, base, batch, as_of="2021-09-30")
    assert (first.number, first.notes) == (2, {"Initial Load": 3, "Coverage Terminated": 1, "New Enrollment": 1})
    second = scd.run_scd2_versions(table, base, batch, as_of="2021-12-31")
    assert (second.number, second.notes) == (3, first.notes)
    assert rows(table.read(second).drop("created_timestamp")) == rows(table.read(first).drop("created_timestamp"))
    sites = VersionedTable(spark, f"file://{tmp_path}/prov")
    sites.write(spark.createDataFrame([("K1", "a"), ("K2", "b")], "provider_id string, name string"), None)
    changes = spark.createDataFrame([("K2", "b2"), ("K3", "c"), (None, "x")], "provider_id string, name string")
    done = scd.run_scd1_versions(sites, changes)
    assert done.notes == {"records_processed": 2, "new_records": 1, "updated_records": 1}
    assert rows(sites.read()) == [("K1", "a"), ("K2", "b2"), ("K3", "c")]


# -- committed versions ---------------------------------------------------------

def test_versions_are_read_as_they_were(spark, tmp_path):
    from caremart.sources.versions import VersionConflict, VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.current() is None and table.history() == []
    with pytest.raises(LookupError):
        table.read()
    one = table.load_or_init(lambda: spark.range(3))
    assert table.load_or_init(lambda: spark.range(99)) == one
    pinned = table.read()
    two = table.write(table.read(one).where("id > 0"), one, {"dropped": 1})
    assert (two.number, table.current(), two.notes) == (2, two, {"dropped": 1})
    assert pinned.count() == 3 and table.read().count() == 2 and table.read(one).count() == 3
    # whoever started from version 1 comes too late, whether it looks first or runs into the file
    with pytest.raises(VersionConflict):
        table.write(spark.range(5), one)
    rival = VersionedTable(spark, table.path)
    rival.current = lambda: one
    rival._names = lambda below: ["000000000001"]
    with pytest.raises(VersionConflict):
        rival.write(spark.range(5), one)
    assert table.read().count() == 2
    # a commit that broke off is none, and its number is left out
    (tmp_path / "t/commits/000000000003").write_text('{"folder": "da')
    assert table.current() == two and table.write(spark.range(7), two).number == 4
    assert sorted(table.retain(last=1, grace_seconds=3600)) == sorted([one.folder, two.folder])
    assert table.read().count() == 7 and len(table.retain(last=1, grace_seconds=-1)) == 2  # the two rejected ones


DIES = """
import os, signal, sys
sys.path.insert(0, {repo!r})
from caremart.session import get_session
from caremart.sources.versions import VersionedTable
spark = get_session("local[1]", 1)
table = VersionedTable(spark, {path!r})
table.publish = lambda *a, **kw: os.kill(os.getpid(), signal.SIGKILL)
table.write(table.read().where("id < 0"), table.current())
"""


def test_a_writer_killed_before_its_commit_changes_nothing(spark, tmp_path):
    import os
    import subprocess
    import sys

    from caremart.sources.versions import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.write(spark.range(4), None)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", DIES.format(repo=repo, path=table.path)], capture_output=True, timeout=180)
    assert done.returncode == -9
    assert len(list((tmp_path / "t/data").iterdir())) == 2  # the staged rows lie there, in no version
    assert table.read().count() == 4 and len(table.history()) == 1
    assert table.write(spark.range(6), table.current()).number == 2
    assert len(table.retain(last=2, grace_seconds=-1)) == 1 and table.read().count() == 6


# -- claims by month ----------------------------------------------------------------

def test_claims_by_month(spark, tmp_path):
    from caremart.sources.layout import in_days, write_by_month

    rows = [("a", "2020-01-31"), ("b", "2/1/2020"), ("c", "2020-02-29"), ("d", None), ("e", "NULL"), ("f", "2021-02-10"), ("g", "13/1/2020")]
    df = spark.createDataFrame(rows, "k string, date_of_service string")
    write_by_month(df, f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    assert sorted(p.name for p in (tmp_path / "m/service_year=2020").iterdir()) == ["service_month=1", "service_month=2"]
    for start, end, want in (("2020-01-31", "2020-02-01", "ab"), (None, "1/31/2020", "a"), ("2020-02-29", None, "cf"), (None, None, "abcdefg")):
        for frame in (df, stored):
            assert "".join(sorted(r.k for r in frame.filter(in_days(frame, start, end)).collect())) == want
    assert stored.select(*df.columns).exceptAll(df).count() == 0 == df.exceptAll(stored.select(*df.columns)).count()
