"""The stored claims are the rows of CLAIMS_SQL, and their exchanges carry source columns only."""

import datetime as dt
from urllib.parse import unquote

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caremart.operators import refresh
from caremart.operators.refresh import ReportStates
from caremart.operators.reports import member_utilization
from caremart.session import set_conf
from caremart.sources import tables
from caremart.sources.fixtures import DOMAIN_SQL
from caremart.sources.layout import LAYOUT_COLUMNS, with_month
from caremart.sources.versions import VersionedTable
from tests.conftest import rows


@pytest.fixture
def folder(spark, tmp_path):
    """Small source tables with missing and repeated keys."""
    day = [dt.datetime(1996, 1 + i % 3, 1 + i % 28) if i % 7 else None for i in range(40)]
    made = {
        "nation": ([(i, f"NATION_{i}", 0) for i in range(3)] + [(1, "NATION_1b", 0), (None, "none", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i if i else None, f"c{i}", i % 4, 1.0, "AUTO" if i % 2 else None) for i in range(12)] + [(5, "again", 1, 2.0, "HOME")],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "s", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(i if i else None, "p", "b", ["PROMO", "SMALL", "LARGE", None][i % 4], i, 1.0) for i in range(9)] + [(3, "p", "b", "MEDIUM", 50, 1.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i if i else None, i % 13, "F" if i % 2 else "O", 9.5, day[i], "1") for i in range(40)] + [(6, 2, "O", 1.0, day[8], "1")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i % 41, i % 10, i % 9, i % 7, float(i % 5), 1.25 * i if i % 11 else None, 0.1, 0.04 * (i % 2), "RAN"[i % 3], "FO"[i % 2], day[i % 40])
                      for i in range(300)] * 2,
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")}
    for name, (content, schema) in made.items():
        spark.createDataFrame(content, schema).coalesce(1).write.parquet(f"{tmp_path}/src/{name}.parquet")
    return f"{tmp_path}/src"


def _exchanges(plan):
    return [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_stored_claims_are_the_sql_rows(spark, folder, threshold):
    with set_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": threshold}):
        stored = tables.Warehouse(spark, folder).claims_by_month
        whole = with_month(spark.sql(DOMAIN_SQL["claims"]))
    assert stored.columns == whole.columns and whole.count() > 500
    assert stored.exceptAll(whole).count() == 0 == whole.exceptAll(stored).count()
    assert stored.where("service_year IS NULL").count() > 0


def test_claims_are_dealt_out_by_source_columns(spark, folder, monkeypatch):
    """The month's exchange lies below the claims' columns, and the rows aren't sorted again by folder."""
    seen, settings = [], []

    real = tables.write_gathered

    def write(df, path):
        seen.append(with_month(df)._jdf.queryExecution().optimizedPlan().toString())
        settings.append(int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "0")))
        real(df, path)

    monkeypatch.setattr(tables, "write_gathered", write)
    monkeypatch.setattr("caremart.sources.tables._bytes", lambda *a: 100 << 20, raising=False)
    _ = tables.Warehouse(spark, folder).claims_by_month
    (plan,) = seen
    below = plan[plan.index("RebalancePartitions"):] if "RebalancePartitions" in plan else ""
    assert below and "claim_id" not in below and "claim_id" in plan
    assert settings == [25]  # 100 MB in parts of 4
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_member_utilization_deals_claims_out_once(spark):
    e = spark.createDataFrame(
        [("a", "P1", "f", 1.0, 1.0, 1, 0, 3), ("a", "P1", None, 2.5, None, 0, 1, None), ("a", None, "f", None, 2.0, 0, 0, 4),
         ("b", None, None, 1.0, 1.0, 0, 0, None), (None, "P2", "f", 1.0, 1.0, 1, 0, 1), (None, "P3", "g", 1.0, 1.0, 1, 0, 1)],
        "member_id string, ProviderID string, facility_name string, billed_amount double, paid_amount double, is_inpatient int, "
        "is_readmission int, Length_of_Stay int")
    out = member_utilization(e)
    assert len(_exchanges(_plan(out))) == 1 and "Expand" not in _plan(out)
    assert rows(out.select("member_id", "total_claims", "unique_providers", "unique_facilities", "total_cost", "total_paid", "inpatient_claims",
                           "readmissions", "avg_los")) == [("a", 3, 1, 1, 3.5, 3.0, 1, 1, 3.5), ("b", 1, 0, 0, 1.0, 1.0, 0, 0, None),
                                                           (None, 2, 2, 2, 2.0, 2.0, 2, 0, 1.0)]


def test_states_bitmaps_are_made_once(spark, folder, tmp_path):
    """Claims are combined before dimensions expand them; no bitmap goes through an exchange."""
    claims = tables.Warehouse(spark, folder).claims_by_month
    claims.write.partitionBy("service_year", "service_month").parquet(f"{tmp_path}/claims")
    states = ReportStates(spark, f"file://{tmp_path}/claims", f"file://{tmp_path}/state")
    plan = _plan(states._compute([0, 1996 * 12 + 1, 1996 * 12 + 2])).splitlines()
    at = [i for i, x in enumerate(plan) if "bitmap_construct_agg" in x]
    assert len(at) == 2 and not _exchanges("\n".join(plan[at[0]:at[1]]))
    expands = next(i for i, x in enumerate(plan) if "Generate" in x)
    assert any("Aggregate" in x and "billed_amount" in x for x in plan[expands:])
    assert claims.columns[-3:] == list(LAYOUT_COLUMNS) and claims.where(F.col("service_month").isNull()).count()


def test_stored_claims_are_compressed(spark, folder):
    """Every column of the stored claims is written with the layout's codec, whatever the session's is."""
    with set_conf(spark, {"spark.sql.parquet.compression.codec": "snappy"}):
        stored = tables.Warehouse(spark, folder).claims_by_month
    files = [f.removeprefix("file:") for f in stored.inputFiles()]
    codecs = {pq.ParquetFile(unquote(f.replace("//", "/"))).metadata.row_group(0).column(0).compression for f in files}
    assert files and codecs == {"ZSTD"}


def test_refresh_bounds_its_tasks(spark, folder, tmp_path, monkeypatch):
    """What a task of a refresh reads and sorts doesn't grow with the claims; the settings end with it."""
    monkeypatch.setattr(refresh, "READ_BYTES", 1 << 10)
    monkeypatch.setattr(refresh, "JOINED_BYTES", 1 << 9)
    tables.Warehouse(spark, folder).claims_by_month.coalesce(1).write.partitionBy("service_year", "service_month").parquet(f"{tmp_path}/claims")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, seen, real = [spark.conf.get(n, None) for n in names], [], VersionedTable.write

    def write(self, df, *rest):
        splits = spark.read.parquet(f"{tmp_path}/claims").rdd.getNumPartitions()
        seen.append((self.path.rsplit("/", 1)[1], [spark.conf.get(n) for n in names], splits))
        return real(self, df, *rest)

    monkeypatch.setattr(VersionedTable, "write", write)
    states = ReportStates(spark, f"file://{tmp_path}/claims", f"file://{tmp_path}/state")
    states.refresh()
    size = sum(f.stat().st_size for f in (tmp_path / "claims").rglob("*.parquet"))
    assert [(name, conf) for name, conf, _ in seen] == [("members", ["1024", "512"]), ("states", ["1024", "512"])]
    assert all(splits >= size // 1024 for *_, splits in seen)
    assert [spark.conf.get(n, None) for n in names] == before and states.gender_report().count() > 0
