"""The claims table function, checked writes and the partial top n."""

import pytest
from pyspark.sql import functions as F

from caremart.operators import pharmacy, quality
from caremart.operators.checked_write import write_checked
from caremart.plans.registry import wh
from caremart.sources.layout import in_days
from caremart.sources.table_function import register_claims_function
from tests.conftest import SF_SMALL, rows


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_two_parameter_sets_in_one_query(spark):
    claims = wh(spark, SF_SMALL).claims_by_month
    before = {t.name for t in spark.catalog.listTables()}
    fn = register_claims_function(spark, claims, "claims_of")
    both = spark.sql(f"SELECT 1 AS part, claim_id FROM {fn}(DATE '1996-02-10', DATE '1996-03-05', NULL, NULL) "
                     f"UNION ALL SELECT 2, claim_id FROM {fn}(DATE '1999-01-01', NULL, array('NATION_1', 'NATION_2'), 2000.0D)")
    one = claims.filter(in_days(claims, "1996-02-10", "1996-03-05")).select(F.lit(1), "claim_id")
    two = claims.filter(in_days(claims, "1999-01-01") & F.col("State").isin("NATION_1", "NATION_2") & (F.col("billed_amount") >= 2000))
    assert rows(both) == rows(one.union(two.select(F.lit(2), "claim_id"))) and both.count() > 0
    logical, physical = _plan(both)
    assert "SQLTableFunction" not in logical and logical.count("service_year") >= 2  # inlined, twice
    assert physical.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in physical
    new = {t.name for t in spark.catalog.listTables()} - before
    assert len(new) == 1 and new.pop().startswith("claims_of_")


def test_no_argument_no_limit_and_any_claims(spark):
    claims = wh(spark, SF_SMALL).claims.limit(50)
    fn = register_claims_function(spark, claims, "any_claims")
    assert spark.sql(f"SELECT * FROM {fn}(NULL, NULL, NULL, NULL)").count() == 50
    assert spark.sql(f"SELECT * FROM {fn}(NULL, NULL, array(), NULL)").count() == 0


def test_checked_write_reads_once_and_loses_nothing(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    raw = spark.createDataFrame([(i, None if i % 5 == 0 else f"n{i}", None if i % 7 == 0 else i) for i in range(100)],
                                "id int, name string, tax int").repartition(4)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = raw.mapInArrow(count, raw.schema)
    done = write_checked(df, f"{tmp_path}/t", ["name", "id"], ["tax", "name"])
    assert seen.value == 100
    assert done.metrics == {"rows": 100, "rejected": 20, "missing_name": 20, "missing_id": 0, "present_tax": 85, "present_name": 80}
    assert rows(done.rejected) == rows(quality.missing_required(raw, ["name", "id"]))
    assert rows(done.accepted.unionByName(done.rejected)) == rows(raw) and done.accepted.columns == raw.columns
    none = write_checked(raw.limit(0), f"{tmp_path}/empty", ["id"])
    assert none.accepted.count() == 0 and none.metrics["rows"] == 0
    with pytest.raises(ValueError):
        write_checked(raw, f"{tmp_path}/x", [])


def test_top_paid_joins_once_and_keeps_ties_whole(spark):
    claims = spark.createDataFrame([(f"c{i}", str(i % 3), "P", float(i // 4)) for i in range(40)] + [("c39", "0", "P", 9.0)] * 5,
                                   "claim_id string, member_id string, ProviderID string, paid_amount double")
    payor = spark.createDataFrame([("0", "A"), ("0", "A"), ("1", "B"), ("2", "A")], "member_id string, payor_type string")
    got = pharmacy.top_paid_by_payor(claims, payor, 6)
    full = pharmacy.claims_with_payor(claims.where("paid_amount > 0"), payor).select("claim_id", "ProviderID", "payor_type", "paid_amount")
    want = full.distinct().orderBy(F.desc("paid_amount"), "claim_id", "ProviderID", "payor_type").limit(6)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    logical, physical = _plan(got)
    assert logical.count("Join ") == 1 and "WindowGroupLimit" in physical
