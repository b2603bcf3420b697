"""Plan-shape checks: the properties the scale design relies on."""

import re

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_nested_loops(spark):
    from caremart.plans.registry import queries
    for name, fn in queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_top_k_is_take_ordered(spark):
    from caremart.plans.registry import queries
    for name in ("facility_report", "cpt_report", "top_drug_claim", "top_paid_by_payor",
                 "paid_claims_snapshot", "claims_preview"):
        assert "TakeOrderedAndProject" in _plan(queries()[name](spark, SF_SMALL)), name


def test_scd_runs_do_not_shuffle_the_dimension(spark):
    from caremart.plans.registry import queries
    for name in ("scd2_apply", "scd1_upsert", "scd1_upsert_columns", "scd2_apply_dim", "scd2_second_run",
                 "assign_dim_key"):
        plan = _plan(queries()[name](spark, SF_SMALL))
        assert "SortMergeJoin" not in plan, name


def test_pushdown_and_pruning(spark):
    from caremart.operators import snapshots
    from caremart.plans.registry import wh
    plan = _plan(snapshots.paid_claims_snapshot(wh(spark, SF_SMALL).claims))
    assert "PushedFilters: [IsNotNull(paid_amount), GreaterThan(paid_amount,0.0)]" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert len(schema.split(",")) == 4


def test_date_ranges_read_only_their_months(spark):
    from caremart.plans.registry import queries
    for name in ("claims_by_date_range", "claims_by_date_range_filtered", "dynamic_analysis", "state_service_summary",
                 "claims_summary_all_services", "claims_summary_one_service", "service_provider_summary", "view_state_totals",
                 "claims_summary_lists", "validated_claims_summary", "named_query_network_quarters",
                 "claims_with_dimensions", "eligibility_impact", "location_impact"):
        plan = _plan(queries()[name](spark, SF_SMALL))
        # the plan's text is cut, the folder columns come first in it
        assert re.search(r"PartitionFilters: \[[^:]*service_year[^:]*service_month", plan), name
        assert "try_to_date(date_of_service" not in plan.lower(), name


def test_a_date_range_opens_only_its_files(spark):
    from caremart.plans.registry import wh
    from caremart.sources.layout import in_days
    claims = wh(spark, SF_SMALL).claims_by_month
    few = claims.filter(in_days(claims, "1997-03-15", "1997-04-02"))
    few.collect()
    read = {f.rsplit("service_year=", 1)[1].rsplit("/", 1)[0] for f in few.select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert read == {"1997/service_month=3", "1997/service_month=4"}
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numPartitions").value() == 2
