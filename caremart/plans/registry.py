"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the whole fixture tables derived from the given parquet
folder; none runs on a subset or on made-up input.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart import sources
from caremart.functions import predicates
from caremart.operators import dimensions, enrich, params, pharmacy, quality, refresh, reports, scd, snapshots
from caremart.operators.checked_write import write_checked
from caremart.plans import oracles as O
from caremart.sources.layout import CODEC, open_folders
from caremart.sources.table_function import register_claims_function
from caremart.sources.tables import Warehouse, shared_path
from caremart.sources.versions import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = (fn, oracle)
        return fn
    return deco


_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}
_WH_LOCK = threading.Lock()


def wh(spark: SparkSession, sf_dir: str) -> Warehouse:
    """One warehouse per (application, folder): its frames are lazy plans, so
    queries share the resolved tables instead of re-reading catalog metadata."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - remote session without a SparkContext
        app = f"session-{id(spark)}"
    key = (app, sf_dir.rstrip("/"))
    with _WH_LOCK:
        if key not in _WAREHOUSES:
            _WAREHOUSES[key] = Warehouse(spark, sf_dir)
        return _WAREHOUSES[key]


def enriched(spark: SparkSession, sf_dir: str, profile: str = "lenient") -> DataFrame:
    return enrich.enhance_claims(wh(spark, sf_dir).claims, profile)


@register("enrich_claims_lenient", O.ENRICH["lenient"])
def _enrich_lenient(spark, sf):
    return enriched(spark, sf, "lenient")


@register("enrich_claims_strict", O.ENRICH["strict"])
def _enrich_strict(spark, sf):
    return enriched(spark, sf, "strict")


@register("provider_report", O.PROVIDER_REPORT)
def _provider_report(spark, sf):
    return reports.provider_report(enriched(spark, sf))


# -- reports over claims (A1-A22) -------------------------------------------

def _claims(spark, sf):
    return wh(spark, sf).claims


_ENRICHED_REPORTS = {
    "member_utilization": (reports.member_utilization, O.MEMBER_UTILIZATION),
    "service_trends": (reports.service_trends, O.SERVICE_TRENDS),
    "age_report": (reports.age_report, O.AGE_REPORT),
    "facility_report": (reports.facility_report, O.FACILITY_REPORT),
    "network_report": (reports.network_report, O.NETWORK_REPORT),
    "gender_report": (reports.gender_report, O.GENDER_REPORT),
    "race_report": (reports.race_report, O.RACE_REPORT),
    "state_report": (reports.state_report, O.STATE_REPORT),
    "readmission_report": (reports.readmission_report, O.READMISSION_REPORT),
    "denial_report": (reports.denial_report, O.DENIAL_REPORT),
    "variance_report": (reports.variance_report, O.VARIANCE_REPORT),
    "cpt_report": (reports.cpt_report, O.CPT_REPORT),
    "record_count": (reports.record_count, O.RECORD_COUNT),
    "completeness_report": (reports.completeness_report, O.COMPLETENESS_REPORT),
}


def _over_enriched(fn):
    return lambda spark, sf: fn(enriched(spark, sf))


for _name, (_fn, _sql) in _ENRICHED_REPORTS.items():
    register(_name, _sql)(_over_enriched(_fn))

_RAW_REPORTS = {
    "type_state_summary": (reports.type_state_summary, O.TYPE_STATE_SUMMARY),
    "age_band_report": (reports.age_band_report, O.AGE_BAND_REPORT),
    "age_sex_report": (reports.age_sex_report, O.AGE_SEX_REPORT),
    "state_billed_report": (reports.state_billed_report, O.STATE_BILLED_REPORT),
}


def _over_claims(fn):
    return lambda spark, sf: fn(_claims(spark, sf))


for _name, (_fn, _sql) in _RAW_REPORTS.items():
    register(_name, _sql)(_over_claims(_fn))


@register("age_group_sql_function", O.AGE_GROUP_SQL_FUNCTION)
def _age_group_sql(spark, sf):
    from caremart.functions.bands import register_functions
    fn = register_functions(spark)
    _claims(spark, sf).createOrReplaceTempView("claims")
    return spark.sql(f"SELECT {fn}(AGE) AS age_group, COUNT(*) AS count FROM claims GROUP BY {fn}(AGE)")


@register("status_distribution", O.STATUS_DISTRIBUTION)
def _status_distribution(spark, sf):
    return reports.status_distribution(wh(spark, sf).eligibility)


@register("location_report", O.LOCATION_REPORT)
def _location_report(spark, sf):
    return reports.location_report(wh(spark, sf).providers)


@register("specialty_report", O.SPECIALTY_REPORT)
def _specialty_report(spark, sf):
    return reports.specialty_report(wh(spark, sf).providers)


# -- pharmacy and payor (J1-J4, A23-A27, W1, T3) ----------------------------

@register("member_drug_counts", O.MEMBER_DRUG_COUNTS)
def _member_drug_counts(spark, sf):
    w = wh(spark, sf)
    return pharmacy.member_drug_counts(w.claims, w.pharmacy_claims)


@register("pharmacy_provider_counts", O.PHARMACY_PROVIDER_COUNTS)
def _pharmacy_provider_counts(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_provider_counts(w.claims, w.pharmacy_claims, w.providers)


@register("pharmacy_provider_payor_totals", O.PHARMACY_PROVIDER_PAYOR_TOTALS)
def _pharmacy_provider_payor_totals(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_provider_payor_totals(w.claims, w.pharmacy_claims, w.providers, w.payor)


@register("pharmacy_provider_counts_preview", O.PHARMACY_PROVIDER_COUNTS_PREVIEW)
def _pharmacy_provider_counts_preview(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_provider_counts(w.claims, w.pharmacy_claims, w.providers, n=5)


@register("pharmacy_provider_payor_totals_preview", O.PHARMACY_PROVIDER_PAYOR_TOTALS_PREVIEW)
def _pharmacy_provider_payor_totals_preview(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_provider_payor_totals(w.claims, w.pharmacy_claims, w.providers, w.payor, n=20)


@register("pharmacy_claim_detail", O.PHARMACY_CLAIM_DETAIL)
def _pharmacy_claim_detail(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_claim_detail(w.claims, w.fact_pharm)


@register("pharmacy_claim_detail_preview", O.PHARMACY_CLAIM_DETAIL_PREVIEW)
def _pharmacy_claim_detail_preview(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_claim_detail(w.claims, w.fact_pharm, n=5)


@register("pharmacy_monthly_totals", O.PHARMACY_MONTHLY_TOTALS)
def _pharmacy_monthly_totals(spark, sf):
    w = wh(spark, sf)
    return pharmacy.pharmacy_monthly_totals(w.claims, w.fact_pharm)


@register("top_drug_claim", O.TOP_DRUG_CLAIM)
def _top_drug_claim(spark, sf):
    w = wh(spark, sf)
    return pharmacy.top_drug_claim(w.claims, w.fact_pharm)


@register("top_paid_by_payor", O.TOP_PAID_BY_PAYOR)
def _top_paid_by_payor(spark, sf):
    w = wh(spark, sf)
    return pharmacy.top_paid_by_payor(w.claims, w.payor)


# -- dimensions (J5, J6, A28, A29, A32) --------------------------------------

def _cwd(spark, sf):
    w = wh(spark, sf)
    return dimensions.claims_with_dimensions(w.claims_by_month, w.eligibility, w.providers, since=O.SINCE)


@register("claims_with_dimensions", O.CLAIMS_WITH_DIMENSIONS)
def _claims_with_dimensions(spark, sf):
    return _cwd(spark, sf)


@register("eligibility_impact", O.ELIGIBILITY_IMPACT)
def _eligibility_impact(spark, sf):
    return dimensions.eligibility_impact(_cwd(spark, sf))


@register("location_impact", O.LOCATION_IMPACT)
def _location_impact(spark, sf):
    return dimensions.location_impact(_cwd(spark, sf))


# -- parameterised summaries (Q1-Q10, S6) -----------------------------------

def _monthly(spark, sf):
    """Claims as stored by service month, for date ranges."""
    return wh(spark, sf).claims_by_month


_P = O.P


@register("claims_by_date_range", O.q1_sql(_P["start"], _P["end"]))
def _q1(spark, sf):
    return params.claims_by_date_range(_monthly(spark, sf), _P["start"], _P["end"])


@register("claims_by_date_range_filtered", O.q1_sql(_P["start"], _P["end"], "Inpatient", 10000))
def _q1_filtered(spark, sf):
    return params.claims_by_date_range(_monthly(spark, sf), _P["start"], _P["end"],
                                       service_type="Inpatient", min_amount=10000)


_Q2_CONFIG = {
    "date_range": {"start_date": _P["start"], "end_date": _P["end"]},
    "filters": {"states": _P["states"], "age_min": 18, "age_max": 65,
                "service_types": ["Inpatient", "Outpatient"], "network_status": ["In Network"]},
    "aggregation": {"group_by": ["State", "Type_of_Service"], "metrics": ["count", "sum", "avg"]},
}


@register("dynamic_analysis", O.q2_sql(_P["start"], _P["end"], _P["states"], 18, 65,
                                       ["Inpatient", "Outpatient"], ["In Network"]))
def _q2(spark, sf):
    return params.dynamic_analysis(_monthly(spark, sf), _Q2_CONFIG)


@register("state_service_summary", O.q3_sql(_P["start"], _P["end"], _P["states"], _P["min_amount"]))
def _q3(spark, sf):
    return params.state_service_summary(_monthly(spark, sf), _P["start"], _P["end"],
                                        states=_P["states"], min_amount=_P["min_amount"])


@register("claims_summary_all_services", O.q4_sql(_P["start"], _P["end"], "All", _P["states"], 0))
def _q4(spark, sf):
    return params.claims_summary(_monthly(spark, sf), _P["start"], _P["end"], service_type="All",
                                 states=_P["states"], min_amount=0)


@register("claims_summary_one_service", O.q4_sql(_P["start"], _P["end"], "Emergency", None, 0))
def _q4_one(spark, sf):
    return params.claims_summary(_monthly(spark, sf), _P["start"], _P["end"],
                                 service_type="Emergency", min_amount=0)


@register("service_provider_summary", O.q5_sql(_P["start"], _P["end"], 5000))
def _q5(spark, sf):
    return params.service_provider_summary(_monthly(spark, sf), _P["start"], _P["end"], 5000)


@register("view_state_totals", O.q6_sql(_P["start"], _P["end"], _P["states"][:2], _P["min_amount"]))
def _q6(spark, sf):
    params.filtered_view(_monthly(spark, sf), "filtered_claims", _P["start"], _P["end"],
                         states=_P["states"][:2], min_amount=_P["min_amount"])
    return params.view_state_totals(spark, "filtered_claims")


@register("claims_function_totals", O.CLAIMS_FUNCTION_TOTALS)
def _claims_function_totals(spark, sf):
    fn = register_claims_function(spark, _monthly(spark, sf))
    return spark.sql(f"""
        SELECT 'states' AS part, State, COUNT(*) AS claim_count, CAST(SUM(CAST(billed_amount AS DECIMAL(28, 8))) AS DOUBLE) AS total_billed
        FROM {fn}(DATE '{_P["start"]}', DATE '1996-06-15', array('{_P["states"][0]}', '{_P["states"][2]}'), {_P["min_amount"]}D) GROUP BY State
        UNION ALL
        SELECT 'late', State, COUNT(*), CAST(SUM(CAST(billed_amount AS DECIMAL(28, 8))) AS DOUBLE)
        FROM {fn}(DATE '1998-02-10', NULL, NULL, NULL) GROUP BY State""")


_Q7_FILTERS = {"State": _P["states"], "billed_amount": {"min": 1000}, "payment_status": "Paid"}


@register("grouped_summary", O.q7_sql(["State", "Type_of_Service"], [
    f"State IN ({O._sq(_P['states'])})", "billed_amount >= 1000", "payment_status = 'Paid'"]))
def _q7(spark, sf):
    return params.grouped_summary(_monthly(spark, sf), ["State", "Type_of_Service"], _Q7_FILTERS)


@register("grouped_summary_range", O.q7_sql(["Provider_Type"], [
    "billed_amount >= 1000", "billed_amount <= 50000", "AGE >= 30", "AGE <= 60"]))
def _q7_range(spark, sf):
    return params.grouped_summary(
        _monthly(spark, sf), ["Provider_Type"],
        {"billed_amount": {"min": 1000, "max": 50000}, "AGE": {"min": 30, "max": 60}},
        order_by="claim_count DESC")


def _q8(name):
    def run(spark, sf):
        w = wh(spark, sf)
        return params.run_named_query({"claims": w.claims_by_month, "providerlist": w.providerlist},
                                      O.Q8_CONFIG, name)
    return run


register("named_query_network_quarters", O.Q8_QUARTERS)(_q8("network_quarters"))
register("named_query_site_workload", O.Q8_SITES)(_q8("site_workload"))

_Q9 = {"states": _P["states"], "min_amount": _P["min_amount"],
       "service_types": ["Inpatient", "Outpatient"], "payment_statuses": ["Paid", "Denied"]}


@register("claims_summary_lists", O.q4_sql(_P["start"], _P["end"], "All", _P["states"], _P["min_amount"],
                                           _Q9["service_types"], _Q9["payment_statuses"]))
def _q9(spark, sf):
    return params.claims_summary(_monthly(spark, sf), _P["start"], _P["end"], **_Q9)


# The validator's state list is the fixture's own: nation names by rule.
FIXTURE_STATES = frozenset(f"NATION_{i}" for i in range(25))


@register("validated_claims_summary", O.q4_sql(_P["start"], _P["end"], "All", _P["states"],
                                               _P["min_amount"], _Q9["service_types"],
                                               _Q9["payment_statuses"]))
def _q10(spark, sf):
    args = dict(_Q9, states=[s.lower() for s in _P["states"]])
    return params.validated_claims_summary(_monthly(spark, sf), _P["start"], _P["end"],
                                           valid_states=FIXTURE_STATES, **args)


# -- slowly-changing dimensions (M1-M9, A30) ----------------------------------
# Registered runs use a fixed as-of date; created_timestamp (wall clock) is
# left out of the compared output.

def _no_ts(df):
    return df.drop("created_timestamp")


def _scd2_init(spark, sf):
    return scd.scd2_init(wh(spark, sf).eligibility)


def _scd2(spark, sf):
    w = wh(spark, sf)
    return scd.scd2_apply(scd.scd2_init(w.eligibility), w.eligibility_updates, as_of=O.AS_OF)


register("scd2_init", O.SCD2_INIT)(lambda spark, sf: _no_ts(_scd2_init(spark, sf)))
@register("scd2_changes", O.SCD2_CHANGES)
def _scd2_changes(spark, sf):
    from caremart.functions.cleaning import parse_date
    latest = scd.latest_per_key(wh(spark, sf).eligibility_updates, "member_id",
                                [parse_date("eligibility_start_date"), F.col("eligibility_id")])
    return scd.scd2_changes(_scd2_init(spark, sf), latest)
def _scd2_stored(spark, sf):
    """The applied SCD2 table as written and read back (downstream queries
    read the stored table, as the eligibility notebook does)."""
    return wh(spark, sf).stored(f"eligibility_scd2_{O.AS_OF}", lambda: _scd2(spark, sf))


register("scd2_apply", O.SCD2_APPLY)(lambda spark, sf: _no_ts(_scd2(spark, sf)))
register("scd2_second_run", O.SCD2_SECOND_RUN)(
    lambda spark, sf: _no_ts(scd.scd2_apply(_scd2_stored(spark, sf), wh(spark, sf).eligibility_later_updates,
                                            as_of=O.AS_OF_LATER)))


@register("scd2_late_changes", O.SCD2_LATE_CHANGES)
def _scd2_late_changes(spark, sf):
    w = wh(spark, sf)
    table = _scd2_init(spark, sf)
    for batch in (w.eligibility_later_updates, w.eligibility_late_updates):
        table = scd.scd2_apply(table, batch, start_policy="timeline")
    return _no_ts(table)


register("change_summary", O.CHANGE_SUMMARY)(
    lambda spark, sf: scd.change_summary(_scd2_stored(spark, sf)))


def _providers_after(spark, sf):
    w = wh(spark, sf)
    return scd.scd1_upsert(w.providers, w.provider_updates, "provider_id")


register("scd1_upsert", O.SCD1_UPSERT)(_providers_after)
register("scd1_upsert_columns", O.SCD1_UPSERT_COLUMNS)(
    lambda spark, sf: scd.scd1_upsert(wh(spark, sf).providers, wh(spark, sf).provider_updates,
                                      "provider_id", ["practice_location", "name"]))
register("scd1_before_image", O.AFFECTED_BEFORE)(
    lambda spark, sf: scd.affected_rows(wh(spark, sf).providers, wh(spark, sf).provider_updates))
register("scd1_after_image", O.AFFECTED_AFTER)(
    lambda spark, sf: scd.affected_rows(_providers_after(spark, sf), wh(spark, sf).provider_updates))
register("upsert_summary", O.UPSERT_SUMMARY)(
    lambda spark, sf: scd.upsert_summary(wh(spark, sf).providers, _providers_after(spark, sf),
                                         wh(spark, sf).provider_updates))


# -- whole runs on stored tables (S7, S8) ------------------------------------------

def _run_table(spark, name):
    """A table of its own for one run, removed when the application ends."""
    table = VersionedTable(spark, shared_path(spark, "caremart-runs", f"{name}-{uuid.uuid4().hex}"))
    table.delete_on_exit()
    return table


def _provider_run(spark, sf):
    w, table = wh(spark, sf), _run_table(spark, "providers")
    table.write(w.providers, None)
    scd.run_scd1_versions(table, w.provider_updates)
    return table


register("scd1_run", O.SCD1_UPSERT)(lambda spark, sf: _provider_run(spark, sf).read())


@register("scd1_run_log", O.SCD1_RUN_LOG)
def _scd1_run_log(spark, sf):
    table = _provider_run(spark, sf)
    rows = [table.read(v).agg(F.count(F.lit(1)).alias("total_after")).select(
        F.lit(v.number).alias("version"), "total_after",
        *[F.lit(v.notes.get(n, 0)).cast("long").alias(n) for n in ("records_processed", "new_records", "updated_records")])
        for v in table.history()]
    return reduce(DataFrame.unionByName, rows)


@register("table_init_run", O.SCD2_APPLY)
def _table_init_run(spark, sf):
    w, table = wh(spark, sf), _run_table(spark, "eligibility")
    scd.run_scd2_versions(table, w.eligibility, w.eligibility_updates, as_of=O.AS_OF)
    return _no_ts(table.read())


def _refreshed(spark, sf):
    """States of claims that came in two steps: first without the claims from 1998 on and with wrong amounts in
    one month, then those claims and the right amounts."""
    claims, table = wh(spark, sf).claims_by_month, _run_table(spark, "report-refresh")
    late, wrong = F.coalesce(F.col("service_year") >= 1998, F.lit(False)), F.expr("service_year <=> 1996 AND service_month <=> 3")
    months = f"{table.path}/claims"

    def write(rows, mode):  # stored rows lie together by month, so nothing is dealt out or sorted again
        with open_folders(spark):
            (rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
             .partitionBy("service_year", "service_month").parquet(months))

    write(claims.where(~late).withColumn("billed_amount", F.when(wrong, F.col("billed_amount") * 2).otherwise(F.col("billed_amount"))), "append")
    states = refresh.ReportStates(spark, months, table.path)
    states.refresh()
    write(claims.where(late), "append")
    write(claims.where(wrong), "overwrite")
    states.refresh()
    return states


_STATES: dict[Warehouse, refresh.ReportStates] = {}


def _states(spark, sf):
    """The refreshed states, made once per warehouse: three reports read them."""
    w = wh(spark, sf)
    if w not in _STATES:
        _STATES[w] = _refreshed(spark, sf)
    return _STATES[w]


register("report_refresh_states", O.STATE_REPORT)(lambda spark, sf: _states(spark, sf).state_report())
register("report_refresh_genders", O.GENDER_REPORT)(lambda spark, sf: _states(spark, sf).gender_report())
register("report_refresh_races", O.RACE_REPORT)(lambda spark, sf: _states(spark, sf).race_report())


def _dim2(spark, sf):
    w = wh(spark, sf)
    return scd.scd2_apply_dim(w.dim_provider, w.dim_provider_updates)


register("scd2_apply_dim", O.SCD2_APPLY_DIM)(_dim2)
register("scd2_dim_late_updates", O.SCD2_DIM_LATE)(
    lambda spark, sf: scd.scd2_apply_dim(_dim2(spark, sf), wh(spark, sf).dim_provider_late_updates))


@register("assign_dim_key", O.ASSIGN_DIM_KEY)
def _assign_dim_key(spark, sf):
    facts = wh(spark, sf).claims_by_month.select(
        "claim_id", "member_id", F.col("service_day").alias("claim_date"),
        F.col("billed_amount").alias("claim_amount"), F.col("ProviderID").alias("provider_id"))
    return scd.assign_dim_key(facts, _dim2(spark, sf)).drop("provider_id")


# -- data quality (K1-K5) -------------------------------------------------------

register("duplicate_provider_ids", O.DUPLICATE_PROVIDER_IDS)(
    lambda spark, sf: quality.duplicate_keys(wh(spark, sf).providers, "provider_id"))
register("duplicate_member_versions", O.DUPLICATE_MEMBER_VERSIONS)(
    lambda spark, sf: quality.duplicate_keys(_scd2_stored(spark, sf), "member_id"))
register("missing_required", O.MISSING_REQUIRED)(
    lambda spark, sf: quality.missing_required(
        wh(spark, sf).providers, ["name", "specialty", "practice_location", "provider_id"]))
_CHECKED = {}


def _checked(spark, sf):
    """The providers as stored by a checked write, once per warehouse."""
    w = wh(spark, sf)
    if w not in _CHECKED:
        place = _run_table(spark, "checked-providers").path
        _CHECKED[w] = write_checked(w.providers, f"{place}/rows", ["name", "specialty", "practice_location", "provider_id"], ["name", "TaxID"])
    return _CHECKED[w]


register("checked_write_rejects", O.MISSING_REQUIRED)(lambda spark, sf: _checked(spark, sf).rejected)


@register("checked_write_metrics", O.CHECKED_WRITE_METRICS)
def _checked_write_metrics(spark, sf):
    done = _checked(spark, sf)
    return done.accepted.agg(F.count(F.lit(1)).alias("accepted")).select(
        "accepted", *[F.lit(done.metrics[m]).cast("long").alias(m) for m in sorted(done.metrics)])


register("pcp_distribution", O.PCP_DISTRIBUTION)(
    lambda spark, sf: quality.value_distribution(wh(spark, sf).providers, "is_pcp"))
register("period_overlaps", O.PERIOD_OVERLAPS)(
    lambda spark, sf: _no_ts(quality.period_overlaps(
        _scd2_stored(spark, sf), "member_id", "record_start_date", "record_end_date", "eligibility_id",
        half_open=True)))


# -- previews, snapshots, bands and row rewrites (S2, P1, P9, P12-P14) ------

register("claims_preview", O.CLAIMS_PREVIEW)(
    lambda spark, sf: sources.preview(_claims(spark, sf), 10, ["claim_id"]))
register("paid_claims_snapshot", O.PAID_CLAIMS_SNAPSHOT)(
    lambda spark, sf: snapshots.paid_claims_snapshot(_claims(spark, sf)))
register("age_bands", O.AGE_BANDS)(lambda spark, sf: snapshots.age_bands(_claims(spark, sf)))
register("rewrite_by_key", O.REWRITE_BY_KEY)(
    lambda spark, sf: predicates.rewrite_by_key(wh(spark, sf).providers, "provider_id", "specialty",
                                                {"PR6": "Cardiology", "PR7": "Radiology"}))
register("rewrite_by_frame", O.REWRITE_BY_FRAME)(
    lambda spark, sf: predicates.rewrite_by_key(wh(spark, sf).providers, "provider_id",
                                                "practice_location", wh(spark, sf).provider_updates))
register("update_where", O.UPDATE_WHERE)(
    lambda spark, sf: predicates.update_where(
        predicates.update_where(wh(spark, sf).providers, "provider_id = 'PR4'",
                                {"specialty": "Internal Medicine"}),
        "provider_id = 'PR1'", {"specialty": "Dermatology", "practice_location": "Skin Care Center"}))
register("filter_keys_list", O.FILTER_KEYS_LIST)(
    lambda spark, sf: predicates.filter_keys(wh(spark, sf).providers, "provider_id", ["PR6", "PR7"]))
register("filter_keys_frame", O.FILTER_KEYS_FRAME)(
    lambda spark, sf: predicates.filter_keys(wh(spark, sf).providers, "provider_id",
                                             wh(spark, sf).provider_updates))
register("filter_keys_anti", O.FILTER_KEYS_ANTI)(
    lambda spark, sf: predicates.filter_keys(wh(spark, sf).providers, "provider_id",
                                             wh(spark, sf).provider_updates, keep=False))


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _REGISTRY.items() if v[1] is not None}
