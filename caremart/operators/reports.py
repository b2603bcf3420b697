"""Aggregate reports.

Every report is one ``groupBy().agg()``: Spark runs a partial aggregate in
each task before the shuffle, so a hot key (one state, one provider type)
costs one combined row per task, not its raw rows.  Ratios are ``try_divide``
(x/0 -> null).  Sorted reports break ties on their group keys so limits are
deterministic.  Money totals are exact decimal sums (see ``money_sum``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caremart.functions.bands import age_band
from caremart.functions.cleaning import MONEY, fixed_avg, money_avg, money_round_sum, money_sum, ratio
from caremart.operators.joins import by_key


def _desc_then(keys: Sequence[str], *first: str) -> list[Column]:
    return [F.col(c).desc() for c in first] + [F.col(k).asc() for k in keys]


def _top(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    out = df.orderBy(*order)
    return out.limit(n) if n is not None else out


def type_state_summary(claims: DataFrame) -> DataFrame:
    """A1: Provider_Type, State -> count, rounded total and average paid."""
    return (claims.groupBy("Provider_Type", "State")
            .agg(F.count(F.lit(1)).alias("Total_Claims"),
                 money_round_sum("paid_amount", 2).alias("Total_Paid_Amount"),
                 F.round(money_avg("paid_amount"), 2).alias("Average_Paid_Amount"))
            .orderBy("Provider_Type", "State"))


def provider_report(enriched: DataFrame) -> DataFrame:
    """A2: per provider: volume, patients, money, processing time, denial and
    readmission counts and rates; busiest first."""
    keys = ["ProviderID", "Provider_Type"]
    return (enriched.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 F.countDistinct("member_id").alias("unique_patients"),
                 money_sum("billed_amount").alias("total_billed"),
                 money_sum("paid_amount").alias("total_paid"),
                 money_avg("billed_amount").alias("avg_claim_cost"),
                 F.avg("processing_days").alias("avg_processing_days"),
                 F.sum("has_denial").alias("denied_claims"),
                 F.sum("is_readmission").alias("readmissions"))
            .withColumns({"denial_rate": ratio("denied_claims", "total_claims"),
                          "readmission_rate": ratio("readmissions", "total_claims"),
                          "payment_rate": ratio("total_paid", "total_billed")})
            .orderBy(*_desc_then(keys, "total_claims")))


def member_utilization(enriched: DataFrame) -> DataFrame:
    """A3: per member: claims, distinct providers and facilities, cost, stays."""
    # dealt out once, by member: the distinct counts need no second exchange and no copies of the rows
    rows = by_key(enriched.select("member_id", "ProviderID", "facility_name", "billed_amount", "paid_amount",
                                  "is_inpatient", "is_readmission", "Length_of_Stay"), "member_id")
    return (rows.groupBy("member_id")
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 F.size(F.collect_set("ProviderID")).cast("long").alias("unique_providers"),
                 F.size(F.collect_set("facility_name")).cast("long").alias("unique_facilities"),
                 F.sum(F.col("billed_amount").cast(MONEY)).cast("double").alias("total_cost"),
                 F.sum(F.col("paid_amount").cast(MONEY)).cast("double").alias("total_paid"),
                 F.sum("is_inpatient").alias("inpatient_claims"),
                 F.sum("is_readmission").alias("readmissions"),
                 ratio(F.sum("Length_of_Stay"), F.count("Length_of_Stay")).alias("avg_los"))
            .withColumns({"avg_cost_per_claim": ratio("total_cost", "total_claims"),
                          "inpatient_rate": ratio("inpatient_claims", "total_claims")}))


def service_trends(enriched: DataFrame, n: int | None = None) -> DataFrame:
    """A4: quarter x service: claims, billed, distinct members; by keys."""
    keys = ["service_quarter", "Type_of_Service"]
    out = (enriched.groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("claim_count"),
                money_sum("billed_amount").alias("total_billed"),
                F.countDistinct("member_id").alias("unique_members")))
    return _top(out, [F.col(k).asc() for k in keys], n)


def age_report(enriched: DataFrame) -> DataFrame:
    """A5: utilisation by the enrichment's age group."""
    return (enriched.groupBy("age_group")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 F.countDistinct("member_id").alias("unique_members"),
                 money_sum("billed_amount").alias("total_cost"),
                 money_avg("billed_amount").alias("avg_cost_per_claim"),
                 F.sum("is_inpatient").alias("inpatient_claims"),
                 F.sum("is_readmission").alias("readmissions"))
            .withColumns({"claims_per_member": ratio("claim_count", "unique_members"),
                          "cost_per_member": ratio("total_cost", "unique_members"),
                          "inpatient_rate": ratio("inpatient_claims", "claim_count")}))


def facility_report(enriched: DataFrame, n: int | None = 10) -> DataFrame:
    """Top facilities by revenue (missing facility names excluded)."""
    keys = ["facility_name", "State"]
    fac = F.col("facility_name")
    out = (enriched.filter(fac.isNotNull() & (fac != "NULL"))
           .groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("total_claims"),
                F.countDistinct("member_id").alias("unique_patients"),
                money_sum("billed_amount").alias("total_revenue"),
                F.avg("Length_of_Stay").alias("avg_los"),
                F.sum("is_readmission").alias("readmissions"),
                F.avg("processing_days").alias("avg_processing_time"))
           .withColumn("readmission_rate", ratio("readmissions", "total_claims")))
    return _top(out, _desc_then(keys, "total_revenue"), n)


def network_report(enriched: DataFrame) -> DataFrame:
    """In- vs out-of-network money and payment rate."""
    return (enriched.groupBy("Network_Status")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 money_sum("billed_amount").alias("total_billed"),
                 money_sum("paid_amount").alias("total_paid"),
                 money_avg("billed_amount").alias("avg_billed"),
                 money_avg("paid_amount").alias("avg_paid"),
                 fixed_avg("payment_rate").alias("avg_payment_rate")))


def gender_report(enriched: DataFrame) -> DataFrame:
    """Utilisation by sex."""
    return (enriched.groupBy("Sex")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 F.countDistinct("member_id").alias("unique_members"),
                 money_sum("billed_amount").alias("total_cost"),
                 money_avg("billed_amount").alias("avg_cost_per_claim"),
                 F.avg("AGE").alias("avg_age"))
            .withColumn("cost_per_member", ratio("total_cost", "unique_members")))


def race_report(enriched: DataFrame) -> DataFrame:
    """Utilisation and denials by race; largest first."""
    return (enriched.groupBy("race")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 F.countDistinct("member_id").alias("unique_members"),
                 money_sum("billed_amount").alias("total_cost"),
                 money_avg("billed_amount").alias("avg_cost_per_claim"),
                 F.sum("has_denial").alias("denials"))
            .withColumn("denial_rate", ratio("denials", "claim_count"))
            .orderBy(*_desc_then(["race"], "claim_count")))


def state_report(enriched: DataFrame) -> DataFrame:
    """A10: utilisation by state; costliest first."""
    return (enriched.groupBy("State")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 F.countDistinct("member_id").alias("unique_members"),
                 money_sum("billed_amount").alias("total_cost"),
                 money_avg("billed_amount").alias("avg_cost_per_claim"),
                 F.sum("is_inpatient").alias("inpatient_claims"))
            .withColumns({"cost_per_member": ratio("total_cost", "unique_members"),
                          "inpatient_rate": ratio("inpatient_claims", "claim_count")})
            .orderBy(*_desc_then(["State"], "total_cost")))


def readmission_report(enriched: DataFrame) -> DataFrame:
    """Inpatient claims by provider type and age group; readmission rate."""
    keys = ["Provider_Type", "age_group"]
    return (enriched.filter(F.col("is_inpatient") == 1)
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("inpatient_claims"),
                 F.sum("is_readmission").alias("readmissions"),
                 F.avg("Length_of_Stay").alias("avg_los"),
                 money_sum("billed_amount").alias("total_cost"))
            .withColumn("readmission_rate", ratio("readmissions", "inpatient_claims"))
            .orderBy(*_desc_then(keys, "readmission_rate")))


def denial_report(enriched: DataFrame) -> DataFrame:
    """Denied claims by reason."""
    return (enriched.filter(F.col("has_denial") == 1)
            .groupBy("denial_reason")
            .agg(F.count(F.lit(1)).alias("denial_count"),
                 money_sum("billed_amount").alias("denied_amount"),
                 money_avg("billed_amount").alias("avg_denied_amount"))
            .orderBy(*_desc_then(["denial_reason"], "denial_count")))


def variance_report(enriched: DataFrame) -> DataFrame:
    """Payment variance by service (A31 conditional counts)."""
    v = F.col("Variance")
    return (enriched.filter(v.isNotNull())
            .groupBy("Type_of_Service")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 money_avg("Variance").alias("avg_variance"),
                 F.sum(F.when(v > 0, 1).otherwise(0)).alias("positive_variance_count"),
                 F.sum(F.when(v < 0, 1).otherwise(0)).alias("negative_variance_count"))
            .withColumn("positive_variance_rate", ratio("positive_variance_count", "claim_count")))


def cpt_report(enriched: DataFrame, n: int | None = 15) -> DataFrame:
    """Most frequent procedure codes with cost, providers and denials."""
    out = (enriched.filter(F.col("cpt_code").isNotNull())
           .groupBy("cpt_code")
           .agg(F.count(F.lit(1)).alias("procedure_count"),
                money_sum("billed_amount").alias("total_billed"),
                money_avg("billed_amount").alias("avg_cost"),
                F.countDistinct("ProviderID").alias("provider_count"),
                F.sum("has_denial").alias("denials"))
           .withColumn("denial_rate", ratio("denials", "procedure_count")))
    return _top(out, _desc_then(["cpt_code"], "procedure_count"), n)


def record_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row frame (no driver round trip)."""
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def completeness_report(enriched: DataFrame) -> DataFrame:
    """Share of non-null admission date, stay and CPT per service."""
    def share(c: str) -> Column:
        total = F.col("total_claims")
        return F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))

    return (enriched.groupBy("Type_of_Service")
            .agg(F.count(F.lit(1)).alias("total_claims"),
                 F.count(F.when(F.col("admission_date").isNotNull(), 1)).alias("admission_date_complete"),
                 F.count(F.when(F.col("Length_of_Stay").isNotNull(), 1)).alias("los_complete"),
                 F.count(F.when(F.col("cpt_code").isNotNull(), 1)).alias("cpt_complete"))
            .withColumns({"admission_completeness": share("admission_date_complete"),
                          "los_completeness": share("los_complete"),
                          "cpt_completeness": share("cpt_complete")}))


def age_band_report(claims: DataFrame, scheme: str = "detailed") -> DataFrame:
    """Raw claims by the detailed age band."""
    return (claims.withColumn("age_group", age_band("AGE", scheme))
            .groupBy("age_group")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 money_sum("billed_amount").alias("total_billed"),
                 money_avg("billed_amount").alias("avg_billed"))
            .orderBy("age_group"))


def age_sex_report(claims: DataFrame) -> DataFrame:
    """Raw claims by decade band and sex."""
    return (claims.withColumn("age_group", age_band("AGE", "decade"))
            .groupBy("age_group", "Sex")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 F.countDistinct("member_id").alias("unique_members"),
                 money_avg("billed_amount").alias("avg_billed"))
            .orderBy("age_group", "Sex"))


def state_billed_report(claims: DataFrame) -> DataFrame:
    """Raw claims by state; most billed first."""
    return (claims.groupBy("State")
            .agg(F.count(F.lit(1)).alias("claim_count"),
                 F.countDistinct("member_id").alias("unique_members"),
                 money_sum("billed_amount").alias("total_billed"))
            .orderBy(*_desc_then(["State"], "total_billed")))


def status_distribution(eligibility: DataFrame, column: str = "eligibility_status") -> DataFrame:
    """Rows per value of ``column``."""
    return eligibility.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def location_report(providers: DataFrame) -> DataFrame:
    """Providers per location, PCP count and the sorted specialty list.

    The list is built from (location, specialty, n) pairs, so the shuffle
    carries at most one row per distinct specialty per task, however many
    providers share a location; the list itself is the report's value.
    """
    pairs = (providers.groupBy("practice_location", "specialty")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.count(F.when(F.col("is_pcp") == 1, 1)).alias("pcp")))
    spec_n = F.when(F.col("specialty").isNotNull(), F.col("n")).otherwise(F.lit(0))
    return (pairs.groupBy("practice_location")
            .agg(F.sum("n").alias("provider_count"),
                 F.sum("pcp").alias("pcp_count"),
                 F.sort_array(F.collect_list(F.struct(F.col("specialty"), spec_n.alias("n"))))
                 .alias("_pairs"))
            .withColumn("specialties", F.flatten(F.transform(
                F.col("_pairs"), lambda p: F.array_repeat(p["specialty"], p["n"].cast("int")))))
            .drop("_pairs")
            .orderBy(F.col("provider_count").desc(), F.col("practice_location")))


def specialty_report(providers: DataFrame) -> DataFrame:
    """Providers per specialty, PCP count, distinct locations."""
    return (providers.groupBy("specialty")
            .agg(F.count(F.lit(1)).alias("provider_count"),
                 F.count(F.when(F.col("is_pcp") == 1, 1)).alias("pcp_count"),
                 F.countDistinct("practice_location").alias("locations"))
            .orderBy(F.col("provider_count").desc(), F.col("specialty")))


def report_suite(claims: DataFrame, profile: str = "lenient", path: str | None = None,
                 top_facilities: int | None = 10, top_cpt: int | None = 15) -> dict[str, DataFrame]:
    """All enriched-claims reports (A2-A16) over one enrichment.

    With ``path`` (a folder in the shared file system) the enriched, typed
    claims are written once and every report scans that table: dates are
    parsed once instead of once per report, and typed dates prune at the
    scan.  Without it the reports share the lazy enrichment plan.
    """
    from caremart.operators.enrich import enhance_claims
    from caremart.sources.tables import write_path

    e = enhance_claims(claims, profile)
    if path:
        e = write_path(e, path)
    return {
        "provider_report": provider_report(e),
        "member_utilization": member_utilization(e),
        "service_trends": service_trends(e),
        "age_report": age_report(e),
        "facility_report": facility_report(e, top_facilities),
        "network_report": network_report(e),
        "gender_report": gender_report(e),
        "race_report": race_report(e),
        "state_report": state_report(e),
        "readmission_report": readmission_report(e),
        "denial_report": denial_report(e),
        "variance_report": variance_report(e),
        "cpt_report": cpt_report(e, top_cpt),
        "record_count": record_count(e),
        "completeness_report": completeness_report(e),
    }
