"""Claims enrichment.

Two profiles exist because the source notebooks enrich claims twice with
different rules:

* ``strict``: sentinels (null, ``"NULL"``, ``""``) are removed before parsing;
  ratios are guarded; null/negative amounts become 0; empty denial text is not
  a denial; denial reason and facility name are cleaned.
* ``lenient``: dates are parsed as they are (bad text -> null); ``""`` denial
  text counts as a denial; null amounts stay null; only negative amounts
  become 0; null age falls into ``Senior``.

Rates use raw amounts and amounts are repaired afterwards, in that order.
The whole enrichment is one projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.functions.bands import age_band
from caremart.functions.cleaning import ISO_DATE, US_DATE, flag, null_sentinel, parse_date

PROFILES = ("strict", "lenient")

# column -> text layout of that date column in claims extracts
DATE_FORMATS = {
    "date_of_service": ISO_DATE,
    "admission_date": US_DATE,
    "discharge_date": US_DATE,
    "readmission_date": US_DATE,
    "paid_date": US_DATE,
    "claim_received_date": ISO_DATE,
}

DERIVED = ("payment_rate", "denial_amount", "processing_days", "service_year", "service_month",
           "service_quarter", "age_group", "is_inpatient", "is_readmission", "has_denial", "is_paid")


def _typed_dates(profile: str) -> dict:
    out = {}
    for name, fmt in DATE_FORMATS.items():
        c = F.col(name)
        if profile == "strict":
            out[name] = parse_date(null_sentinel(c), [fmt])
        else:
            out[name] = parse_date(c, [fmt])
    return out


def repair_amounts(df: DataFrame, profile: str = "lenient") -> DataFrame:
    """Negative (strict: also null) amounts -> 0; negative stay -> null."""
    billed, paid, los = F.col("billed_amount"), F.col("paid_amount"), F.col("Length_of_Stay")
    if profile == "strict":
        fix = {
            "billed_amount": F.when(billed.isNull() | (billed < 0), F.lit(0.0)).otherwise(billed),
            "paid_amount": F.when(paid.isNull() | (paid < 0), F.lit(0.0)).otherwise(paid),
            "Length_of_Stay": F.when(los.isNull() | (los < 0), F.lit(None)).otherwise(los),
            "denial_reason": null_sentinel("denial_reason"),
            "facility_name": null_sentinel("facility_name"),
        }
    elif profile == "lenient":
        fix = {
            "billed_amount": F.when(billed < 0, F.lit(0.0)).otherwise(billed),
            "paid_amount": F.when(paid < 0, F.lit(0.0)).otherwise(paid),
            "Length_of_Stay": F.when(los < 0, F.lit(None)).otherwise(los),
        }
    else:
        raise ValueError(f"profile must be one of {PROFILES}")
    return df.withColumns(fix)


def enhance_claims(claims: DataFrame, profile: str = "lenient") -> DataFrame:
    """P5: typed dates, rates, calendar fields, bands, flags, repaired amounts."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    df = claims.withColumns(_typed_dates(profile))

    billed, paid = F.col("billed_amount"), F.col("paid_amount")
    dos = F.col("date_of_service")
    denial = F.col("denial_reason")
    if profile == "strict":
        payment_rate = F.when(billed.isNull() | (billed == 0), F.lit(None)).otherwise(
            F.try_divide(paid, billed))
        service_quarter = F.when(dos.isNull(), F.lit(None)).otherwise(
            F.concat(F.year(dos), F.lit("-Q"), F.quarter(dos)))
        has_denial = F.when(denial.isNull() | denial.isin("NULL", ""), F.lit(0)).otherwise(F.lit(1))
        band = age_band("AGE", "basic")
    else:
        payment_rate = F.try_divide(paid, billed)
        service_quarter = F.concat(F.year(dos), F.lit("-Q"), F.quarter(dos))
        has_denial = flag(denial.isNotNull() & (denial != "NULL"))
        band = age_band("AGE", "basic_lenient")

    df = df.withColumns({
        # P6
        "payment_rate": payment_rate,
        "denial_amount": billed - paid,
        # P7
        "processing_days": F.datediff(F.col("paid_date"), F.col("claim_received_date")),
        # P8
        "service_year": F.year(dos),
        "service_month": F.month(dos),
        "service_quarter": service_quarter,
        # P9
        "age_group": band,
        # P10 / P11
        "is_inpatient": flag(F.col("Type_of_Service") == "Inpatient"),
        "is_readmission": flag(F.col("readmit_indicator") == 1),
        "has_denial": has_denial,
        "is_paid": flag(F.col("payment_status") == "Paid"),
    })
    return repair_amounts(df, profile)
