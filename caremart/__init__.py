"""caremart: healthcare-claims analytics on Spark DataFrames.

Every operator takes and returns DataFrames; pass catalog tables
(``spark.table("claims")``) or the test ``Warehouse`` frames.
"""

from caremart.functions import (age_band, apply_filters, filter_keys, in_date_range,
                                null_sentinel, parse_date, register_functions, rewrite_by_key,
                                safe_double, safe_long, update_where)
from caremart.operators.dimensions import (as_of_join, claims_with_dimensions,
                                           eligibility_impact, left_dimension, location_impact)
from caremart.operators.enrich import enhance_claims, repair_amounts
from caremart.operators.params import (InvalidArguments, claims_by_date_range, claims_summary,
                                       dynamic_analysis, filtered_view, grouped_summary,
                                       run_named_query, service_provider_summary,
                                       state_service_summary, validated_claims_summary,
                                       view_state_totals)
from caremart.operators.pharmacy import (claims_with_payor, join_on_member, member_drug_counts,
                                         pharmacy_claim_detail, pharmacy_monthly_totals,
                                         pharmacy_provider_counts, pharmacy_provider_payor_totals,
                                         top_drug_claim, top_paid_by_payor)
from caremart.operators.quality import (duplicate_keys, missing_required, period_overlaps,
                                        value_distribution)
from caremart.operators.reports import (age_band_report, age_report, age_sex_report,
                                        completeness_report, cpt_report, denial_report,
                                        facility_report, gender_report, location_report,
                                        member_utilization, network_report, provider_report,
                                        race_report, readmission_report, record_count,
                                        report_suite, service_trends, specialty_report, state_billed_report,
                                        state_report, status_distribution, type_state_summary,
                                        variance_report)
from caremart.operators.scd import (affected_rows, assign_dim_key, change_summary, run_scd1,
                                    run_scd2, scd1_upsert, scd2_apply, scd2_apply_dim,
                                    scd2_changes, scd2_init, upsert_summary)
from caremart.operators.snapshots import age_bands, paid_claims_snapshot
from caremart.sources import (Warehouse, change_set, empty_table, load_or_init_scd2, preview,
                              register_view, table, write_path, write_table)

__version__ = "0.3.0"
