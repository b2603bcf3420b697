from caremart.operators import enrich, reports

COLS = ("claim_id string, member_id string, ProviderID string, Provider_Type string, State string, "
        "Type_of_Service string, date_of_service string, admission_date string, discharge_date string, "
        "readmission_date string, paid_date string, claim_received_date string, billed_amount double, "
        "paid_amount double, Variance double, Length_of_Stay int, AGE int, Sex string, race string, "
        "readmit_indicator int, denial_reason string, payment_status string, Network_Status string, "
        "facility_name string, cpt_code string")


def _claims(spark):
    data = [
        ("C1", "7", "PR1", "Clinic", "S1", "Inpatient", "1996-03-01", "3/1/1996", "3/5/1996", "NULL",
         "3/10/1996", "1996-03-01", 100.0, 80.0, 0.02, 4, 30, "F", "R1", 0, "", "Paid", "In Network",
         "Facility 1", "CPT1"),
        ("C2", "7", "PR1", "Clinic", "S1", "Outpatient", "1996-04-01", "NULL", "", None,
         "NULL", "1996-04-01", -50.0, -5.0, None, -2, None, "F", "R1", 1, "NULL", "Denied", "In Network",
         "NULL", None),
        ("C3", "8", "PR2", "Hospital", "S2", "Inpatient", "bad", "", None, "4/2/1996", "4/20/1996",
         "1996-04-02", None, 10.0, -0.01, 3, 10, "M", "R2", 0, "Not Covered", "Denied", "Out of Network",
         "", "CPT2"),
        ("C4", "8", "PR2", "Hospital", "S2", "Emergency", "1996-05-01", "5/1/1996", "5/2/1996", "NULL",
         "5/3/1996", "1996-05-01", 0.0, 0.0, 0.0, None, 70, "M", "R2", 0, None, "Pending", "In Network",
         "Facility 2", None),
    ]
    return spark.createDataFrame(data, COLS)


def test_profiles_differ_where_documented(spark):
    c = _claims(spark)
    strict = {r.claim_id: r for r in enrich.enhance_claims(c, "strict").collect()}
    lenient = {r.claim_id: r for r in enrich.enhance_claims(c, "lenient").collect()}
    # empty denial text: strict no denial, lenient denial
    assert strict["C1"].has_denial == 0 and lenient["C1"].has_denial == 1
    assert strict["C2"].has_denial == 0 and lenient["C2"].has_denial == 0
    assert strict["C3"].has_denial == 1 and lenient["C3"].has_denial == 1
    # null age
    assert strict["C2"].age_group == "Unknown" and lenient["C2"].age_group == "Senior"
    # amounts: rates on raw values, then repair
    assert lenient["C2"].payment_rate == 0.1 and lenient["C2"].billed_amount == 0.0
    assert lenient["C2"].paid_amount == 0.0 and lenient["C2"].denial_amount == -45.0
    assert lenient["C3"].billed_amount is None and strict["C3"].billed_amount == 0.0
    assert lenient["C4"].payment_rate is None and strict["C4"].payment_rate is None
    assert lenient["C2"].Length_of_Stay is None and lenient["C1"].Length_of_Stay == 4
    # cleaned text only in strict
    assert strict["C2"].facility_name is None and lenient["C2"].facility_name == "NULL"
    # dates and derived calendar fields
    assert lenient["C1"].processing_days == 9 and lenient["C2"].processing_days is None
    assert lenient["C3"].service_quarter is None and lenient["C1"].service_quarter == "1996-Q1"
    assert lenient["C1"].is_inpatient == 1 and lenient["C2"].is_readmission == 1


def test_reports_on_tiny_claims(spark):
    e = enrich.enhance_claims(_claims(spark), "lenient")
    prov = {r.ProviderID: r for r in reports.provider_report(e).collect()}
    assert prov["PR1"].total_claims == 2 and prov["PR1"].unique_patients == 1
    assert prov["PR1"].total_billed == 100.0 and prov["PR1"].denied_claims == 1
    assert prov["PR2"].total_billed == 0.0 and prov["PR2"].payment_rate is None
    fac = reports.facility_report(e).collect()
    assert {r.facility_name for r in fac} == {"Facility 1", "Facility 2", ""}
    cnt = reports.record_count(e).first().total_records
    assert cnt == 4
    comp = {r.Type_of_Service: r for r in reports.completeness_report(e).collect()}
    assert comp["Inpatient"].admission_date_complete == 1 and comp["Inpatient"].admission_completeness == 0.5
    loc = reports.location_report(spark.createDataFrame(
        [("A", "x", 1), ("A", "y", 0), ("A", "x", 1), ("B", "z", 0)],
        "practice_location string, specialty string, is_pcp int")).collect()
    got = {r.practice_location: (r.provider_count, r.pcp_count, r.specialties) for r in loc}
    assert got == {"A": (3, 2, ["x", "x", "y"]), "B": (1, 0, ["z"])}


def test_report_suite_matches_registered_reports(spark, tmp_path):
    from __spark_entry__ import queries
    from caremart.plans.registry import wh
    from tests.conftest import SF_SMALL, rows
    suite = reports.report_suite(wh(spark, SF_SMALL).claims, path=str(tmp_path / "enriched"))
    qs = queries()
    for name, df in suite.items():
        assert rows(df) == rows(qs[name](spark, SF_SMALL)), name
